"""Every query that has SQL gives the same rows as DuckDB, over whole tables; the others run."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows

CORE = [n for part in entry._PARTS if not part.__name__.startswith("quernstone.llm") for n in part.QUERIES]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CORE)
def test_query(name, spark, small, con):
    got = entry.queries()[name](spark, small).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in entry.oracle_sql():
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_subpackage():
    import pathlib
    import re

    for file in pathlib.Path(entry.__file__).parent.joinpath("quernstone").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"quernstone\.llm|from \.+llm", file.read_text()), file
