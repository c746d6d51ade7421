"""Mentions of any number of names: rows as in SQL on odd inputs, and no pair of a name and a text on the way."""

import pyarrow.parquet as pq

import __spark_entry__ as entry
from quernstone.operators import mentions
from quernstone.tables import CHUNKS, REPOS, SYMBOLS
from tests.oracle import connect, rows

LONG = "booking_" + "x" * 150
ODD = ["cancelBooking", "booking", "a.b.Booking", "booking.", "s.booking+", "getBookingÄß", "预订booking预订", LONG, LONG + "y", "bookingé", "booking name\twith blanks", "Booking::new"]
TEXTS = [
    None, "", "booking", "reBOOKINGs", "cancelbookin", "x" * 70_000 + "cancelBooking", "ä" * (mentions.STEP // 2 - 3) + "cancelBooking" + "z" * mentions.STEP + "Booking::new", "gETbOOKINGäß", "预订Booking预订", LONG.upper(), LONG + "Y",
    "booking\nbooking name\twith blanks", "cancel", "Booking+ booking+", "bookingé BOOKINGÉ",
]


def folder_of(spark, folder, names, texts):
    """Tables of two projects and a generation that isn't published; texts are repeated, and split between lines of a file."""
    chunks = [(k, p, f"f{k // 3}.ts", k + 1, k + 2, "c", g, t) for k, t in enumerate(texts) for p, g in (("p", "g"), ("q", "g"), ("p", "old"))]
    symbols = [(k, "p", "f.ts", "function", n, n if k % 2 else None, 1, 2, "", 1, None, "c", "g") for k, n in enumerate(names)] + [(9000, "q", "f.ts", "function", "cancelBooking", None, 1, 2, "", 1, None, "c", "g"), (9001, "q", "f.ts", "function", "bookinge", None, 1, 2, "", 0, None, "c", "g")]
    repos = [(p, "", "", "", "", "g", None) for p in ("p", "q")]
    for name, table, schema in (("chunks", chunks + chunks[:9], CHUNKS), ("symbols", symbols, SYMBOLS), ("repos", repos, REPOS)):
        pq.write_table(spark.createDataFrame(table, schema).toArrow(), folder / f"{name}.parquet")
    return str(folder)


def as_in_sql(spark, folder):
    got = entry.queries()["name_mentions"](spark, folder).toPandas()
    assert rows(got) == rows(connect(folder).execute(entry.oracle_sql()["name_mentions"]).df())
    return got


def test_odd_names_and_texts(spark, tmp_path):
    got = as_in_sql(spark, folder_of(spark, tmp_path, ODD, TEXTS))
    assert {n.lower() for n in ("booking", "cancelBooking", "booking+", "getBookingÄß", "预订booking预订", LONG, LONG + "y", "bookingé", "booking name\twith blanks", "Booking::new")} == set(got["name"])


def test_all_procedures_are_looked_up(spark, tmp_path):
    """only procedures with booking in their name were."""
    got = as_in_sql(spark, folder_of(spark, tmp_path, ["fetchRoom", "api.Rooms.list", "f", "++", "a booking"], ["await fetchRoom()", "i++", "x = Room.LIST", "of a booking"]))
    assert {"fetchroom", "list", "f", "++", "a booking"} == set(got["name"])


def test_without_names_or_texts(spark, tmp_path):
    for k, (names, texts) in enumerate((([], [None]), (["booking"], [None, ""]), (["booking."], ["booking"]))):
        (tmp_path / str(k)).mkdir()
        assert len(as_in_sql(spark, folder_of(spark, tmp_path / str(k), names, texts))) == 0
    empty = spark.createDataFrame([], "project string, name string")
    assert mentions.all_mentions(spark.createDataFrame([(1, "p", "f", 1, 1, "c", "g", "x")], CHUNKS), empty).count() == 0


def test_no_list_of_names_by_project(spark, small):
    """an array of a project's names, gone through for each text, makes the time grow with names times texts."""
    plan = entry.queries()["name_mentions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "MapInArrow" in plan


def test_full_marks_change_nothing(spark, tmp_path, monkeypatch):
    """When nearly every mark is set, all that is looked up is joined."""
    monkeypatch.setattr(mentions, "MOST_WORDS", 1)
    as_in_sql(spark, folder_of(spark, tmp_path, ODD + [f"booking{k}" for k in range(200)], TEXTS + [" ".join(f"xbooking{k}" for k in range(0, 400, 7))]))
