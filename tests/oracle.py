"""Compare a query with its SQL in DuckDB."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(folder)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def rows(pdf):
    def plain(x):
        if x is None or x != x:
            return None
        kind = type(x).__name__
        return round(float(x), 4) if kind.startswith("float") else int(x) if kind.startswith("int") else str(x)

    table = [tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)]
    return sorted(table, key=lambda r: tuple((x is None, str(x)) for x in r))
