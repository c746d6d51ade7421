"""Rows of the published generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Columns that tell rows of one id apart; those of them that a table has make a row's key.
PLACE = ("project", "generation_id", "path", "source_path", "start_line", "line")


def published_rows(df: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of df that belong to their project's published generation, repeated ones as often as they are there. No shuffle of df."""
    pointers = repos.select("project", "generation_id").distinct()
    return df.join(pointers, ["project", "generation_id"], "left_semi")


def current_rows(df: DataFrame, repos: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of df that belong to their project's published generation, once each; other rows and repeated rows are left out.

    columns: the columns to keep, of which equal rows are one; so every use of a table in a plan shares one exchange. Without them, of
    a table with ids rows of one id and place are one row, and only the columns that a query goes on to use are shuffled; of other
    tables equal rows are one. A project that ``repos`` doesn't list, or a null generation, has no current rows.
    """
    own = published_rows(df, repos)
    if columns:
        return own.select(*columns).distinct()
    return own.dropDuplicates(["id", *[c for c in PLACE if c in df.columns]]) if "id" in df.columns else own.distinct()


def stale_counts(df: DataFrame, repos: DataFrame, name: str) -> DataFrame:
    """source, project, current_rows, stale_rows: rows per project by whether their generation is the published one."""
    pointers = repos.select("project", F.col("generation_id").alias("published")).distinct()
    joined = df.join(pointers, "project", "left")
    fresh = F.coalesce(F.col("generation_id") == F.col("published"), F.lit(False))
    return joined.groupBy("project").agg(F.count_if(fresh).alias("current_rows"), F.count_if(~fresh).alias("stale_rows")).select(F.lit(name).alias("source"), "project", "current_rows", "stale_rows")
