"""Per-key results with even load although a few keys hold most rows: multi-level tree aggregation.

Level 0 combines fixed-size input chunks locally: every row falls into a pair (key, chunk) whose size does not depend on
how hot its key is. Each further level merges the states of ``fan_in`` neighbouring chunks of a key, so no reducer ever
receives more than ``fan_in`` states of a key from the level below, and a hot key takes logarithmically many rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one chunk at level 0, on average, and chunks merged by one group of a later level.
CHUNK_ROWS, FAN_IN = 250_000, 16


@dataclass(frozen=True)
class Measure:
    """A mergeable result: ``first`` makes a state of rows, ``merge`` one of states, ``last`` the value of a state."""

    name: str
    first: Column
    merge: Column
    last: Column


def count_rows(name: str = "n") -> Measure:
    return Measure(name, F.count(F.lit(1)).alias(name), F.sum(name).alias(name), F.col(name))


def minimum(column: str, name: str) -> Measure:
    return Measure(name, F.min(column).alias(name), F.min(name).alias(name), F.col(name))


def maximum(column: str, name: str) -> Measure:
    return Measure(name, F.max(column).alias(name), F.max(name).alias(name), F.col(name))


def total(column: str, name: str) -> Measure:
    return Measure(name, F.sum(column).alias(name), F.sum(name).alias(name), F.col(name))


def distinct_estimate(column: str, name: str, lg_k: int = 12) -> Measure:
    """A sketch of 2**lg_k registers: its error (about 1.6 % at 12) does not depend on the key's size."""
    return Measure(name, F.hll_sketch_agg(column, lg_k).alias(name), F.hll_union_agg(name).alias(name), F.hll_sketch_estimate(name).alias(name))


def levels(chunks: int, fan_in: int) -> list[int]:
    """Numbers of chunks of a key after each merge round, down to 1."""
    out = []
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        out.append(chunks)
    return out


def tree_aggregate(df: DataFrame, keys: list[str], measures: list[Measure], chunks: int, spread: Column, fan_in: int = FAN_IN) -> DataFrame:
    """One row per key with the value of each measure.

    chunks: how many pieces a key may be cut into at most; rows over CHUNK_ROWS is right (``chunks_for``).
    spread: an expression over df that spreads the rows of one key evenly, such as a hash of a row id.
    A null key is a key of its own. An empty input gives no rows. Columns of df besides keys and measured ones are unused.
    """
    if chunks < 1 or fan_in < 2:
        raise ValueError("chunks must be at least 1 and fan_in at least 2")
    piece = "__piece"
    while piece in df.columns:
        piece += "_"
    state = df.withColumn(piece, F.pmod(spread, F.lit(chunks)).cast("int")).groupBy(*keys, piece).agg(*[m.first for m in measures])
    for left in levels(chunks, fan_in):
        state = state.withColumn(piece, F.pmod(F.col(piece), F.lit(left)).cast("int")).groupBy(*keys, piece).agg(*[m.merge for m in measures])
    return state.select(*keys, *[m.last.alias(m.name) for m in measures])


def chunks_for(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Pieces per key so that a key with all ``rows`` rows still has pieces of chunk_rows rows."""
    return max(1, math.ceil(rows / chunk_rows))


def once_by_id(df: DataFrame, id_column: str, values: dict[str, Column]) -> DataFrame:
    """__h and the values: one row per id, and each row without id as a row of its own. __h spreads the rows evenly.

    Rows of one id whose values differ count by their least value. A row without id is named by its place in the scan, which a
    repeated task finds again, so such rows neither meet in one group nor change when a stage is run anew.
    """
    own = F.when(F.col(id_column).isNull(), F.monotonically_increasing_id())
    rows = df.select(F.col(id_column).alias("__id"), own.alias("__own"), *[v.alias(name) for name, v in values.items()])
    once = rows.groupBy("__id", "__own").agg(*[F.min(name).alias(name) for name in values])
    return once.select(F.xxhash64("__id", "__own").alias("__h"), *values)


def heavy_keys(df: DataFrame, id_column: str, fields: list[str], share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """field, key_value, n: the values of each field that hold at least ``share`` of all rows, each id counted once.

    Rows are first made distinct by id (see once_by_id). The fields are then turned into rows (field, value), so one tree serves
    all of them. Null values of a field are no key, yet count in the total. A total of 0 gives no rows.
    """
    once = once_by_id(df, id_column, {f"__v{k}": F.col(f) for k, f in enumerate(fields)})
    long = once.select("__h", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__v{k}").cast("string").alias("key_value")) for k, f in enumerate(fields)])).alias("__kv")).select("__h", "__kv.*")
    counts = tree_aggregate(long, ["field", "key_value"], [count_rows()], chunks_for(df.count(), chunk_rows), F.col("__h"))
    # One row per field: at most len(fields) rows, whatever the data hold.
    totals = counts.groupBy("field").agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(totals), "field").where(F.col("key_value").isNotNull() & (F.col("n") >= F.ceil(F.col("__total") * share - 1e-9))).select("field", "key_value", "n")
