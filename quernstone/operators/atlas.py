"""Compact views of a whole graph: skeletons, dictionaries, batches, claims."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut


def skeleton(edges: DataFrame) -> DataFrame:
    """project, source_path, relation, edges: edges of each file by relation, each id once."""
    once = edges.groupBy("id").agg(F.min("project").alias("project"), F.min("source_path").alias("source_path"), F.min("relation").alias("relation"))
    return once.groupBy("project", "source_path", "relation").agg(F.count(F.lit(1)).alias("edges"))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def dictionary(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """value, code: a short code for each distinct value of a column, in order of the values.

    Numbers are given within hash-ranged partitions and offset by the partitions before them, so no single task numbers all
    values: ranges are sorted in parallel and their counts, one per partition, make the offsets.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    # Range bounds are sampled, so the parts are written once and both uses below read the same ones.
    ranged = cut(values.repartitionByRange(F.col("value")).withColumn("part", F.spark_partition_id()))
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    counts = local.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offsets.select("part", "offset")), "part").select("value", F.concat(F.lit(prefix), base36(F.col("n") + F.col("offset") - 1)).alias("code"))


def ownership_errors(items: DataFrame, batches: DataFrame, key: str = "id") -> DataFrame:
    """key, times: the items that the batches don't hold exactly once, and what they hold that is no item."""
    held = batches.groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    own = items.select(key).distinct().withColumn("is_item", F.lit(1))
    both = own.join(held, key, "full_outer")
    return both.where(F.col("is_item").isNull() | F.col("times").isNull() | (F.col("times") != 1)).select(key, F.coalesce("times", F.lit(0)).cast("bigint").alias("times"))


def batches_by_cost(edges: DataFrame, budget: int, cost: Column) -> DataFrame:
    """id, project, batch: each project's edges in order of path, source and id, cut where their running cost passes multiples of the budget.

    Costs add up, so a running sum per file and the sums of the files before it give each edge its place; a window holds one
    file's edges or one project's files, never all edges of a project.
    """
    rows = edges.groupBy("id").agg(F.min("project").alias("project"), F.min("source_path").alias("source_path"), F.min(F.coalesce("source_qualified_name", F.lit(""))).alias("source"), F.min(cost).alias("cost"))
    files = rows.groupBy("project", "source_path").agg(F.sum("cost").alias("total"))
    before = files.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("project").orderBy("source_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("cost").over(Window.partitionBy("project", "source_path").orderBy("source", "id").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("within", within).join(before.select("project", "source_path", "before"), ["project", "source_path"])
    return placed.select("id", "project", F.floor((F.col("before") + F.col("within") - 1) / budget).cast("bigint").alias("batch"))


def prefix_batches(edges: DataFrame, budget: int, cost: Column) -> DataFrame:
    """id, project, batch, used: each project's edges in order of path, source and id, as many to a batch as its budget holds.

    Where a batch ends depends on where the one before did, so a project's edges are read in order as a stream that holds one sum; for
    projects that shouldn't be one task see batches_by_cost. An edge beyond the budget is an error.
    """
    own = edges.groupBy("id").agg(F.min("project").alias("project"), F.min("source_path").alias("source_path"), F.min(F.coalesce("source_qualified_name", F.lit(""))).alias("source"), F.min(cost.cast("bigint")).alias("cost"))
    ordered = own.repartition("project").sortWithinPartitions("project", "source_path", "source", "id").select("id", "project", "cost")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, number, used = None, 0, 0
        for rows in batches:
            out = []
            for one, own_project, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if n > budget:
                    raise ValueError(f"edge {one} exceeds the budget")
                if own_project != project:
                    project, number, used = own_project, 0, 0
                if used + n > budget:
                    number, used = number + 1, 0
                used += n
                out.append((number, used))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["id", "project", "batch", "used"])

    return ordered.mapInArrow(walk, "id bigint, project string, batch bigint, used bigint")


def encoded(edges: DataFrame) -> dict[str, DataFrame]:
    """paths, names, relations, confidences: value, code; groups: path, name and their edges as codes: a graph with every text once.

    A group's edges are an array of (id, relation, target name, target path or '', line, confidence) in order of line and id.
    """
    paths = dictionary(edges.select(F.col("source_path").alias("v")).union(edges.select("target_path")), "v", "P")
    names = dictionary(edges.select(F.coalesce("source_qualified_name", "source_name").alias("v")).union(edges.select(F.coalesce("target_qualified_name", "target_name"))), "v", "N")
    relations, confidences = dictionary(edges, "relation", "R"), dictionary(edges, "resolution_confidence", "C")
    coded = edges.withColumn("source", F.coalesce("source_qualified_name", "source_name")).withColumn("target", F.coalesce("target_qualified_name", "target_name"))
    for column, codes in (("source_path", paths), ("target_path", paths), ("source", names), ("target", names), ("relation", relations), ("resolution_confidence", confidences)):
        coded = coded.join(codes.select(F.col("value").alias(column), F.col("code").alias(f"{column}_code")), column, "left")
    entry = F.struct("line", "id", F.col("relation_code").alias("relation"), F.col("target_code").alias("target"), F.coalesce("target_path_code", F.lit("")).alias("path"), F.col("resolution_confidence_code").alias("confidence"))
    groups = coded.groupBy("project", F.col("source_path_code").alias("path"), F.col("source_code").alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("edges"))
    return {"paths": paths, "names": names, "relations": relations, "confidences": confidences, "groups": groups}


def claim_id(text: Column, kind: Column) -> Column:
    """The name of a claim by what it says."""
    return F.concat(F.lit("C"), F.substring(F.sha2(F.concat_ws("\x1f", text, kind), 256), 1, 16))


def merge_claims(claims: DataFrame) -> DataFrame:
    """claim_id, support, evidence, contradicted: claims of one text merged; nothing is removed.

    claims: at, text, kind, support ('support', 'refute' or 'unknown'), evidence. The first known support is kept; a claim
    that is both supported and refuted is marked.
    """
    key = claim_id(F.col("text"), F.col("kind")).alias("claim_id")
    known = F.when(F.col("support") != "unknown", F.col("support"))
    grouped = claims.groupBy(key).agg(F.min_by(known, F.when(known.isNotNull(), F.col("at"))).alias("support"), F.count_distinct("evidence").alias("evidence"), F.count_distinct(known).alias("states"))
    return grouped.select("claim_id", F.coalesce("support", F.lit("unknown")).alias("support"), "evidence", (F.col("states") > 1).cast("int").alias("contradicted"))
