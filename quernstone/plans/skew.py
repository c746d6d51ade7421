"""Queries of the skew-proof aggregations over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.skew import chunks_for, count_rows, distinct_estimate, heavy_keys, maximum, minimum, once_by_id, tree_aggregate
from quernstone.tables import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "edges"), "id", ["project", "target_name"], 0.03).select("field", "key_value")


def p6_target_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per project and target name: edges (each id once) and the span of their lines."""
    edges = table(spark, folder, "edges")
    once = once_by_id(edges, "id", {c: F.col(c) for c in ("project", "target_name", "line")})
    measures = [count_rows("edges"), minimum("line", "first_line"), maximum("line", "last_line")]
    return tree_aggregate(once, ["project", "target_name"], measures, chunks_for(edges.count()), F.col("__h"))


def p6_sources_per_target(spark: SparkSession, folder: str) -> DataFrame:
    """Per target name: edges and an estimate of how many files they come from, by mergeable sketches."""
    edges = table(spark, folder, "edges")
    rows = once_by_id(edges, "id", {"target_name": F.col("target_name"), "source": F.concat_ws("\x1f", "project", "source_path")})
    return tree_aggregate(rows, ["target_name"], [count_rows("edges"), distinct_estimate("source", "sources")], chunks_for(edges.count()), F.col("__h"))


QUERIES = {f.__name__: f for f in (p6_found, p6_target_stats, p6_sources_per_target)}
ORACLE_SQL = {
    "p6_found": """
        with e as (select id, min(project) project, min(target_name) target_name from edges where id is not null group by id
                   union all select id, project, target_name from edges where id is null),
        l as (select 'project' field, project key_value from e union all select 'target_name', target_name from e)
        select field, key_value from l where key_value is not null group by field, key_value
        having count(*) >= 0.03 * (select count(*) from e)""",
    "p6_target_stats": """
        select project, target_name, count(*) edges, min(line) first_line, max(line) last_line
        from (select id, min(project) project, min(target_name) target_name, min(line) line from edges where id is not null group by id
              union all select id, project, target_name, line from edges where id is null) e
        group by project, target_name""",
}
