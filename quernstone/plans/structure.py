"""Queries of extraction, of context and of event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.text import query_terms
from quernstone.operators.context import fuse_candidates
from quernstone.operators.current import current_rows
from quernstone.operators.extract import build_graph, extract_edges, extract_symbols, graph_statistics, resolve_imports
from quernstone.operators.graph import covering_symbols, lineage
from quernstone.plans.retrieval import QUESTION, _scored
from quernstone.streaming.refresh import activity
from quernstone.tables import CHUNKS, conformed, table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "chunks"), table(spark, folder, "repos"))


def extracted_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return extract_symbols(_chunks(spark, folder))


def extracted_edges(spark: SparkSession, folder: str) -> DataFrame:
    return extract_edges(_chunks(spark, folder))


# Files that import each other, since the tables' imports name no files of theirs.
PLANTED = (("src/app/main.ts", 'import { a } from "./lib";\nimport b from "../util/b";\nimport "react";\n'), ("src/app/lib/index.ts", 'export const a = () => 1;\n'), ("src/util/b.tsx", 'import * as m from "@/app/main";\nexport default m;\n'), ("src/util/b/index.js", ""))


def extracted_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Imports that name a file, of all chunks and of planted files."""
    planted = conformed(spark.createDataFrame([("planted", path, 1, text) for path, text in PLANTED], "project string, path string, start_line int, content string"), CHUNKS)
    chunks = conformed(_chunks(spark, folder), CHUNKS).unionByName(planted)
    return resolve_imports(extract_edges(chunks), chunks.select("project", "path"))


def built_graph(spark: SparkSession, folder: str) -> DataFrame:
    """How large the graphs are that all chunks give, per project."""
    graph = build_graph(_chunks(spark, folder))
    return graph_statistics(graph["symbols"], graph["edges"])


def context_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of several kinds for one question, fused by range."""
    hits = _scored(spark, folder).orderBy(F.desc("score"), "id").limit(60)
    ranked = hits.select("id", "project", "path", "start_line", "end_line", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank"))
    covered = covering_symbols(hits.select(F.col("id").alias("span_id"), "project", "path", "start_line", "end_line"), table(spark, folder, "symbols"))
    symbols = table(spark, folder, "symbols").select(F.col("id").alias("symbol_id"), "project", "path", "start_line", "end_line").distinct()
    anchors = covered.select("symbol_id").distinct().join(symbols, "symbol_id").select("project", "path", "start_line", "end_line", F.lit(0).alias("rank"))
    lines = lineage(table(spark, folder, "symbols"), _chunks(spark, folder), "invoice").select("project", "path", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), F.lit(0).alias("rank"))
    return fuse_candidates({"hit": ranked.drop("id"), "anchor": anchors, "lineage": lines}, query_terms(QUESTION))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return activity(table(spark, folder, "events")).select("event_type", F.unix_timestamp("begin").alias("begin"), "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (extracted_symbols, extracted_edges, extracted_imports, built_graph, context_candidates, event_windows)}
ORACLE_SQL = {
    "event_windows": "select event_type, epoch(time_bucket(interval '5 minutes', ts))::bigint as begin, count(*) n, round(sum(value), 4) as value from events group by 1, 2",
}
