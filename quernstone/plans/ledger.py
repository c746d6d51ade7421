"""Queries of evidence, digests and dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import query_terms
from quernstone.operators import context, ledger, publish
from quernstone.operators.flow import structural_neighbours
from quernstone.operators.graph import lineage
from quernstone.operators.hints import hint_terms
from quernstone.operators.search import with_authority
from quernstone.plans.graph import _E, _S, CALLEE, NAME, _current
from quernstone.plans.hints import _hints, _ranked, _stated
from quernstone.plans.retrieval import _CHUNKS, QUESTION
from quernstone.session import cut


def graph_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return publish.graph_digests(_current(spark, folder, "edges", "metadata"), _current(spark, folder, "symbols", "metadata"))


def project_digest(spark: SparkSession, folder: str) -> DataFrame:
    return publish.project_digests(_current(spark, folder, "chunks"))


def indexed_files(spark: SparkSession, folder: str) -> DataFrame:
    return publish.indexed_paths(_current(spark, folder, "chunks"), _current(spark, folder, "symbols"))


def edge_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that resolved calls lead to."""
    edges = _current(spark, folder, "edges").where("relation = 'calls' and target_path is not null").withColumn("edge_id", F.col("id"))
    return ledger.target_symbols(edges, _current(spark, folder, "symbols")).select("edge_id", "path", "qualified_name", "start_line", "end_line")


def edge_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol around each edge's line."""
    edges = _current(spark, folder, "edges").select(F.col("id").alias("edge_id"), "project", F.col("source_path").alias("path"), "line")
    return ledger.containing(edges, _current(spark, folder, "symbols"), "edge_id").select("edge_id", "qualified_name", "s0", "s1")


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = _current(spark, folder, "chunks")
    projects = chunks.select("project").distinct()
    rows = [("symbol", None, NAME, None, None), ("callers", None, CALLEE, None, None), ("tests", None, NAME, None, None), ("range", "no/such/file.ts", None, 1, 2), ("fly", None, "x", None, None)]
    asked = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, op string, path string, name string, start_line int, end_line int")
    requests = asked.crossJoin(projects).withColumn("request", F.concat_ws(":", "project", "n")).drop("n")  # five rows
    return ledger.resolve_requests(requests, _current(spark, folder, "symbols"), _current(spark, folder, "edges"), _stated(spark, folder), chunks)


def requested_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence that a few requests to every project open."""
    found = cut(_asked(spark, folder)[0])
    chunks = _current(spark, folder, "chunks")
    symbols = ledger.open_symbols(found.where("kind = 'symbol'").withColumnRenamed("symbol", "qualified_name"), chunks, "s")
    return symbols.unionByName(ledger.open_ranges(found.where("kind <> 'symbol'"), chunks, "s")).select("evidence_id", "project", "path", "start_line", "end_line", "kind", "symbol", "complete")


def refused_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


def evidence_size(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the source of all functions of each project."""
    symbols = _current(spark, folder, "symbols").where("kind = 'function'")
    return ledger.evidence_totals(ledger.open_symbols(symbols, _current(spark, folder, "chunks"), "s"))


def question_dossier(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence for one question out of hits, hints, neighbours, anchors and lineage, within a budget."""
    hits = _ranked(spark, folder)
    symbols, edges, chunks = (_current(spark, folder, name) for name in ("symbols", "edges", "chunks"))
    near = structural_neighbours(hits.select("project", "path"), edges).select("project", "path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(0).alias("rank"))
    hints = _hints(spark, folder, hits, 12).select("project", "path", "start_line", "end_line", F.lit(0).alias("rank"))
    covered = hits.select("rank", "project", "path").join(context.candidate_symbols(hits.withColumnRenamed("rank", "place"), symbols, hint_terms(QUESTION)).withColumnRenamed("place", "rank"), "rank")
    anchors = covered.select("project", "path", F.col("s0").alias("start_line"), F.col("s1").alias("end_line"), F.lit(0).alias("rank"))
    lines = lineage(symbols, chunks, "invoice").select("project", "path", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), F.lit(0).alias("rank"))
    sources = {"hit": hits.select("project", "path", "start_line", "end_line", "rank"), "neighbour": near, "reverse_hint": hints, "anchor": anchors, "lineage": lines}
    fused = with_authority(context.fuse_candidates(sources, query_terms(QUESTION)), _current(spark, folder, "source_authority"))
    return context.dossier(fused, symbols, chunks, query_terms(QUESTION), 36_000).select("place", "project", "path", "start_line", "end_line", "symbol", "priority", "fate", F.length("content").alias("characters"))


_FUNCTIONS = (graph_fingerprint, project_digest, indexed_files, edge_targets, edge_sources, requested_evidence, refused_requests, evidence_size, question_dossier)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


# -- the same in DuckDB's SQL
def _row(fields: tuple[str, ...]) -> str:
    return "sha256(concat_ws(chr(30), " + ", ".join(f"coalesce('=' || {f}::varchar, '~')" for f in fields) + "))"


_FILE = "f as (select project, path, sha256(string_agg(h, '' order by start_line, h)) d from (select distinct project, path, start_line, sha256(content) h from cur where content is not null) x group by all)"
_EXEC = "('" + "', '".join(ledger.EXECUTABLE) + "')"
ORACLE_SQL = {
    "graph_fingerprint": f"with {_E}, {_S}, r as (select project, source_path path, 'E' tag, {_row(publish.EDGE_FIELDS)} h from e union all select project, path, 'S', {_row(publish.SYMBOL_FIELDS)} from s), f as (select project, path, tag, count(*) n, sha256(string_agg(h, '' order by h)) d from r group by all) select project, sum(n) filter (tag = 'E')::bigint edges, coalesce(sum(n) filter (tag = 'S'), 0)::bigint symbols, sha256(string_agg(concat_ws(chr(31), tag, coalesce(path, ''), d), chr(10) order by concat_ws(chr(31), tag, coalesce(path, ''), d))) digest from f group by project",
    "project_digest": f"with {_CHUNKS}, {_FILE}, g as (select project, lpad(strlen(path)::varchar, 8, '0') || path || d x from f) select project, count(*) files, sha256(string_agg(x, '' order by x)) digest from g group by project",
    "indexed_files": f"with {_CHUNKS}, {_S} select project, path from cur union select project, path from s",
    "edge_targets": f"with {_E}, {_S}, k as (select distinct project, path, qualified_name, start_line, end_line, unnest([lower(name), lower(qualified_name)]) k from s where active = 1), a as (select id, project, target_path, lower(coalesce(target_qualified_name, target_name)) f, lower(target_name) g from e where relation = 'calls' and target_path is not null), w as (select a.id, k.path, qualified_name, start_line, end_line, 1 w from a join k on k.project = a.project and k.k = a.f and k.path = a.target_path union select a.id, k.path, qualified_name, start_line, end_line, 2 from a join k on k.project = a.project and k.k = a.g and k.path = a.target_path), b as (select id, min(w) w from w group by id) select id edge_id, path, qualified_name, start_line, end_line from w semi join b on w.id = b.id and w.w = b.w",
    "edge_sources": f"with {_E}, {_S}, j as (select e.id edge_id, qualified_name, start_line s0, end_line s1, row_number() over (partition by e.id order by end_line - start_line, start_line, qualified_name) n from e join s on s.project = e.project and s.path = e.source_path and e.line between start_line and end_line where active = 1 and kind in {_EXEC}) select edge_id, qualified_name, s0, s1 from j where n = 1",
    "evidence_size": f"with {_CHUNKS}, {_S}, q as (select distinct project, path, qualified_name, start_line a, end_line b from s where kind = 'function'), h as (select q.*, greatest(coalesce(c.start_line, 1), 1) f, str_split(content, chr(10)) ls from q join cur c on c.project = q.project and c.path = q.path where content is not null and c.start_line <= b), l as (select project, path, qualified_name, a, b, f, unnest(ls) x, generate_subscripts(ls, 1) + f - 1 ln from h where f + len(ls) - 1 >= a), o as (select project, path, qualified_name, a, b, ln, arg_min(x, (f, x)) x from l where ln between a and b group by all), t as (select project, path, qualified_name, a, b, count(*) k, string_agg(x, chr(10) order by ln) x from o group by all), d as (select distinct project, path, a, b, x, k from t) select project, count(*) items, count(*) filter (k = b - a + 1) complete, sum(strlen(x))::bigint as bytes from d group by project",
}
