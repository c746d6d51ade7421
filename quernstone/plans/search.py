"""Queries of two-stage retrieval, with the authority that the table states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import capped_frequency
from quernstone.operators.results import diverse_hits
from quernstone.operators.search import Reranker, deep_seeds, hybrid_hits, keyword_hits, mixed_intent, retrieve, semantic_hits, should_rerank
from quernstone.plans.retrieval import _BM25, _CUR, _VALID, MODEL, QUESTION, TERMS, _current, _frequency_sql, _multiplier_sql, _query_vector, _vectors

MIXED = "Fix the retry worker and implement the reservation lock, with regression tests for provider failures"


def by_terms(question: str, documents: DataFrame) -> DataFrame:
    """A second stage without a model: how often a document holds the question's terms."""
    return documents.select("id", capped_frequency(F.col("document"), TERMS).alias("second"))


RERANKER = Reranker(by_terms, "terms")


def _hits(spark: SparkSession, folder: str, limit: int, question: str = QUESTION) -> DataFrame:
    return hybrid_hits(_current(spark, folder), _current(spark, folder, "source_authority"), _vectors(spark, folder), _query_vector(spark, folder), question, limit)


def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_hits(_current(spark, folder), _current(spark, folder, "source_authority"), QUESTION, 30)


def semantic_search(spark: SparkSession, folder: str) -> DataFrame:
    return semantic_hits(_current(spark, folder), _current(spark, folder, "source_authority"), _vectors(spark, folder), _query_vector(spark, folder), 60)


def search_fast(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of mode fast: one stage and a narrow pool."""
    hits, _, _ = retrieve(lambda n: _hits(spark, folder, n), QUESTION, "fast", RERANKER)
    return hits.select("id", "authority", "score")


def search_code(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of mode code: a wide pool and a second stage."""
    hits, second, _ = retrieve(lambda n: _hits(spark, folder, n), QUESTION, "code", RERANKER)
    assert second
    return hits.select("id", "authority", "score")


def flow_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return deep_seeds(_hits(spark, folder, 60)).select("project", "path", F.col("seed").cast("bigint").alias("seed"))


def mixed_response(spark: SparkSession, folder: str) -> DataFrame:
    """What is shown for a question that asks for implementation and tests."""
    hits = _hits(spark, folder, 60, MIXED).withColumn("question", F.lit("q"))
    shown = diverse_hits(hits.select("question", "id", "project", "path", "start_line", "end_line", "score", "authority"), mixed=mixed_intent(MIXED))
    return shown.join(hits.select("id", "authority"), "id").select("id", "authority", "place")


def rerank_gate(spark: SparkSession, folder: str) -> DataFrame:
    """question, mode, rerank: which questions get a second stage."""
    questions = [(QUESTION, mode) for mode in ("auto", "fast", "code")] + [("retry worker", "auto"), ("retry worker", "code")]
    return spark.createDataFrame([(q, m, int(should_rerank(q, m, RERANKER))) for q, m in questions], "question string, mode string, rerank int")


_FUNCTIONS = (keyword_search, semantic_search, search_fast, search_code, flow_seeds, mixed_response, rerank_gate)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_STATED = f"sa as (select project, path, min(lower(trim(authority))) authority from ({_CUR.format(t='source_authority')}) group by all), au as (select c.*, coalesce(sa.authority, 'unknown') authority from cur c left join sa using (project, path)), se as (select * from au where authority in ('code','test','schema_history','generated','config'))"
_VEC = f"""v as (select chunk_id, arg_max(vector, embedded_at)::double[] vector from (select * from chunk_embeddings where model = '{MODEL}' and dimension = 64 and vector is not null and len(vector) = 64) e where {_VALID} group by chunk_id),
 q as (select vector from v order by chunk_id limit 1),
 vt as (select chunk_id id, round(list_dot_product(v.vector, q.vector) / sqrt(list_dot_product(v.vector, v.vector)) / sqrt(list_dot_product(q.vector, q.vector)), 5) score from v semi join se on v.chunk_id = se.id, q order by score desc, id limit 60)"""
_LX = "lx as (select id, round(score, 5) score from scored semi join se using (id) order by 2 desc, 1 limit 30)"
_BOTH = f"""{_BM25}, {_STATED}, {_LX}, {_VEC}, l as (select id, row_number() over (order by score desc, id) k from lx), m as (select id, row_number() over (order by score desc, id) k from vt),
 fz as (select coalesce(l.id, m.id) id, coalesce(1.0::double / (60 + l.k), 0) + coalesce(0.9::double / (60 + m.k), 0) fused from l full join m on l.id = m.id),
 hy as (select c.*, round(fused * {_multiplier_sql(authority='c.authority')}, 6) score from se c join fz using (id))"""
_DOC = "left('File: ' || path || chr(10) || coalesce(content, ''), 32000)"
ORACLE_SQL = {
    "keyword_search": f"with {_BM25}, {_STATED}, {_LX} select * from lx",
    "semantic_search": f"with {_BM25}, {_STATED}, {_VEC} select * from vt",
    "search_fast": f"with {_BOTH} select id, authority, score from hy order by score desc, id limit 24",
    "search_code": f"with {_BOTH}, t as (select * from hy order by score desc, id limit 60), d as (select *, {_frequency_sql(_DOC, TERMS)} f from t), r as (select *, row_number() over (order by score desc, id) b, row_number() over (order by f desc, id) s from d) select id, authority, round(0.25::double / (60 + b) + 0.75::double / (60 + s), 8) score from r",
    "flow_seeds": f"with {_BOTH}, t as (select * from hy order by score desc, id limit 60), g as (select project, path, max(score) score, min(authority) authority from t group by 1, 2), p as (select *, case when authority in ('code', 'schema_history') then 0 when authority = 'test' then 1 else 2 end part from g), n as (select *, row_number() over (partition by part order by score desc, project, path) place from p), z as (select project, path, row_number() over (order by case when part = 0 and place <= 8 then 0 when part = 1 and place <= 3 then 1 else 2 end, score desc, project, path) seed from n) select * from z where seed <= 14",
}
