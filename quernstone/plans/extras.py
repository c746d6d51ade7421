"""Queries of texts per file, of caches, of encoded graphs and of metadata; some on planted rows beside the tables' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.code import matched_terms, metadata_object, name_tokens
from quernstone.operators.atlas import batches_by_cost, encoded, ownership_errors, prefix_batches
from quernstone.operators.files import file_texts
from quernstone.operators.graph import cache_key_audit, query_keys
from quernstone.plans.flow import FLOW_TERMS
from quernstone.plans.graph import _COST, _E, _current
from quernstone.plans.retrieval import _CHUNKS

# Files that use and invalidate caches, which the tables hold none of.
PLANTED = (("planted", "src/hours.tsx", "useQuery({ queryKey: ['hours'] }); useQuery({ queryKey: ['rooms', id] });"), ("planted", "src/save.ts", "client.invalidateQueries({ queryKey: ['rooms'] });"), ("other", "src/a.ts", "queryKey: [\"hours\"]; invalidateQueries({queryKey:['hours']})"))


def _with_planted(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "chunks").select("project", "path", "content").unionByName(spark.createDataFrame(list(PLANTED), "project string, path string, content string"))


def cache_uses(spark: SparkSession, folder: str) -> DataFrame:
    return query_keys(_with_planted(spark, folder)).select("project", "path", "key", F.col("invalidated").cast("int").alias("invalidated"))


def stale_caches(spark: SparkSession, folder: str) -> DataFrame:
    return cache_key_audit(_with_planted(spark, folder))


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    return file_texts(_current(spark, folder, "chunks")).select("project", "path", "chunks", F.sha2("text", 256).alias("digest"))


def files_that_retry(spark: SparkSession, folder: str) -> DataFrame:
    """The files whose text as a whole speaks of retries and of timeouts."""
    low = F.lower("text")
    return file_texts(_current(spark, folder, "chunks")).where(low.contains("retry") & low.contains("publish")).select("project", "path")


def question_affinity(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the question's words each chunk or its path holds."""
    found = matched_terms(F.col("path"), F.col("content"), FLOW_TERMS)
    return _current(spark, folder, "chunks").select("id", F.array_join(found, ",").alias("terms")).where("terms <> ''")


def shared_name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """How many words an edge's target shares with its file's path."""
    edges = _current(spark, folder, "edges").where("target_name is not null and source_path is not null")
    return edges.select("id", F.size(F.array_intersect(name_tokens(F.col("target_name")), name_tokens(F.col("source_path")))).cast("bigint").alias("shared")).where("shared > 0")


def metadata_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata as canonical objects, and how many edges have each."""
    return _current(spark, folder, "edges", "metadata").groupBy(metadata_object(F.col("metadata")).alias("metadata")).agg(F.count(F.lit(1)).alias("edges"))


def encoded_atlas(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the encoded graph, their codes read back."""
    parts = encoded(_current(spark, folder, "edges"))
    groups = parts["groups"].select("project", "path", "name", F.size("edges").cast("bigint").alias("edges"), F.array_join(F.transform("edges", lambda e: e["relation"]), "").alias("r"))
    back = lambda df, column, codes: df.join(codes.select(F.col("code").alias(column), F.col("value").alias(f"{column}_text")), column, "left")
    return back(back(groups, "path", parts["paths"]), "name", parts["names"]).select("project", F.col("path_text").alias("path"), F.col("name_text").alias("name"), "edges")


def ownership_check(spark: SparkSession, folder: str) -> DataFrame:
    """What is reported of batches that lack the edges of one relation and hold those of another twice."""
    edges = _current(spark, folder, "edges")
    held = batches_by_cost(edges, 60_000, F.length("source_path") + F.length("target_name") + 20).join(edges.select("id", "relation"), "id")
    return ownership_errors(edges, held.where("relation <> 'extends'").unionByName(held.where("relation = 'overrides'")))


def prefix_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of each project's edges, each as full as its budget allows."""
    cost = F.length("source_path") + F.length("target_name") + 20
    return prefix_batches(_current(spark, folder, "edges"), 6_000, cost).groupBy("project", "batch").agg(F.count(F.lit(1)).alias("edges"), F.max("used").alias("used"))


_FUNCTIONS = (cache_uses, stale_caches, whole_texts, files_that_retry, question_affinity, shared_name_tokens, metadata_forms, encoded_atlas, ownership_check, prefix_packing)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_PLANTED = "pl as (select project, path, content from cur union all select * from (values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in PLANTED) + ") v(project, path, content))"
_KEYS = """u as (select distinct project, path, unnest(regexp_extract_all(content, '(?i)queryKey\\s*:\\s*\\[\\s*[''"]([^''"]+)[''"]', 1)) as key from pl), d as (select distinct project, path, unnest(regexp_extract_all(content, '(?i)invalidateQueries\\(\\s*\\{\\s*queryKey\\s*:\\s*\\[\\s*[''"]([^''"]+)[''"]', 1)) as key from pl)"""
_WHOLE = "w as (select project, path, count(*) chunks, string_agg(content, chr(10) order by start_line, id) t from cur where content is not null group by all)"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 2))"
_HELD = "list_filter([" + ", ".join(f"'{t}'" for t in sorted(FLOW_TERMS)) + "], lambda t: contains(lower(concat_ws(chr(10), path, content)), t))[:8]"
ORACLE_SQL = {
    "cache_uses": f"with {_CHUNKS}, {_PLANTED}, {_KEYS} select *, 0 invalidated from u union all select *, 1 from d",
    "stale_caches": f"with {_CHUNKS}, {_PLANTED}, {_KEYS} select distinct project, key from u anti join (select distinct project, key from d) x using (project, key)",
    "whole_texts": f"with {_CHUNKS}, {_WHOLE} select project, path, chunks, sha256(t) digest from w",
    "files_that_retry": f"with {_CHUNKS}, {_WHOLE} select project, path from w where contains(lower(t), 'retry') and contains(lower(t), 'publish')",
    "question_affinity": f"with {_CHUNKS}, x as (select id, array_to_string({_HELD}, ',') terms from cur) select * from x where terms <> ''",
    "shared_name_tokens": f"with {_E}, x as (select id, len(list_intersect({_TOKENS.format(x='target_name')}, {_TOKENS.format(x='source_path')}))::bigint as shared from e where target_name is not null and source_path is not null) select * from x where shared > 0",
    "encoded_atlas": f"with {_E} select project, source_path path, coalesce(source_qualified_name, source_name) as name, count(*) edges from e group by all",
    "ownership_check": f"with {_E} select distinct id, case when relation = 'extends' then 0 else 2 end::bigint times from e where relation in ('extends', 'overrides')",
    "prefix_packing": f"""with recursive {_E}, rw as (select id, min(project) project, min(source_path) source_path, min(coalesce(source_qualified_name, '')) src, min({_COST}) cost from e group by id),
     nr as (select project, cost, row_number() over (partition by project order by source_path, src, id) n from rw), wk as (select project, n, cost used, 0::bigint batch from nr where n = 1 union all
     select nr.project, nr.n, case when wk.used + nr.cost > 6000 then nr.cost else wk.used + nr.cost end, wk.batch + (wk.used + nr.cost > 6000)::int from wk join nr on nr.project = wk.project and nr.n = wk.n + 1)
     select project, batch, count(*) edges, max(used)::bigint used from wk group by 1, 2""",
}
