"""Queries of a flow's further branches, roles, impact and diagnosis, and the whole investigation put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.code import affinity_terms
from quernstone.functions.text import query_terms
from quernstone.operators import trace
from quernstone.operators.classify import authority_of
from quernstone.operators.current import published_rows
from quernstone.operators.flow import files_of_flow, rank_flow, reasons
from quernstone.operators.graph import cache_key_audit, facet_coverage, lineage_of, reverse_dependencies_of
from quernstone.operators.mentions import all_mentions
from quernstone.plans.flow import _LINKS, _SEED, _seeds
from quernstone.plans.graph import _E, FACETS, RESOURCE, _current
from quernstone.plans.retrieval import _AUTHORITY, _CHUNKS, _CUR, QUESTION
from quernstone.session import cut
from quernstone.tables import table

ASKED = "Which writers create or cancel a booking through rpc functions, and which tests cover the retry worker?"
TERMS = affinity_terms(query_terms(ASKED))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "chunks").select("project", "path", "start_line", "end_line", "content", authority_of(F.col("path")).alias("authority"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_authority").select("project", "path").distinct()


def _writers(spark: SparkSession, folder: str) -> DataFrame:
    """Files that write the resource, as seeds."""
    edges = _current(spark, folder, "edges")
    return edges.where((F.col("target_name") == RESOURCE) & (F.col("relation") == "writes_table")).select("project", F.col("source_path").alias("path")).distinct()


def flow_walk(spark: SparkSession, folder: str) -> DataFrame:
    return trace.walk(_writers(spark, folder), _current(spark, folder, "edges"), _listed(spark, folder), TERMS)


def resource_callers(spark: SparkSession, folder: str) -> DataFrame:
    edges = _current(spark, folder, "edges")
    found = trace.resource_consumers(trace.resources_of(_writers(spark, folder), edges), edges)
    return found.select("project", "path", "score", "kind")


def overrides_by_content(spark: SparkSession, folder: str) -> DataFrame:
    edges = _current(spark, folder, "edges")
    scripts = _texts(spark, folder).where(F.col("path").endswith(".sql"))
    return trace.override_chain(trace.resources_of(_writers(spark, folder), edges), scripts).select("project", "path", "score", "kind")


def _functions(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "symbols").where("kind = 'function' and active = 1").select("project", F.coalesce("qualified_name", "name").alias("name"))


def _procedures(spark: SparkSession, folder: str) -> DataFrame:
    return _functions(spark, folder).where(F.col("name").contains("booking") | F.col("name").contains("Booking")).distinct()


def relevant_rpcs(spark: SparkSession, folder: str) -> DataFrame:
    return trace.relevant_procedures(_procedures(spark, folder), _current(spark, folder, "edges"), ["booking", "retry"])


def rpc_consumers(spark: SparkSession, folder: str) -> DataFrame:
    names = _procedures(spark, folder).select("project", F.element_at(F.split("name", r"\."), -1).alias("name"))
    return trace.consumers(names, _texts(spark, folder))


def name_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Where texts hold the names of their project's procedures, by file: all procedures, whatever they are called."""
    names = _functions(spark, folder).select("project", F.element_at(F.split("name", r"\."), -1).alias("name"))
    return all_mentions(published_rows(table(spark, folder, "chunks"), table(spark, folder, "repos")), names)


def _evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files of each project's flow with lane, authority, kinds and roles; the reasons of them)."""
    # The tables enter many branches: each is written once.
    edges, symbols, texts = cut(_current(spark, folder, "edges", "metadata")), cut(_current(spark, folder, "symbols")), cut(_texts(spark, folder))
    seeds = cut(_seeds(spark, folder))
    found = cut(trace.all_reasons(reasons(seeds, edges, symbols, texts, TERMS), seeds, edges, symbols, texts, _listed(spark, folder), TERMS))
    files = rank_flow(files_of_flow(found)).select("project", "path", "score", "lane", "place")
    kinds = found.groupBy("project", "path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    own = files.join(kinds, ["project", "path"]).withColumn("authority", authority_of(F.col("path")))
    evidence = cut(own.join(trace.file_roles(own, edges, ASKED), ["project", "path"]))
    return evidence, found.join(evidence.select("project", "path"), ["project", "path"], "left_semi")


def evidence_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of all files that hold edges."""
    edges = _current(spark, folder, "edges", "metadata")
    files = edges.select("project", F.col("source_path").alias("path")).distinct().withColumn("authority", authority_of(F.col("path")))
    return trace.file_roles(files, edges, ASKED)


def lane_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return trace.coverage(_evidence(spark, folder)[0], ASKED)


def impact_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return trace.impact(_evidence(spark, folder)[0], _texts(spark, folder))


def investigation(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's flow: its files with lane, kinds of reasons, roles and place."""
    return _evidence(spark, folder)[0]


def flow_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """The shape, warnings and quality of each project's flow."""
    evidence, found = _evidence(spark, folder)
    edges, symbols, chunks = cut(_current(spark, folder, "edges")), cut(_current(spark, folder, "symbols")), cut(_texts(spark, folder))
    names = cut(trace.relevant_procedures(_procedures(spark, folder), edges, ["booking", "retry"]))
    used = trace.consumers(names, chunks).groupBy("project").agg(F.count_distinct("path").alias("consumers"))
    lines = lineage_of(symbols, chunks, names)
    missing = names.join(lines.select("project", "name"), ["project", "name"], "left_anti").groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("lineage_missing"))
    entries = lines.groupBy("project").agg(F.count(F.lit(1)).alias("lineage_entries"))
    keys = cache_key_audit(chunks.join(evidence.select("project", "path"), ["project", "path"], "left_semi")).groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("uninvalidated_keys"))
    shared = reverse_dependencies_of(edges, symbols, names).where("source_active = 1").groupBy("project").agg(F.count_distinct("source_name").alias("shared_consumers"))
    facets = facet_coverage(chunks, FACETS).groupBy("project").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("files") == 0, F.col("facet")))), ",").alias("facets_missing"))
    flow = trace.coverage(evidence, ASKED)
    for one in (used, missing, entries, keys, shared, facets):
        flow = flow.join(one, "project", "left")
    return trace.diagnose(evidence, found, flow)


_FUNCTIONS = (flow_walk, resource_callers, overrides_by_content, relevant_rpcs, rpc_consumers, name_mentions, evidence_roles, lane_coverage, impact_candidates, investigation, flow_diagnosis)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_W = f"{_E}, sf as (select distinct project, source_path path from e where target_name = '{RESOURCE}' and relation = 'writes_table')"
_FLOW = "('calls','imports','calls_rpc','invokes_edge_function','reads_table','writes_table','accesses_table','extends','overrides')"
_IN = ", ".join(f"'{t}'" for t in TERMS)
_BARE = "regexp_replace(lower({x}), '^public\\.', '')"


def _step(depth: int, frontier: str) -> str:
    kind = "case when relation in ('extends', 'overrides') then 'inheritance_chain' else '{k}' end"
    return f"""og{depth} as (select fl.* from fl semi join {frontier} q on q.project = fl.project and q.path = fl.source_path),
     dp{depth} as (select distinct project, target_qualified_name t from og{depth} where relation = 'calls' and target_qualified_name is not null and lower(source_name) in ({_IN})),
     st{depth} as (select distinct og.project, pl.path, {78 - 8 * depth} score, 'resolved_edge_function' kind, {depth} depth, 'convention_verified' confidence from og{depth} og join pl on pl.project = og.project and pl.t = og.target_name where relation = 'invokes_edge_function' and target_path is null
      union all select distinct project, target_path, {62 - 12 * depth}, {kind.format(k='outgoing_edge')}, {depth}, resolution_confidence from og{depth} where target_path is not null and resolution_confidence <> 'unresolved'
      union all select distinct fl.project, source_path, {58 - 12 * depth}, case when relation = 'overrides' and dp{depth}.t is not null then 'dispatch_override_chain' else {kind.format(k='incoming_edge')} end, {depth}, resolution_confidence from fl semi join {frontier} q on q.project = fl.project and q.path = fl.target_path left join dp{depth} on dp{depth}.project = fl.project and dp{depth}.t = fl.target_qualified_name where resolution_confidence <> 'unresolved')"""


_WALK = f"""{_W}, fl as (select * from e where relation in {_FLOW}), pl as (select distinct project, path, regexp_extract(path, 'functions/([^/]+)/index\\.', 1) t from source_authority where regexp_matches(path, '(^|/)functions/[^/]+/index\\.(ts|js)$')),
 {_step(0, 'sf')}, f1 as (select distinct project, path from st0 anti join sf using (project, path)), {_step(1, 'f1')}, al as (select * from st0 union all select * from st1),
 bst as (select *, row_number() over (partition by project, path, kind order by score desc, depth, confidence desc) n from al)"""
_RES = f"{_W}, rs as (select distinct e.project, regexp_extract({_BARE.format(x='target_name')}, '[^.]*$') r from e semi join sf on sf.project = e.project and sf.path = e.source_path where relation in ('calls_rpc','reads_table','writes_table','accesses_table'))"
_PROC = "pr as (select distinct project, lower(regexp_extract(coalesce(qualified_name, name), '[^.]*$')) r from ({s}) s where kind = 'function' and active = 1 and (contains(coalesce(qualified_name, name), 'booking') or contains(coalesce(qualified_name, name), 'Booking')))".replace("{s}", "select distinct c.* from symbols c semi join repos p on c.project = p.project and c.generation_id = p.generation_id")
_EVERY_PROC = f"pr as (select distinct project, lower(regexp_extract(coalesce(qualified_name, name), '[^.]*$')) r from ({_CUR.format(t='symbols')}) s where kind = 'function' and active = 1)"
_MENTION = f"mn as (select cur.project, path, r as name, min(start_line) first_line, max(end_line) last_line from cur join pr on pr.project = cur.project and contains(lower(content), r) where content is not null and r <> '' group by all)"
_JSON = "case when json_valid(metadata) then json_extract_string(metadata, '$.operation') end"
ORACLE_SQL = {
    "flow_walk": f"with {_WALK} select project, path, score, kind, depth, confidence from bst where n = 1",
    "resource_callers": f"with {_RES} select distinct e.project, source_path path, 57 score, 'rpc_consumer' kind from e semi join rs on rs.project = e.project and rs.r = {_BARE.format(x='e.target_name')} where relation = 'calls_rpc'",
    "overrides_by_content": f"with {_CHUNKS}, {_RES}, m as (select cur.project, path, r, row_number() over (partition by cur.project, r order by path desc) k from (select distinct project, path, lower(content) content from cur where ends_with(path, '.sql') and content is not null and (contains(lower(content), 'pg_get_functiondef') or contains(lower(content), 'create or replace function'))) cur join rs on rs.project = cur.project and contains(content, r) where r <> '' group by cur.project, path, r) select distinct project, path, 72 score, 'sql_override_chain' kind from m where k <= 6",
    "relevant_rpcs": f"with {_E}, {_PROC}, sh as (select * from pr where contains(r, 'booking') or contains(r, 'retry')), wr as (select distinct e.project, regexp_extract(lower(source_name), '[^.]*$') r from e semi join sh on sh.project = e.project and sh.r = {_BARE.format(x='e.target_name')} where relation = 'calls_sql'), bo as (select * from sh union select * from wr where contains(r, 'booking') or contains(r, 'retry')), cd as (select distinct project, {_BARE.format(x='target_name')} r from e where relation = 'calls_rpc') select bo.project, bo.r as name from bo left join cd on cd.project = bo.project and cd.r = bo.r where starts_with(bo.r, 'get_') or cd.r is not null",
    "rpc_consumers": f"""with {_CHUNKS}, {_PROC}, {_MENTION}, ky as (select distinct project, path, unnest(regexp_extract_all(content, '(?i)queryKey\\s*:\\s*\\[\\s*[''"]([^''"]+)[''"]', 1)) k from cur), kk as (select project, path, string_agg(k, ',' order by k) keys from ky group by all) select mn.project, name, path, coalesce(keys, '') keys from mn left join kk using (project, path) where {_AUTHORITY.format(p='path')} = 'code'""",
    "name_mentions": f"with {_CHUNKS}, {_EVERY_PROC}, {_MENTION} select * from mn",
    "evidence_roles": f"with {_E}, fs as (select distinct project, source_path path from e), o as (select project, source_path path, bool_or(relation = 'writes_table' or (relation = 'accesses_table' and coalesce({_JSON} in ('update', 'into', 'delete from'), false))) w, bool_or(relation in ('reads_table', 'accesses_table')) r, bool_or(relation = 'calls_rpc') c from e where relation in ('calls_rpc','reads_table','writes_table','accesses_table') group by all) select project, path, concat_ws(',', case when regexp_matches(lower(path), 'absence|workflow|status') then 'lifecycle' end, case when r then 'readers' end, case when c then 'rpc' end, case when {_AUTHORITY.format(p='path')} = 'schema_history' then 'sql' end, case when {_AUTHORITY.format(p='path')} = 'test' then 'tests' end, case when w then 'writers' end) roles from fs left join o using (project, path)",
}
