"""Queries of the graph, of publishing and of the atlas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.atlas import batches_by_cost, dictionary, merge_claims, skeleton
from quernstone.operators.classify import authority_of
from quernstone.operators.current import current_rows
from quernstone.operators.graph import (
    anchor_calls,
    callee_hints,
    callers_with_chunks,
    contract_differences,
    covering_symbols,
    dependency_levels,
    expand,
    facet_coverage,
    file_neighbours,
    lane_of,
    latest_definitions,
    lineage,
    lookup,
    operation_edges,
    resolve_targets,
    reverse_dependencies,
    shared_resources,
)
from quernstone.operators.publish import deduplicated_evidence, file_digests, generation_uniformity, publish_diff, purge_counts
from quernstone.operators.results import similar_names
from quernstone.plans.retrieval import _CHUNKS, _CUR, _LANE
from quernstone.tables import LIGHT, table

CALLEE, RESOURCE, NAME, OPERATIONS = "hasQuota", "validate", "publish", ("insert", "update", "upsert", "delete")
FACETS = {"costs": ("cost", "coste", "kosten"), "overtime": ("overtime", "überstunden"), "coverage": ("coverage", "cobertura"), "shifts": ("shift", "turno", "schicht"), "quotas": ("quota", "cuota"), "vouchers": ("voucher",)}


def _current(spark: SparkSession, folder: str, name: str, *more: str) -> DataFrame:
    """Current rows of a table; of graph tables the light columns and those named."""
    return current_rows(table(spark, folder, name), table(spark, folder, "repos"), (*LIGHT[name], *more) if name in LIGHT else ())


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Files that write the tables named by the resource, as anchors of a flow."""
    return _current(spark, folder, "edges").where((F.col("target_name") == RESOURCE) & (F.col("relation") == "writes_table")).select("project", F.col("source_path").alias("path")).distinct()


def relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    edges = _current(spark, folder, "edges")
    return edges.groupBy("relation", "resolution_confidence").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("project").alias("projects"))


def latest_definition(spark: SparkSession, folder: str) -> DataFrame:
    return latest_definitions(_current(spark, folder, "symbols"), "db/migrations/").select("id", "project", "name", "active")


def superseded_counts(spark: SparkSession, folder: str) -> DataFrame:
    return latest_definition(spark, folder).groupBy("project").agg(F.count_if(F.col("active") == 0).alias("superseded"), F.count_if(F.col("active") == 1).alias("latest"))


def resolved_targets(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_targets(_current(spark, folder, "edges"), _current(spark, folder, "symbols"))


def covering_symbol(spark: SparkSession, folder: str) -> DataFrame:
    spans = _current(spark, folder, "chunks").select(F.col("id").alias("span_id"), "project", "path", "start_line", "end_line")
    return covering_symbols(spans, _current(spark, folder, "symbols")).select("span_id", "symbol_id", "overlap")


def range_join_callers(spark: SparkSession, folder: str) -> DataFrame:
    return callers_with_chunks(_current(spark, folder, "edges"), _current(spark, folder, "chunks"), CALLEE)


def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return lookup(_current(spark, folder, "symbols"), _current(spark, folder, "source_authority").groupBy("project", "path").agg(F.min(F.lower(F.trim("authority"))).alias("authority")), NAME, 20)


def fuzzy_suggest(spark: SparkSession, folder: str) -> DataFrame:
    return similar_names(_current(spark, folder, "symbols"), "publishLok")


def incident_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = file_neighbours(_current(spark, folder, "edges"))
    return links.groupBy("project", "path").agg(F.count_if("outgoing").alias("outgoing"), F.count_if(~F.col("outgoing")).alias("incoming"))


def two_hop_expand(spark: SparkSession, folder: str) -> DataFrame:
    return expand(_seeds(spark, folder), _current(spark, folder, "edges"))


def shared_resource(spark: SparkSession, folder: str) -> DataFrame:
    return shared_resources(_seeds(spark, folder), _current(spark, folder, "edges"))


def reverse_callee_hints(spark: SparkSession, folder: str) -> DataFrame:
    return callee_hints(_current(spark, folder, "edges"), 2, 40)


def anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = anchor_calls(_current(spark, folder, "edges"), _current(spark, folder, "symbols"))
    return found.select("symbol_id", "name", F.array_join("callees", ",").alias("callees"))


def contract_diff(spark: SparkSession, folder: str) -> DataFrame:
    return contract_differences(_current(spark, folder, "edges"))


def sql_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return lineage(_current(spark, folder, "symbols"), _current(spark, folder, "chunks"), "invoice")


def dependency_map(spark: SparkSession, folder: str) -> DataFrame:
    roots = _current(spark, folder, "edges").where((F.col("relation") == "writes_table") & (F.col("target_name") == RESOURCE)).select("project", F.col("source_name").alias("name"))
    return dependency_levels(_current(spark, folder, "edges"), roots)


def reverse_dependency_map(spark: SparkSession, folder: str) -> DataFrame:
    return reverse_dependencies(_current(spark, folder, "edges"), _current(spark, folder, "symbols"), CALLEE.lower())


def operations(spark: SparkSession, folder: str) -> DataFrame:
    return operation_edges(_current(spark, folder, "edges", "metadata"), OPERATIONS).groupBy("project", "target_name").agg(F.count(F.lit(1)).alias("writes"))


def metadata_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges hold valid JSON metadata; what is no JSON counts as raw text."""
    valid = F.try_parse_json("metadata").isNotNull()
    return _current(spark, folder, "edges", "metadata").groupBy(F.when(F.col("metadata").isNull(), "none").when(valid, "json").otherwise("raw").alias("form")).agg(F.count(F.lit(1)).alias("edges"))


def facets(spark: SparkSession, folder: str) -> DataFrame:
    return facet_coverage(_current(spark, folder, "chunks"), FACETS)


def constraint_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Scripts with constraints, and how many of them each holds (3 count at most) as a score."""
    scripts = _current(spark, folder, "chunks").where(F.col("path").endswith(".sql") & F.col("content").isNotNull())
    low = F.lower("content")
    mentions = F.least(F.lit(3), F.regexp_count(low, F.lit(r"unique index|exclude using|check \(|foreign key|references")))
    return scripts.groupBy("project", "path").agg((54 + 2 * F.max(mentions)).cast("bigint").alias("score"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).where("score > 54")


def lane_role_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lanes of the files that a flow reaches."""
    reached = two_hop_expand(spark, folder)
    return reached.groupBy("project", lane_of(F.col("path"), authority_of(F.col("path"))).alias("lane")).agg(F.count(F.lit(1)).alias("files"), F.max("score").cast("bigint").alias("best"))


def retrieval_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    """Per project: evidence, the share of its dominant lane, lanes present, warnings and the verdict on the flow."""
    lanes = lane_role_counts(spark, folder)
    shape = lanes.groupBy("project").agg(F.sum("files").alias("total"), F.max("files").alias("dominant"), F.count(F.lit(1)).alias("lanes"), F.sum(F.when(F.col("lane") == "tests", F.col("files")).otherwise(0)).alias("tests"))
    ratio = F.round(F.col("dominant") / F.col("total"), 3)
    missing = F.when(F.col("lanes") < 2, 1).otherwise(0)
    warnings = F.concat_ws(",", F.when((ratio >= 0.6) & (F.col("total") >= 5), "lane_concentration"), F.when((F.col("tests") >= 2) & (F.col("tests") == F.col("total")), "test_anchor_dominance"), F.when(F.col("lanes") == 1, "thin_role_coverage"))
    return shape.select("project", "total", ratio.alias("dominant_ratio"), "lanes", warnings.alias("warnings"), F.when((missing == 1) & (F.col("total") < 2), "weak").when(F.length(warnings) > 0, "review").otherwise("healthy").alias("quality"))


def generation_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Stored chunk rows against the published ones: per project what a refresh keeps, inserts and deletes."""
    diff = publish_diff(table(spark, folder, "chunks"), _current(spark, folder, "chunks"))
    return diff.groupBy("project", "change").agg(F.count(F.lit(1)).alias("rows"))


def uniformity(spark: SparkSession, folder: str) -> DataFrame:
    return generation_uniformity({n: table(spark, folder, n) for n in ("chunks", "source_authority", "symbols", "edges")})


def purge(spark: SparkSession, folder: str) -> DataFrame:
    """What purging the project with the most chunk rows would remove."""
    largest = table(spark, folder, "chunks").groupBy("project").count().orderBy(F.desc("count"), "project").limit(1).first()
    return purge_counts({n: table(spark, folder, n) for n in ("repos", "chunks", "source_authority", "symbols", "edges")}, largest["project"] if largest else "")


def content_digest(spark: SparkSession, folder: str) -> DataFrame:
    return file_digests(_current(spark, folder, "chunks"))


def evidence_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated_evidence(table(spark, folder, "chunks"))


def atlas_skeleton(spark: SparkSession, folder: str) -> DataFrame:
    return skeleton(_current(spark, folder, "edges"))


def atlas_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary(_current(spark, folder, "edges"), "source_path", "P")


def atlas_batches(spark: SparkSession, folder: str) -> DataFrame:
    cost = F.length("source_path") + F.length("target_name") + 20
    return batches_by_cost(_current(spark, folder, "edges"), 60_000, cost).groupBy("project", "batch").agg(F.count(F.lit(1)).alias("edges"))


def claim_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Files' authority statements as claims: that a file is generated, supported or refuted by its rows."""
    rows = table(spark, folder, "source_authority").where("project is not null and path is not null")
    support = F.when(F.col("authority").isNull(), "unknown").when(F.lower(F.trim("authority")) == "generated", "support").otherwise("refute")
    claims = rows.select(F.hash("generation_id").alias("at"), F.concat_ws("/", "project", "path").alias("text"), F.lit("generated").alias("kind"), support.alias("support"), "reason")
    order = F.concat_ws("|", "support", F.coalesce("reason", F.lit("")))
    return merge_claims(claims.withColumn("at", order).withColumn("evidence", F.coalesce("reason", F.lit(""))))


_FUNCTIONS = (
    relation_counts, latest_definition, superseded_counts, resolved_targets, covering_symbol, range_join_callers, symbol_lookup, fuzzy_suggest, incident_edges, two_hop_expand, shared_resource, reverse_callee_hints, anchors, contract_diff,
    sql_lineage, dependency_map, reverse_dependency_map, operations, metadata_kinds, facets, constraint_candidates, lane_role_counts, retrieval_diagnostic, generation_diff, uniformity, purge, content_digest, evidence_dedupe,
    atlas_skeleton, atlas_dictionary, atlas_batches, claim_merge,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_E = f"e as ({_CUR.format(t='edges')})"
_S = f"s as ({_CUR.format(t='symbols')})"
_FLOW = "('calls','imports','calls_rpc','invokes_edge_function','reads_table','writes_table','accesses_table','extends','overrides')"
_LINKS = f"{_E}, lk as (select distinct project, source_path, target_path from e where relation in {_FLOW} and target_path is not null and resolution_confidence <> 'unresolved' and target_path <> source_path), nb as (select project, source_path path, target_path other, true o from lk union all select project, target_path, source_path, false from lk)"
_SEEDS = f"sd as (select distinct project, source_path path from e where target_name = '{RESOURCE}' and relation = 'writes_table')"
_HOPS = f"{_LINKS}, {_SEEDS}, h1 as (select project, other path, max(case when o then 62 else 58 end) score from sd join nb using (project, path) where (project, other) not in (select (project, path) from sd) group by all), h2 as (select h1.project, other path, max(case when o then 50 else 46 end) score from h1 join nb using (project, path) where (h1.project, other) not in (select (project, path) from sd) and (h1.project, other) not in (select (project, path) from h1) group by all), hops as (select project, path, 100 score from sd union all select * from h1 union all select * from h2)"
_LATEST = f"{_S}, lt as (select id, project, name, (row_number() over (partition by project, lower(name) order by path desc, id desc) = 1)::int active from s where starts_with(path, 'db/migrations/') and kind <> 'table')"
_COST = "(length(source_path) + length(target_name) + 20)"
_BATCHES = f"{_E}, rw as (select id, min(project) project, min(source_path) source_path, min(coalesce(source_qualified_name, '')) src, min({_COST}) cost from e group by id), bt as (select id, project, ((sum(cost) over (partition by project order by source_path, src, id rows unbounded preceding) - 1) // 60000)::bigint batch from rw)"
_RV = f"bare_uses as (select project, source_path, source_name, count(*) calls from e where regexp_replace(lower(target_name), '^public\\.', '') = '{CALLEE.lower()}' group by all)"
ORACLE_SQL = {
    "relation_counts": f"with {_E} select relation, resolution_confidence, count(*) edges, count(distinct project) projects from e group by 1, 2",
    "latest_definition": f"with {_LATEST} select * from lt",
    "superseded_counts": f"with {_LATEST} select project, count(*) filter (active = 0) superseded, count(*) filter (active = 1) latest from lt group by project",
    "resolved_targets": f"with {_E}, {_S}, k as (select distinct id, project, path, unnest([lower(name), lower(qualified_name), regexp_extract(lower(qualified_name), '[^.]*$')]) k from s where kind = 'function' and active = 1), u as (select project, k, min(path) f from k group by all having count(distinct path) = 1), o as (select id, project, lower(target_name) k, regexp_replace(lower(target_name), '^public\\.', '') b, resolution_confidence c from e where relation in ('calls_rpc', 'calls_sql') and target_path is null) select id, coalesce(u1.f, u2.f) target_path, case when coalesce(u1.f, u2.f) is not null then 'active_sql' else c end resolution_confidence from o left join u u1 on u1.project = o.project and u1.k = o.k left join u u2 on u2.project = o.project and u2.k = o.b",
    "covering_symbol": f"with {_CHUNKS}, {_S}, j as (select c.id span_id, s.id symbol_id, least(s.end_line, c.end_line) - greatest(s.start_line, c.start_line) + 1 overlap, s.end_line - s.start_line size, s.start_line sl from cur c join s on c.project = s.project and c.path = s.path and s.start_line <= c.end_line and s.end_line >= c.start_line where s.kind <> 'module'), r as (select *, row_number() over (partition by span_id order by overlap desc, size, sl, symbol_id) n from j) select span_id, symbol_id, overlap::bigint overlap from r where n = 1",
    "range_join_callers": f"with {_CHUNKS}, {_E} select e.id edge_id, c.id chunk_id from e join cur c on c.project = e.project and c.path = e.source_path and e.line between c.start_line and c.end_line where relation = 'calls' and target_name = '{CALLEE}' and resolution_confidence <> 'unresolved'",
    "symbol_lookup": f"with {_S}, a as (select project, path, min(lower(trim(authority))) authority from ({_CUR.format(t='source_authority')}) group by all) select id, s.project, s.path, kind, name, case when lower(qualified_name) = '{NAME}' then 0 when lower(name) = '{NAME}' then 1 when starts_with(lower(name), '{NAME}') then 2 else 3 end match_rank, coalesce(authority, 'unknown') authority from s left join a using (project, path) where contains(lower(name), '{NAME}') or contains(lower(qualified_name), '{NAME}') order by match_rank, active desc, project, path, start_line, id limit 20",
    "incident_edges": f"with {_LINKS} select project, path, count(*) filter (o) outgoing, count(*) filter (not o) incoming from nb group by all",
    "two_hop_expand": f"with {_HOPS} select project, path, score from hops",
    "shared_resource": f"with {_E}, {_SEEDS}, us as (select distinct project, source_path path, regexp_replace(lower(target_name), '^public\\.', '') r from e where relation in ('calls_rpc','reads_table','writes_table','accesses_table')), w as (select distinct us.project, r from us semi join sd on us.project = sd.project and us.path = sd.path) select us.project, us.path, count(*) resources from us semi join w on us.project = w.project and us.r = w.r anti join sd on us.project = sd.project and us.path = sd.path group by all",
    "reverse_callee_hints": f"with {_E}, p as (select project, target_name, target_path, source_path, count(*) n from e where relation = 'calls' and target_path is not null and resolution_confidence <> 'unresolved' group by all), h as (select project, target_name, target_path, count(*) callers, min(source_path) first_caller, sum(n)::bigint calls from p group by 1, 2, 3) select * from h where callers >= 2 order by callers desc, calls desc, project, target_name, target_path limit 40",
    "anchors": f"with {_E}, {_S}, o as (select distinct s.id symbol_id, name, e.target_name from s join e on e.project = s.project and e.source_path = s.path and e.line between s.start_line and s.end_line where kind in ('function', 'method', 'hook', 'component') and relation = 'calls' and e.target_name is not null) select symbol_id, name, string_agg(target_name, ',' order by target_name) callees from o group by 1, 2 having count(*) >= 2",
    "contract_diff": f"with {_E}, k as (select distinct project, source_path, source_qualified_name q, target_name t from e where relation = 'calls' and regexp_matches(target_name, '^(?:is|has|can|supports|accepts|allows|validates?)(?:[A-Z0-9_]|$)') and source_qualified_name is not null), z as (select project, source_path, q, list(t order by t) n from k group by all), j as (select l.project, l.source_path, l.q lq, r.q rq, l.n ln, r.n rn from z l join z r on l.project = r.project and l.source_path = r.source_path and l.q < r.q where len(list_intersect(l.n, r.n)) > 0 and l.n <> r.n) select project, source_path, lq left_source, rq right_source, array_to_string(list_sort(list_intersect(ln, rn)), ',') shared, array_to_string(list_sort(list_filter(ln, lambda x: not list_contains(rn, x))), ',') only_left, array_to_string(list_sort(list_filter(rn, lambda x: not list_contains(ln, x))), ',') only_right from j",
    "sql_lineage": f"with {_CHUNKS}, {_S}, d as (select project, path, min(start_line) first_line, max(end_line) last_line from s where lower(name) = 'invoice' group by all), p as (select project, path, min(start_line) first_line, max(end_line) last_line from cur where ends_with(path, '.sql') and contains(lower(content), 'invoice') group by all) select project, path, 'definition' kind, first_line, last_line from d union all select project, path, 'dynamic_patch', first_line, last_line from p anti join d using (project, path)",
    "dependency_map": f"with {_E}, c as (select distinct project, source_name n, target_name x from e where relation in ('calls', 'calls_sql', 'calls_rpc') and source_name is not null and target_name is not null), r as (select distinct project, source_name n from e where relation = 'writes_table' and target_name = '{RESOURCE}'), l1 as (select distinct project, x n from r join c using (project, n) where (project, x) not in (select (project, n) from r where n is not null)), l2 as (select distinct l1.project, x n from l1 join c using (project, n) where (l1.project, x) not in (select (project, n) from r where n is not null) and (l1.project, x) not in (select (project, n) from l1)) select project, n as name, 0 as level from r union all select project, n, 1 from l1 union all select project, n, 2 from l2",
    "reverse_dependency_map": f"with {_E}, {_S}, {_RV} select u.*, coalesce(a.f, 0) source_active from bare_uses u left join (select distinct project, path source_path, name source_name, 1 f from s where active = 1) a using (project, source_path, source_name)",
    "operations": f"with {_E} select project, target_name, count(*) writes from e where case when json_valid(metadata) then json_extract_string(metadata, '$.operation') end in {OPERATIONS!r} group by all",
    "metadata_kinds": f"with {_E} select case when metadata is null then 'none' when json_valid(metadata) then 'json' else 'raw' end form, count(*) edges from e group by 1",
    "facets": f"with {_CHUNKS}, f as (select project, path, " + ", ".join(f"bool_or(coalesce({' or '.join(f"contains(lower(content), '{w}')" for w in words)}, false)) {n}" for n, words in FACETS.items()) + " from cur group by all) " + " union all ".join(f"select project, '{n}' facet, count(*) filter ({n}) files from f group by project" for n in FACETS),
    "constraint_candidates": f"with {_CHUNKS}, x as (select project, path, max(54 + 2 * least(3, len(regexp_extract_all(lower(content), 'unique index|exclude using|check \\(|foreign key|references'))))::bigint score, min(start_line) first_line, max(end_line) last_line from cur where ends_with(path, '.sql') and content is not null group by all) select * from x where score > 54",
    "lane_role_counts": f"with {_HOPS} select project, {_LANE} lane, count(*) files, max(score)::bigint best from hops group by 1, 2",
    "retrieval_diagnostic": f"with {_HOPS}, l as (select project, {_LANE} lane, count(*) files from hops group by 1, 2), g as (select project, sum(files)::bigint total, max(files) dominant, count(*) lanes, sum(case when lane = 'tests' then files else 0 end) tests from l group by 1), w as (select *, round(dominant / total, 3) ratio from g), v as (select *, concat_ws(',', case when ratio >= 0.6 and total >= 5 then 'lane_concentration' end, case when tests >= 2 and tests = total then 'test_anchor_dominance' end, case when lanes = 1 then 'thin_role_coverage' end) warnings from w) select project, total, ratio dominant_ratio, lanes, warnings, case when lanes < 2 and total < 2 then 'weak' when length(warnings) > 0 then 'review' else 'healthy' end quality from v",
    "generation_diff": f"with {_CHUNKS}, o as (select project, path, start_line, end_line, content, count(*) n from chunks group by all), w as (select project, path, start_line, end_line, content, count(*) n from cur group by all), j as (select coalesce(o.project, w.project) project, coalesce(o.n, 0) a, coalesce(w.n, 0) b from o full join w on o.project is not distinct from w.project and o.path is not distinct from w.path and o.start_line is not distinct from w.start_line and o.end_line is not distinct from w.end_line and o.content is not distinct from w.content), k as (select project, 'kept' change, sum(least(a, b)) n from j group by 1 union all select project, 'deleted', sum(greatest(a - b, 0)) from j group by 1 union all select project, 'inserted', sum(greatest(b - a, 0)) from j group by 1) select project, change, n::bigint as rows from k where n > 0",
    "uniformity": " union all ".join(f"select '{n}' source, project, count(distinct generation_id) generations, (count(distinct generation_id) = 1)::int uniform from {n} group by project" for n in ("chunks", "source_authority", "symbols", "edges")),
    "purge": "with p as (select project from chunks group by project order by count(*) desc, project limit 1) " + " union all ".join(f"select '{n}' source, count(*) removed from {n} where project = (select project from p)" for n in ("repos", "chunks", "source_authority", "symbols", "edges")),
    "content_digest": f"with {_CHUNKS}, h as (select distinct project, path, start_line, sha256(content) h from cur where content is not null) select project, path, sha256(string_agg(h, '' order by start_line, h)) digest from h group by all",
    "evidence_dedupe": "select 'V' || left(sha256(content), 16) evidence_id, count(*) copies, min(id) first_id, max(strlen(content))::bigint as bytes from chunks where content is not null group by 1",
    "atlas_skeleton": f"with {_E}, o as (select id, min(project) project, min(source_path) source_path, min(relation) relation from e group by id) select project, source_path, relation, count(*) edges from o group by 1, 2, 3",
    "atlas_dictionary": f"with {_E}, v as (select distinct source_path as value from e where source_path is not null) select value, 'P' || lower(to_base(row_number() over (order by value) - 1, 36)) code from v",
    "atlas_batches": f"with {_BATCHES} select project, batch, count(*) edges from bt group by all",
    "claim_merge": "with c as (select concat_ws('/', project, path) t, case when authority is null then 'unknown' when lower(trim(authority)) = 'generated' then 'support' else 'refute' end s, coalesce(reason, '') r from source_authority where project is not null and path is not null) select 'C' || left(sha256(t || chr(31) || 'generated'), 16) claim_id, coalesce(arg_min(case when s <> 'unknown' then s end, case when s <> 'unknown' then concat_ws('|', s, r) end), 'unknown') support, count(distinct r) evidence, (count(distinct case when s <> 'unknown' then s end) > 1)::int contradicted from c group by t",
}
