"""Queries of the flow, of symbol views, of embedding caches and of text rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.code import affinity, affinity_terms, citation, embedding_document, name_words
from quernstone.operators.classify import authority_of, is_searchable
from quernstone.operators.flow import KIND_SLOTS, LANE_CAPS, files_of_flow, rank_flow, reasons, structural_neighbours
from quernstone.operators.graph import lane_of
from quernstone.operators.ledger import numbered, read_ranges
from quernstone.operators.lexical import bm25
from quernstone.operators.results import per_group
from quernstone.plans.graph import _E, _LINKS, _S, NAME, RESOURCE, _current
from quernstone.plans.retrieval import _AUTHORITY, _BM25, _CHUNKS, _LANE, _SEARCHABLE, TERMS, _published
from quernstone.tables import table

FLOW_TERMS = affinity_terms(TERMS)


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Each project's three best files by the question, with their rank."""
    chunks = _current(spark, folder, "chunks")
    hits = bm25(_published(spark, folder), TERMS).withColumn("score", F.round("score", 5)).join(chunks.select("id", "project", "path"), "id")
    best = hits.groupBy("project", "path").agg(F.max("score").alias("score"))
    return per_group(best, "project", 3, "path").select("project", "path", (F.col("place") - 1).alias("rank"))


def flow_reasons(spark: SparkSession, folder: str) -> DataFrame:
    found = reasons(_seeds(spark, folder), _current(spark, folder, "edges"), _current(spark, folder, "symbols"), _current(spark, folder, "chunks"), FLOW_TERMS)
    return found.groupBy("kind").agg(F.count_distinct("project", "path").alias("files"), F.max("score").cast("bigint").alias("best"))


def flow_files(spark: SparkSession, folder: str) -> DataFrame:
    return files_of_flow(reasons(_seeds(spark, folder), _current(spark, folder, "edges"), _current(spark, folder, "symbols"), _current(spark, folder, "chunks"), FLOW_TERMS))


def flow_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return rank_flow(flow_files(spark, folder))


def neighbours_of_hits(spark: SparkSession, folder: str) -> DataFrame:
    return structural_neighbours(_seeds(spark, folder), _current(spark, folder, "edges"))


def symbol_view(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships of the symbols of a name, each direction's distinct ones counted."""
    edges = _current(spark, folder, "edges")
    own = F.lower("source_name") == NAME
    to = F.lower("target_name") == NAME
    out = edges.where(own).select("project", F.lit("outgoing").alias("direction"), "relation", F.col("target_name").alias("other"))
    into = edges.where(to).select("project", F.lit("incoming").alias("direction"), "relation", F.col("source_name").alias("other"))
    return out.unionByName(into).groupBy("project", "direction", "relation").agg(F.count_distinct("other").alias("others"), F.count(F.lit(1)).alias("edges"))


def name_homonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Names that several files of a project define."""
    return _current(spark, folder, "symbols").where("kind <> 'module'").groupBy("project", "name").agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("symbols")).where("files > 1")


def seed_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols whose names and paths share the most words with the question."""
    symbols = _current(spark, folder, "symbols").select("id", "project", "path", "name")
    terms = F.array(*[F.lit(t) for t in FLOW_TERMS])
    score = 3 * F.size(F.array_intersect(F.array_distinct(name_words(F.col("name"))), terms)) + affinity(F.col("path"), FLOW_TERMS)
    return symbols.withColumn("score", score.cast("bigint")).where("score > 0").orderBy(F.desc("score"), "project", "path", "id").limit(24)


def path_affinity(spark: SparkSession, folder: str) -> DataFrame:
    paths = _current(spark, folder, "chunks").select("project", "path").distinct()
    return paths.select("project", "path", affinity(F.col("path"), FLOW_TERMS).cast("bigint").alias("terms")).where("terms > 0")


def embedding_documents(spark: SparkSession, folder: str) -> DataFrame:
    """What is embedded, by hash: equal documents need one vector."""
    docs = _current(spark, folder, "chunks").where("content is not null").select(F.sha2(embedding_document(F.col("project"), F.col("path"), F.col("content")), 256).alias("document_hash"), "id")
    return docs.groupBy("document_hash").agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"))


def embedding_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The vector that stands for each chunk after all deliveries: the last one."""
    rows = table(spark, folder, "chunk_embeddings").where("chunk_id is not null")
    last = rows.groupBy("chunk_id").agg(F.max(F.struct("embedded_at", "model", "dimension")).alias("m"), F.count(F.lit(1)).alias("deliveries"))
    return last.select("chunk_id", "m.model", "m.dimension", "deliveries")


def vector_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """Contents that have no vector of any chunk with the same content yet."""
    chunks = _current(spark, folder, "chunks").where("content is not null").select("id", F.sha2("content", 256).alias("content_hash"))
    have = chunks.join(table(spark, folder, "chunk_embeddings").where("vector is not null").select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").select("content_hash")
    return chunks.join(have.distinct(), "content_hash", "left_anti").groupBy("content_hash").agg(F.count(F.lit(1)).alias("chunks"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder, "chunks").where(is_searchable(authority_of(F.col("path"))))
    return chunks.select("id", citation(F.col("project"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation"))


def symbol_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The source of each symbol, numbered, out of all windows that hold lines of it; by hash and length."""
    symbols = _current(spark, folder, "symbols").where("kind <> 'module'").select(F.col("id").alias("symbol_id"), "project", "path", "start_line", "end_line")
    read = read_ranges(symbols, _current(spark, folder, "chunks"), "symbol_id")
    text = numbered(F.col("content"), F.col("first_line"))
    return read.select("symbol_id", F.length(text).cast("bigint").alias("characters"), F.sha2(text, 256).alias("digest"), "missing")


def graph_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines that describe the symbols and edges of files that write a resource."""
    edges = _current(spark, folder, "edges")
    files = edges.where((F.col("target_name") == RESOURCE) & (F.col("relation") == "writes_table")).select("project", F.col("source_path").alias("path")).distinct()
    symbols = _current(spark, folder, "symbols").join(files, ["project", "path"], "left_semi")
    line = F.concat_ws(" ", F.lit("SYMBOL"), "kind", "qualified_name", F.concat_ws(":", "path", F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))))
    own = edges.withColumnRenamed("source_path", "path").join(files, ["project", "path"], "left_semi")
    link = F.concat_ws(" ", F.lit("EDGE"), "source_name", F.concat(F.lit("-["), F.col("relation"), F.lit("]->")), "target_name", F.concat_ws(":", "path", F.col("line").cast("string")))
    return symbols.select("id", line.alias("line")).unionByName(own.select("id", link.alias("line")))


def anchor_authorities(spark: SparkSession, folder: str) -> DataFrame:
    """How seeds spread over authorities and lanes, with the share of the largest."""
    seeds = _seeds(spark, folder)
    authority = authority_of(F.col("path"))
    counts = seeds.groupBy(authority.alias("authority"), lane_of(F.col("path"), authority).alias("lane")).agg(F.count(F.lit(1)).alias("seeds"))
    total = counts.agg(F.sum("seeds").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("authority", "lane", "seeds", F.round(F.col("seeds") / F.col("total"), 4).alias("share"))  # one row


_FUNCTIONS = (
    flow_reasons, flow_files, flow_ranked, neighbours_of_hits, symbol_view, name_homonyms, seed_symbols, path_affinity, embedding_documents, embedding_upserts, vector_cache_misses, citations, symbol_excerpts, graph_lines,
    anchor_authorities,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_AFF = " + ".join(f"contains(lower(path), '{t}')::int" for t in FLOW_TERMS)
_BARE = "regexp_replace(lower({x}), '^public\\.', '')"
_SEED = f"{_BM25}, sb as (select project, path, max(round(score, 5)) score from scored join cur using (id) group by all), sk as (select project, path, row_number() over (partition by project order by score desc, path) - 1 rank from sb), seeds as (select * from sk where rank < 3), sf as (select distinct project, path from seeds), sp as (select distinct project from seeds)"
_REASONS = f"""{_SEED}, {_LINKS}, sy {_S[2:]},
 h1 as (select sf.project, other path, max(case when o then 62 else 58 end) score from sf join nb using (project, path) where (sf.project, other) not in (select (project, path) from sf) group by all),
 h2 as (select h1.project, other path, max(case when o then 50 else 46 end) score from h1 join nb using (project, path) where (h1.project, other) not in (select (project, path) from sf) and (h1.project, other) not in (select (project, path) from h1) group by all),
 us as (select distinct project, source_path path, {_BARE.format(x='target_name')} r from e where relation in ('calls_rpc','reads_table','writes_table','accesses_table')),
 wn as (select distinct us.project, r from us semi join sf on us.project = sf.project and us.path = sf.path),
 nm as (select distinct sy.project, {_BARE.format(x='name')} n from sy semi join sf on sy.project = sf.project and sy.path = sf.path where kind = 'function'),
 ky as (select project, path, unnest(regexp_extract_all(content, '(?i)queryKey\\s*:\\s*\\[\\s*[''"]([^''"]+)[''"]', 1)) k from cur), dy as (select distinct project, path, unnest(regexp_extract_all(content, '(?i)invalidateQueries\\(\\s*\\{{\\s*queryKey\\s*:\\s*\\[\\s*[''"]([^''"]+)[''"]', 1)) k from cur),
 rs as (select project, path, (100 - rank)::int score, 'search_anchor' kind from seeds
  union all select *, 'linked' from h1 union all select *, 'linked' from h2
  union all select distinct us.project, us.path, 48, 'shared_resource' from us semi join wn on us.project = wn.project and us.r = wn.r anti join sf on us.project = sf.project and us.path = sf.path
  union all select distinct e.project, source_path, 64, 'rpc_consumer' from e semi join nm on e.project = nm.project and {_BARE.format(x='e.target_name')} = nm.n where relation = 'calls_rpc'
  union all select distinct e.project, source_path, 56, 'edge_function_invoker' from e semi join nm on e.project = nm.project and {_BARE.format(x='e.target_name')} = nm.n where relation = 'invokes_edge_function'
  union all select distinct sy.project, sy.path, 72, 'sql_override_chain' from sy semi join nm on sy.project = nm.project and {_BARE.format(x='sy.name')} = nm.n where ends_with(sy.path, '.sql') and kind = 'function'
  union all select project, path, w, 'constraint_candidate' from (select project, path, w, row_number() over (partition by project order by w desc, path) k from (select project, path, (54 + 2 * least(3, n) + 6 * ({_AFF}))::int w from (select project, path, count(*) n from cur where ends_with(path, '.sql') and regexp_matches(lower(content), 'unique index|exclude using|foreign key') group by all) z) x semi join sp using (project)) y where k <= 8
  union all select distinct project, path, 52, 'query_related_ui' from cur semi join sp using (project) where regexp_matches(lower(path), '/pages/|/components/|\\.tsx$') and ({_AFF}) > 0
  union all select distinct dy.project, dy.path, 55, 'cache_invalidator' from dy semi join (select ky.project, k from ky semi join sf on ky.project = sf.project and ky.path = sf.path) z on dy.project = z.project and dy.k = z.k),
 ff as (select project, path, max(score) score, string_agg(distinct kind, ',' order by kind) kinds from rs group by all), fl as (select *, {_LANE} lane from ff)"""
_SLOTS = ", ".join(f"row_number() over (partition by project, list_contains(str_split(kinds, ','), '{k}') order by score desc, path) s{i}" for i, k in enumerate(KIND_SLOTS, 1))
_TIERS = "case when lp = 1 then 0 " + " ".join(f"when list_contains(str_split(kinds, ','), '{k}') and s{i} <= {n} then {i}" for i, (k, n) in enumerate(KIND_SLOTS.items(), 1)) + " when lp <= case lane " + " ".join(f"when '{k}' then {n}" for k, n in LANE_CAPS.items()) + f" else 0 end then {len(KIND_SLOTS) + 1} end"
_WORDS = "list_filter(str_split(lower(trim(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda w: length(w) > 0)"
ORACLE_SQL = {
    "flow_reasons": f"with {_REASONS} select kind, count(distinct (project, path)) files, max(score)::bigint best from rs group by kind",
    "flow_files": f"with {_REASONS} select * from fl",
    "flow_ranked": f"with {_REASONS}, r as (select *, row_number() over (partition by project, lane order by score desc, path) lp, {_SLOTS} from fl), t as (select *, {_TIERS} tier from r), p as (select *, row_number() over (partition by project order by tier, score desc, path) place from t where tier is not null) select project, path, score, lane, tier, place from p where place <= 16",
    "neighbours_of_hits": f"with {_SEED}, {_E}, c as (select * from e where relation = 'calls' and target_path is not null and resolution_confidence <> 'unresolved' and target_path <> source_path), u as (select project, target_path path, target_name via, 0 side from c semi join sf on c.project = sf.project and c.source_path = sf.path union all select project, source_path, target_name, 1 from c semi join sf on c.project = sf.project and c.target_path = sf.path), g as (select project, path, min(side) side, count(*) links, min(via) via from u anti join sf using (project, path) group by all) select project, path, via, side, links from g order by side, links desc, project, path limit 36",
    "symbol_view": f"with {_E}, u as (select project, 'outgoing' direction, relation, target_name other from e where lower(source_name) = '{NAME}' union all select project, 'incoming', relation, source_name from e where lower(target_name) = '{NAME}') select project, direction, relation, count(distinct other) others, count(*) edges from u group by 1, 2, 3",
    "name_homonyms": f"with {_S} select project, name, count(distinct path) files, count(*) symbols from s where kind <> 'module' group by 1, 2 having count(distinct path) > 1",
    "seed_symbols": f"with {_S}, x as (select id, project, path, name, (3 * len(list_intersect(list_distinct({_WORDS}), {FLOW_TERMS!r})) + {_AFF})::bigint score from s) select * from x where score > 0 order by score desc, project, path, id limit 24",
    "path_affinity": f"with {_CHUNKS} select distinct project, path, ({_AFF})::bigint terms from cur where ({_AFF}) > 0",
    "embedding_documents": f"with {_CHUNKS}, d as (select id, sha256('Project: ' || project || chr(10) || 'File: ' || path || chr(10) || chr(10) || case when length(content) > 16000 then left(content, 16000) || chr(10) || '[cut]' else content end) h from cur where content is not null) select h document_hash, count(*) chunks, min(id) first_id from d group by h",
    "embedding_upserts": "with r as (select *, row_number() over (partition by chunk_id order by embedded_at desc nulls last, model desc nulls last, dimension desc nulls last) n, count(*) over (partition by chunk_id) deliveries from chunk_embeddings where chunk_id is not null) select chunk_id, model, dimension, deliveries from r where n = 1",
    "vector_cache_misses": f"with {_CHUNKS}, c as (select id, sha256(content) h from cur where content is not null), v as (select distinct chunk_id id from chunk_embeddings where vector is not null), y as (select distinct h from c semi join v using (id)) select h content_hash, count(*) chunks from c anti join y using (h) group by h",
    "citations": f"with {_CHUNKS} select id, project || ':' || path || ':' || start_line || '-' || end_line citation from cur where {_AUTHORITY.format(p='path')} in {_SEARCHABLE}",
    "symbol_excerpts": f"with {_CHUNKS}, {_S}, h as (select s.id symbol_id, s.start_line a, s.end_line b, greatest(coalesce(c.start_line, 1), 1) f, str_split(content, chr(10)) ls from s join cur c on c.project = s.project and c.path = s.path where kind <> 'module' and content is not null and c.start_line <= s.end_line), l as (select symbol_id, a, b, f, unnest(ls) x, generate_subscripts(ls, 1) + f - 1 ln from h where f + len(ls) - 1 >= a), o as (select symbol_id, a, b, ln, arg_min(x, (f, x)) x from l where ln between a and b group by all), t as (select symbol_id, any_value(b - a + 1) n, count(*) k, string_agg(ln || ': ' || x, chr(10) order by ln) x from o group by symbol_id) select symbol_id, length(x) characters, sha256(x) digest, (n - k)::bigint missing from t",
    "graph_lines": f"with {_E}, {_S}, f as (select distinct project, source_path path from e where target_name = '{RESOURCE}' and relation = 'writes_table') select id, concat_ws(' ', 'SYMBOL', kind, qualified_name, path || ':' || start_line || '-' || end_line) line from s semi join f using (project, path) union all select id, concat_ws(' ', 'EDGE', source_name, '-[' || relation || ']->', target_name, concat_ws(':', source_path, line::varchar)) from e semi join f on f.project = e.project and f.path = e.source_path",
    "anchor_authorities": f"with {_SEED}, c as (select {_AUTHORITY.format(p='path')} authority, {_LANE} lane, count(*) seeds from seeds group by 1, 2) select authority, lane, seeds, round(seeds / (select sum(seeds) from c), 4) as share from c",
}
