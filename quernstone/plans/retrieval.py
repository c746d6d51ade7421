"""Retrieval queries: chunking, lexical and vector search, fusion, shaping of hits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import INTENTS, active_intents, capped_frequency, query_terms, tokens
from quernstone.operators.chunking import line_windows, token_estimate
from quernstone.operators.classify import EXTENSIONS, SECRET, SKIP_FOLDERS, SKIP_NAMES, authority_of, is_indexable_path, is_safe_path, is_searchable, is_secret_path, reason_of
from quernstone.operators.current import current_rows, published_rows, stale_counts
from quernstone.operators.fusion import reciprocal_ranks, rerank, retrieval_multiplier
from quernstone.operators.graph import lane_of
from quernstone.operators.lexical import bm25, token_frequencies, top_hits
from quernstone.operators.results import best_lines, diverse_hits, first_per_path, pack, per_group, snippets
from quernstone.operators.vector import backlog, dot, exact_top, semantic_status, usable
from quernstone.session import spread
from quernstone.tables import LIGHT, table

QUESTION = "Where does the retry worker handle a provider failure, and which constraint keeps a duplicate booking out?"
TERMS = query_terms(QUESTION)
MODEL, SIZE, OVERLAP, POOL, TOP = "mini-text-a", 8, 2, 30, 12


def _current(spark: SparkSession, folder: str, name: str = "chunks") -> DataFrame:
    return current_rows(table(spark, folder, name), table(spark, folder, "repos"), LIGHT.get(name, ()))


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Current chunk rows, repeated ones as often as they are there: for what counts equal rows once by itself."""
    return published_rows(spread(table(spark, folder, "chunks")), table(spark, folder, "repos"))


def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return line_windows(docs, size=SIZE, overlap=OVERLAP)


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_line").cast("bigint").alias("lines"))


def token_freq(spark: SparkSession, folder: str) -> DataFrame:
    return token_frequencies(_current(spark, folder))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    sized = _current(spark, folder).select("project", F.size(tokens(F.coalesce("content", F.lit("")))).alias("n"))
    return sized.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 4).alias("avg_tokens"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_hits(bm25(_published(spark, folder), TERMS), POOL, "id")


def bm25_by_project(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder)
    scored = bm25(_published(spark, folder), TERMS).withColumn("score", F.round("score", 5)).join(chunks.select("id", "project"), "id")
    return per_group(scored, "project", 3, "id").select("project", "id", "score", F.col("place").cast("bigint").alias("place"))


def searchable_topk(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder)
    scored = bm25(_published(spark, folder), TERMS).join(chunks.select("id", "path"), "id").where(is_searchable(authority_of(F.col("path")))).select("id", "score")
    return top_hits(scored, POOL, "id")


def classify_paths(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "source_authority").select("project", "path").distinct()
    return listed.select("project", "path", authority_of(F.col("path")).alias("authority"), reason_of(F.col("path")).alias("reason"))


def authority_counts(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "source_authority").groupBy("project", "path").agg(F.min(F.lower(F.trim("authority"))).alias("stated"))
    return listed.groupBy("stated", authority_of(F.col("path")).alias("by_path")).agg(F.count(F.lit(1)).alias("files"))


def path_predicates(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    paths = table(spark, folder, "source_authority").select("path").where("path is not null").distinct()
    return paths.select("path", is_secret_path(path).cast("int").alias("secret"), is_safe_path(path).cast("int").alias("safe"), is_indexable_path(path).cast("int").alias("indexable"))


def searchable_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder).select("project", "path")
    return chunks.where(is_searchable(authority_of(F.col("path")))).groupBy("project").agg(F.count(F.lit(1)).alias("chunks"))


def stale_rows(spark: SparkSession, folder: str) -> DataFrame:
    repos = table(spark, folder, "repos")
    return stale_counts(table(spark, folder, "chunks"), repos, "chunks").unionByName(stale_counts(table(spark, folder, "edges"), repos, "edges"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunk_embeddings").where(F.col("model") == MODEL).where(usable(F.col("vector"), F.col("dimension")) & (F.col("dimension") == 64))
    return rows.groupBy("chunk_id").agg(F.max_by("vector", "embedded_at").alias("vector"))


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    """The vector of the least chunk id stands for a question's."""
    row = _vectors(spark, folder).orderBy("chunk_id").limit(1).first()
    return [float(x) for x in row["vector"]] if row else [0.0] * 64


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top(_vectors(spark, folder), _query_vector(spark, folder), POOL)


def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunk_embeddings").where(usable(F.col("vector"), F.col("dimension")))
    return rows.groupBy("model", "dimension").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg(F.sqrt(dot(F.col("vector"), F.col("vector")))), 4).alias("avg_norm"))


def embedding_backlog(spark: SparkSession, folder: str) -> DataFrame:
    return backlog(_current(spark, folder).select("id", "project"), table(spark, folder, "chunk_embeddings"), MODEL)


def embedding_status(spark: SparkSession, folder: str) -> DataFrame:
    return semantic_status(_current(spark, folder).select("id", "project"), table(spark, folder, "chunk_embeddings"), MODEL)


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    lexical = bm25_topk(spark, folder)
    semantic = vector_topk(spark, folder).select(F.col("chunk_id").alias("id"), "score")
    return reciprocal_ranks(lexical, semantic, "id")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder).withColumn("score", F.round("score", 8))


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    # Two top lists, 2 * POOL rows; repeated rows of these alone are made one.
    hits = _published(spark, folder).join(F.broadcast(_fused(spark, folder).withColumnRenamed("score", "fused")), "id").dropDuplicates(["id"])
    authority = authority_of(F.col("path"))
    score = F.col("fused") * retrieval_multiplier(QUESTION, F.col("path"), F.coalesce("content", F.lit("")), authority)
    return hits.where(is_searchable(authority)).select("id", "project", "path", "start_line", "end_line", "content", authority.alias("authority"), F.round(score, 6).alias("score"))


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).orderBy(F.desc("score"), "id").limit(TOP).select("id", "authority", "score")


def rerank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    hits = _hybrid(spark, folder).withColumn("second", capped_frequency(F.col("content"), TERMS))
    return rerank(hits, "id", "score", "second").withColumn("score", F.round("score", 8))


def multipliers(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder)
    value = retrieval_multiplier(QUESTION, F.col("path"), F.coalesce("content", F.lit("")), authority_of(F.col("path")))
    return chunks.select("id", F.round(value, 4).alias("multiplier"))


def best_line(spark: SparkSession, folder: str) -> DataFrame:
    return best_lines(_current(spark, folder).select("id", "start_line", "content"), TERMS)


def line_snippets(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder).select("id", "start_line", "content")
    return snippets(chunks, best_lines(chunks, TERMS)).select("id", "first_line", F.length("snippet").cast("bigint").alias("characters"), F.sha2("snippet", 256).alias("digest"))


def best_chunk_range(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder).where("content is not null")
    scored = chunks.select("project", "path", "start_line", "end_line", capped_frequency(F.col("content"), TERMS).alias("matches"))
    best = scored.groupBy("project", "path").agg(F.max(F.struct("matches", (-F.col("start_line")).alias("a"), (-F.col("end_line")).alias("b"))).alias("m"))
    return best.select("project", "path", (-F.col("m.a")).alias("start_line"), (-F.col("m.b")).alias("end_line"), F.col("m.matches").cast("bigint").alias("matches"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return bm25(_published(spark, folder), TERMS).withColumn("score", F.round("score", 5)).join(_current(spark, folder), "id")


def diverse_first_pass(spark: SparkSession, folder: str) -> DataFrame:
    return first_per_path(_scored(spark, folder), TOP).select("id", "project", "path", "score")


def lane_representatives(spark: SparkSession, folder: str) -> DataFrame:
    hits = _scored(spark, folder).withColumn("lane", lane_of(F.col("path"), authority_of(F.col("path"))))
    return per_group(hits, "lane", 4, "id").select("lane", "id", "score", F.col("place").cast("bigint").alias("place"))


def seed_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Files to begin a flow with: the best of each path, 8 of implementation and 3 of tests."""
    authority = authority_of(F.col("path"))
    group = F.when(authority.isin("code", "schema_history"), "implementation").when(authority == "test", "tests")
    best = _scored(spark, folder).groupBy("project", "path").agg(F.max("score").alias("score")).withColumn("part", group).where("part is not null")
    ranked = per_group(best, "part", 8, "project", "path")
    return ranked.where("part = 'implementation' or place <= 3").select("part", "project", "path", "score", F.col("place").cast("bigint").alias("place"))


def diverse_response(spark: SparkSession, folder: str) -> DataFrame:
    hits = _scored(spark, folder).orderBy(F.desc("score"), "id").limit(60).withColumn("question", F.lit("q"))
    return diverse_hits(hits.select("question", "id", "project", "path", "start_line", "end_line", "score"))


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _current(spark, folder).where("content is not null")
    return chunks.groupBy("project").agg(F.sum(token_estimate(F.length("content"))).alias("tokens"))


def budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    hits = _scored(spark, folder).orderBy(F.desc("score"), "id").limit(60)
    candidates = hits.select(F.lit("q").alias("question"), "id", F.concat_ws("/", "project", "path").alias("path"), "start_line", "end_line", F.col("score").alias("priority"), token_estimate(F.length("content")).alias("tokens"))
    return pack(candidates, 16_000)


_FUNCTIONS = (
    chunk_lines, chunk_counts, token_freq, corpus_stats, bm25_topk, bm25_by_project, searchable_topk, classify_paths, authority_counts, path_predicates, searchable_chunks, stale_rows, vector_topk, vector_norms, embedding_backlog,
    embedding_status, rrf_fusion, hybrid_search, rerank_fusion, multipliers, best_line, line_snippets, best_chunk_range, diverse_first_pass, lane_representatives, seed_quota, diverse_response, token_estimates, budget_pack,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_CUR = "select distinct c.* from {t} c semi join repos r on c.project = r.project and c.generation_id = r.generation_id"
_CHUNKS = f"cur as ({_CUR.format(t='chunks')})"
_TOK = r"regexp_extract_all(regexp_replace(strip_accents(lower({x})), '\p{{Mn}}', '', 'g'), '[\p{{L}}\p{{N}}_-]+')"
_QUOTED = ", ".join(f"'{t}'" for t in TERMS)
_AUTHORITY = """case when {p} is null then null
 when lower({p}) like '%/history/%' or starts_with(lower({p}), 'docs/history/') then 'historical'
 when ends_with(lower({p}), 'src/integrations/supabase/types.ts') then 'generated'
 when starts_with(lower({p}), 'migrations/') or lower({p}) like '%/migrations/%' then 'schema_history'
 when ends_with(lower({p}), 'agents.md') then 'canonical'
 when starts_with(lower({p}), 'docs/architecture/') or starts_with(lower({p}), 'docs/reference/') then 'canonical'
 when starts_with(lower({p}), 'docs/') then 'active'
 when regexp_extract(lower({p}), '[^/]*$') in ('package.json','pyproject.toml','cargo.toml','go.mod','pom.xml','build.gradle','build.gradle.kts','makefile') or regexp_matches(regexp_extract(lower({p}), '[^/]*$'), '^(tsconfig|jest\\.config|vitest\\.config|vite\\.config)') then 'config'
 when regexp_extract(lower({p}), '[^/]*$') in ('readme.md','contributing.md','code_of_conduct.md') then 'active'
 when regexp_extract(lower({p}), '[^/]*$') in ('changelog.md','history.md','changes.md') then 'historical'
 when regexp_matches(lower({p}), '\\.(md|rst)$') or starts_with(lower({p}), '.github/') then 'active'
 when regexp_matches(lower({p}), '(^|/)(tests?|specs?|__tests__)/') or regexp_matches(regexp_extract(lower({p}), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.|_spec\\.') then 'test'
 else 'code' end"""
_SEARCHABLE = "('code','test','schema_history','generated','config')"
_BM25 = f"""{_CHUNKS},
 f as (select id, {_TOK.format(x="coalesce(path, '')")} p, {_TOK.format(x="coalesce(content, '')")} c from cur),
 s as (select id, p, c, len(p) + len(c) l from f), st as (select count(*) n, avg(l) a from s),
 h as (select id, l, unnest(p) t, 2.5 w from s union all select id, l, unnest(c) t, 1.0 w from s),
 tf as (select id, l, t, sum(w) f from h where t in ({_QUOTED}) group by all),
 df as (select t, count(*) d from tf group by t),
 scored as (select id, sum((case when ln((n - d + 0.5) / (d + 0.5)) <= 0 then 1e-6 else ln((n - d + 0.5) / (d + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) score from tf join df using (t), st group by id)"""
_VALID = "vector is not null and len(vector) = dimension and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and list_dot_product(vector::double[], vector::double[]) > 0"
_VECTORS = f"""v as (select chunk_id, arg_max(vector, embedded_at)::double[] vector from (select * from chunk_embeddings where model = '{MODEL}' and dimension = 64 and vector is not null and len(vector) = 64) e where {_VALID} group by chunk_id),
 q as (select vector from v order by chunk_id limit 1),
 vt as (select chunk_id, round(list_dot_product(v.vector, q.vector) / sqrt(list_dot_product(v.vector, v.vector)) / sqrt(list_dot_product(q.vector, q.vector)), 5) score from v, q order by score desc, chunk_id limit {POOL})"""
_RRF = f"""{_BM25}, lx as (select id, round(score, 5) score from scored order by 2 desc, 1 limit {POOL}), {_VECTORS},
 l as (select id, row_number() over (order by score desc, id) k from lx), m as (select chunk_id id, row_number() over (order by score desc, chunk_id) k from vt),
 fused as (select coalesce(l.id, m.id) id, coalesce(1.0::double / (60 + l.k), 0) + coalesce(0.9::double / (60 + m.k), 0) fused from l full join m on l.id = m.id)"""


def _hits_sql(hay: str) -> str:
    terms = [t for name in active_intents(QUESTION) for t in INTENTS[name][1]]
    return " + ".join(f"contains({hay}, '{t}')::int" for t in terms) or "0"


def _multiplier_sql(c: str = "c", authority: str = "") -> str:
    intents = set(active_intents(QUESTION))
    low, a = f"lower({c}.path)", authority or _AUTHORITY.format(p=f"{c}.path")
    hay = f"lower(concat_ws(chr(10), {c}.path, coalesce({c}.content, '')))"
    out = f"(case {a} when 'test' then 1.60 when 'code' then 1.50 when 'schema_history' then 1.35 when 'canonical' then 1.10 when 'config' then 0.80 when 'generated' then 0.70 when 'active' then 0.55 when 'historical' then 0.30 else 1.0 end)::double * (1 + 0.08::double * least({_hits_sql(hay)}, 8))"
    if {"reliability", "external_write", "duplicate"} & intents:
        out += f" * (case when regexp_matches({low}, 'retry|worker|job|queue|command|reconcile|outbox|webhook') then 1.3 when regexp_matches({low}, '/functions/|/migrations/|/workers/|/jobs/|/server/|/api/') then 1.12 else 1.0 end)::double * (case when regexp_matches({low}, '/prompts/|systemprompt') then 0.65 else 1.0 end)::double"
    if "tests" in intents:
        out += f" * (case when {a} = 'test' then 1.5 else 1.0 end)::double"
    if "database_guarantee" in intents:
        out += f" * (case when {a} = 'schema_history' then 1.4 else 1.0 end)::double"
    return out


def _frequency_sql(text: str, terms: list[str]) -> str:
    return " + ".join(f"least(4, (length(lower({text})) - length(replace(lower({text}), '{t}', ''))) // {len(t)})" for t in terms)


_HYBRID = f"{_RRF}, hy as (select c.*, {_AUTHORITY.format(p='c.path')} authority, round(fused * {_multiplier_sql()}, 6) score from cur c join fused using (id) where {_AUTHORITY.format(p='c.path')} in {_SEARCHABLE})"
_LINES = r"""d as (select doc_id, str_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) ls from documents where length(text) > 0),
 w as (select doc_id, ls, len(ls) n, unnest(range(0, (greatest(0, ceil((len(ls) - {s}) / {t}::double)) * {t})::bigint + 1, {t})) k from d)""".format(s=SIZE, t=SIZE - OVERLAP)
_BEST = f"bl as (select id, start_line + k line, {_frequency_sql('x', TERMS)} matches from (select id, start_line, unnest(str_split(content, chr(10))) x, generate_subscripts(str_split(content, chr(10)), 1) - 1 k from cur where content is not null)), best as (select id, arg_max(line, (matches, -line)) line, max(matches) matches from bl group by id)"
_LANE = """case when {a} = 'test' or regexp_matches(lower(path), '(^|/)(tests?|specs?|__tests__)/|\\.test\\.|_test\\.') then 'tests' when regexp_matches(lower(path), 'schedul|cron') then 'scheduling'
 when {a} = 'schema_history' and regexp_matches(lower(path), 'constraint|unique|index') then 'constraints' when regexp_matches(lower(path), 'retry|retries|outbox|queue') then 'retries'
 when {a} = 'schema_history' or ends_with(lower(path), '.sql') then 'persistence' else 'implementation' end""".replace("{a}", "(" + _AUTHORITY.format(p="path") + ")")
_ENDINGS = "(" + " or ".join(f"ends_with(lower(path), '{e}')" for e in EXTENSIONS) + ")"
_A = _AUTHORITY.format(p="path")
_LABELS = iter(("history folder", "generated types", "migration", "instructions", "reference documents", "documents", "configuration", "project document", "change log", "text or workflow", "test"))
_REASON = re.sub(r"then '\w+'", lambda _: f"then '{next(_LABELS)}'", _A).replace("else 'code'", "else 'source'")
ORACLE_SQL = {
    "chunk_lines": f"with {_LINES} select doc_id, (k + 1)::int start_line, least(k + {SIZE}, n)::int end_line, array_to_string(ls[k + 1 : k + {SIZE}], chr(10)) as content from w",
    "chunk_counts": f"with {_LINES} select doc_id, count(*) chunks, max(least(k + {SIZE}, n))::bigint lines from w group by doc_id",
    "token_freq": f"with {_CHUNKS}, f as (select row_number() over () d, unnest({_TOK.format(x='content')}) term from cur), p as (select d, term, count(*) n from f group by all) select term, count(*) documents, sum(n)::bigint occurrences from p group by term",
    "corpus_stats": f"with {_CHUNKS}, s as (select project, len({_TOK.format(x="coalesce(content, '')")}) n from cur) select project, count(*) chunks, sum(n)::bigint tokens, round(avg(n), 4) avg_tokens from s group by project",
    "bm25_topk": f"with {_BM25} select id, round(score, 5) score from scored order by 2 desc, 1 limit {POOL}",
    "bm25_by_project": f"with {_BM25}, x as (select c.project, id, round(score, 5) score from scored join cur c using (id)), y as (select *, row_number() over (partition by project order by score desc, id) place from x) select project, id, score, place from y where place <= 3",
    "searchable_topk": f"with {_BM25} select id, round(score, 5) score from scored join cur c using (id) where {_AUTHORITY.format(p='c.path')} in {_SEARCHABLE} order by 2 desc, 1 limit {POOL}",
    "classify_paths": f"select distinct project, path, {_A} as authority, {_REASON} as reason from source_authority",
    "authority_counts": f"select stated, {_A} by_path, count(*) files from (select project, path, min(lower(trim(authority))) stated from source_authority group by all) group by 1, 2",
    "path_predicates": f"select path, regexp_matches(path, '{SECRET}')::int secret, (length(path) > 0 and not starts_with(path, '/') and not regexp_matches(path, '(^|/)\\.\\.(/|$)'))::int safe, ({_ENDINGS} and not regexp_matches(path, '{SECRET}') and regexp_extract(lower(path), '[^/]*$') not in {SKIP_NAMES!r} and len(list_intersect(str_split(lower(path), '/'), {list(SKIP_FOLDERS)!r})) = 0)::int indexable from (select distinct path from source_authority where path is not null)",
    "searchable_chunks": f"with {_CHUNKS} select project, count(*) chunks from cur where {_A} in {_SEARCHABLE} group by project",
    "stale_rows": "with r as (select distinct project, generation_id g from repos) select 'chunks' source, project, count(*) filter (coalesce(generation_id = g, false)) current_rows, count(*) filter (not coalesce(generation_id = g, false)) stale_rows from chunks left join r using (project) group by project union all select 'edges', project, count(*) filter (coalesce(generation_id = g, false)), count(*) filter (not coalesce(generation_id = g, false)) from edges left join r using (project) group by project",
    "vector_topk": f"with {_VECTORS} select chunk_id, score from vt",
    "vector_norms": f"select model, dimension, count(*) vectors, round(avg(sqrt(list_dot_product(vector::double[], vector::double[]))), 4) avg_norm from (select * from chunk_embeddings where vector is not null and len(vector) = dimension) e where {_VALID} group by all",
    "embedding_backlog": f"with {_CHUNKS} select c.id, c.project from cur c anti join (select chunk_id id from chunk_embeddings where model = '{MODEL}') e using (id)",
    "embedding_status": f"with {_CHUNKS}, h as (select distinct chunk_id id, 1 has from chunk_embeddings where model = '{MODEL}'), g as (select project, count(*) chunks, count(has) vectors from cur left join h using (id) group by project), p as (select *, chunks - vectors pending, round((chunks - vectors) / chunks, 4) pending_ratio from g) select project, chunks, vectors, pending, pending_ratio, case when pending = 0 then 'current' when pending >= 100 or pending_ratio >= 0.25 then 'required' when pending >= 50 or pending_ratio >= 0.1 then 'recommended' else 'defer' end recommendation from p",
    "rrf_fusion": f"with {_RRF} select id, round(fused, 8) score from fused",
    "hybrid_search": f"with {_HYBRID} select id, authority, score from hy order by score desc, id limit {TOP}",
    "rerank_fusion": f"with {_HYBRID}, z as (select id, score, {_frequency_sql("coalesce(content, '')", TERMS)} freq from hy), a as (select id, row_number() over (order by score desc, id) b, row_number() over (order by freq desc, id) r from z) select id, round(0.25::double / (60 + b) + 0.75::double / (60 + r), 8) score from a",
    "multipliers": f"with {_CHUNKS} select id, round({_multiplier_sql()}, 4) multiplier from cur c",
    "best_line": f"with {_CHUNKS}, {_BEST} select id, line::bigint line, matches::bigint matches from best",
    "line_snippets": f"with {_CHUNKS}, {_BEST}, o as (select c.id, start_line, str_split(content, chr(10)) ls, greatest(0, least(best.line - start_line - 7, len(str_split(content, chr(10))) - 14)) k from cur c join best using (id) where content is not null), t as (select id, (start_line + k)::bigint first_line, array_to_string(ls[k + 1 : k + 14], chr(10)) x from o), u as (select id, first_line, case when length(x) > 1800 then regexp_replace(left(x, 1800), '\n[^\n]*$', '') else x end s from t) select id, first_line, length(s) characters, sha256(s) digest from u",
    "best_chunk_range": f"with {_CHUNKS}, s as (select project, path, start_line, end_line, {_frequency_sql('content', TERMS)} m from cur where content is not null), b as (select project, path, max((m, -start_line, -end_line)) x from s group by all) select project, path, -x[2] start_line, -x[3] end_line, x[1]::bigint matches from b",
    "diverse_first_pass": f"with {_BM25}, x as (select id, c.project, c.path, round(score, 5) score from scored join cur c using (id)), y as (select *, row_number() over (partition by project, path order by score desc, id) n from x) select id, project, path, score from y where n = 1 order by score desc, project, path limit {TOP}",
    "lane_representatives": f"with {_BM25}, x as (select id, round(score, 5) score, {_LANE} lane from scored join cur c using (id)), y as (select *, row_number() over (partition by lane order by score desc, id) place from x) select lane, id, score, place from y where place <= 4",
    "seed_quota": f"with {_BM25}, x as (select project, path, max(round(score, 5)) score from scored join cur using (id) group by all), p as (select *, case when {_A} in ('code', 'schema_history') then 'implementation' when {_A} = 'test' then 'tests' end part from x), y as (select *, row_number() over (partition by part order by score desc, project, path) place from p where part is not null) select part, project, path, score, place from y where place <= 8 and (part = 'implementation' or place <= 3)",
    "token_estimates": f"with {_CHUNKS} select project, sum(greatest(1, ceil(length(content) / 4)))::bigint tokens from cur where content is not null group by project",
}
