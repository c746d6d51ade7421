"""Queries of what the graph says about hits, and of a symbol's view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators.hints import DISPATCH_TERMS, anchor_relationships, hint_terms, hit_contracts, relationship_hints, symbol_card
from quernstone.operators.search import with_authority
from quernstone.plans.graph import _E, _S, NAME
from quernstone.plans.retrieval import _CUR, QUESTION, _current, _frequency_sql
from quernstone.plans.search import _BOTH, _hits
from quernstone.session import cut

TERMS = hint_terms(QUESTION)


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The question's hits with their rank, written once since several parts of an answer read them."""
    hits = _hits(spark, folder, 24).withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("int"))
    return cut(hits.select("rank", "project", "path", "start_line", "end_line", "content", "authority", "score"))


def _stated(spark: SparkSession, folder: str) -> DataFrame:
    listed = _current(spark, folder, "source_authority")
    return with_authority(listed.select("project", "path").distinct(), listed)


def _hints(spark: SparkSession, folder: str, hits: DataFrame, limit: int) -> DataFrame:
    return relationship_hints(QUESTION, hits, _current(spark, folder, "symbols"), _current(spark, folder, "edges"), _current(spark, folder), _stated(spark, folder), limit)


def hit_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = anchor_relationships(_ranked(spark, folder), _current(spark, folder, "symbols"), _current(spark, folder, "edges"), 12)
    return found.select("rank", "path", "symbol", "calls")


def hit_hints(spark: SparkSession, folder: str) -> DataFrame:
    return _hints(spark, folder, _ranked(spark, folder), 12).select("path", "start_line", "end_line", "authority", "via", "from_path", "score")


def contract_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of contracts between the hits and their hints; few or none in these tables (tested on planted rows)."""
    hits = _ranked(spark, folder)
    return hit_contracts(hits, cut(_hints(spark, folder, hits, 12)), _current(spark, folder, "symbols"), _current(spark, folder, "edges"), 12)


def symbol_inspect(spark: SparkSession, folder: str) -> DataFrame:
    return symbol_card(_current(spark, folder, "symbols"), _current(spark, folder, "edges"), NAME, 30).select("part", F.col("place").cast("bigint").alias("place"), "project", "path", "name", "relation", "other_path", "line")


_FUNCTIONS = (hit_anchors, hit_hints, contract_candidates, symbol_inspect)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# -- the same in DuckDB's SQL
_HITS = f"{_BOTH}, {_E}, sy as ({_CUR.format(t='symbols')}), hits as (select *, row_number() over (order by score desc, id) - 1 as rank from hy order by score desc, id limit 24), ov as (select h.rank, s.name symbol, coalesce(s.qualified_name, s.name) qualified, s.start_line s0, s.end_line s1, row_number() over (partition by h.rank order by case kind when 'function' then 0 when 'method' then 1 else 2 end, greatest(s.start_line, h.start_line) - least(s.end_line, h.end_line), s.end_line - s.start_line, s.start_line, coalesce(s.qualified_name, s.name)) n from hits h join sy s on s.project = h.project and s.path = h.path and s.start_line <= h.end_line and s.end_line >= h.start_line where s.active = 1 and h.authority = 'code'), cv as (select * from ov where n = 1), rc as (select * from e where relation = 'calls' and target_path is not null and resolution_confidence <> 'unresolved')"
_NORM = "regexp_replace(lower(target_name), '[^a-z0-9]', '', 'g')"
_NEAR = f"length({_NORM}) > 0 and (" + " or ".join(f"contains({_NORM}, '{t}') or contains('{t}', {_NORM})" for t in TERMS) + ")"
_ROLE = "case when contains(lower(f.caller), '/adapters/') then 40 else 0 end" if set(TERMS) & set(DISPATCH_TERMS) else "0"
_NODE = "case when contains(lower(f.caller), '/node/') or ends_with(lower(f.caller), '/http.js') then 30 else 0 end" if "node" in TERMS else "0"
_NAMED = " + ".join(f"contains(lower(coalesce(f.source_name, '')), '{t}')::int" for t in TERMS)
_T = "lower(coalesce({c}, '')) = '" + NAME + "'"
ORACLE_SQL = {
    "hit_anchors": f"""with {_HITS}, a as (select h.rank, h.project, h.path, symbol, qualified, s0, s1, row_number() over (partition by h.project, h.path, qualified order by h.rank) k from hits h join cv on cv.rank = h.rank where h.rank < 12),
     c as (select a.rank, a.path, qualified, rc.target_name, rc.target_path, row_number() over (partition by a.rank order by line, rc.id) n from a join rc on rc.project = a.project and rc.source_path = a.path and rc.source_name = a.symbol and line between s0 and s1 where k = 1),
     d as (select rank, path, qualified, target_name, target_path, min(n) n from c where n <= 80 group by all), p as (select *, row_number() over (partition by rank order by n) place from d)
     select rank::int as rank, path, qualified symbol, string_agg(target_name, ',' order by place) calls from p where place <= 12 group by all having count(*) >= 2 order by rank limit 12""",
    "hit_hints": f"""with {_HITS}, sp as (select h.rank, h.project, h.path from_path, coalesce(s0, h.start_line) a, coalesce(s1, h.end_line) b, case when h.authority = 'code' then 30 else 0 end + least(20, {_frequency_sql("concat_ws(chr(10), h.path, h.content)", TERMS)}) anchor_score from hits h left join cv on cv.rank = h.rank),
     hd as (select sp.*, target_name, target_path, row_number() over (partition by sp.rank order by line, rc.id) n from sp join rc on rc.project = sp.project and rc.source_path = sp.from_path and line between a and b),
     w as (select rank, project, from_path, anchor_score, target_name, target_path, min(n) n from hd where n <= 40 and ({_NEAR}) group by all),
     sl as (select distinct project, path from ({_CUR.format(t='source_authority')})), au2 as (select sl.*, coalesce(sa.authority, 'unknown') authority from sl left join sa using (project, path)),
     hf as (select w.*, rc.source_path caller, rc.source_name, rc.line ln, c.start_line, c.end_line, c.content, au2.authority, row_number() over (partition by w.rank, w.target_name, w.target_path order by case au2.authority when 'code' then 0 when 'test' then 1 else 2 end, rc.source_path, rc.line, rc.id, c.id) m
       from w join rc on rc.project = w.project and rc.target_name = w.target_name and rc.target_path = w.target_path join cur c on c.project = rc.project and c.path = rc.source_path and rc.line between c.start_line and c.end_line and c.content is not null join au2 on au2.project = rc.project and au2.path = rc.source_path),
     hs as (select f.*, (case when authority = 'code' then 200 else 100 end + {_ROLE} + {_NODE} + anchor_score + 10 * ({_NAMED}) + {_frequency_sql("concat_ws(chr(10), f.caller, f.content)", TERMS)})::int score from hf f where m <= 30 and caller <> from_path),
     hb as (select *, row_number() over (partition by project, caller, start_line, end_line order by score desc, rank, n, m) k from hs), hg as (select *, row_number() over (partition by project, caller order by score desc, start_line, end_line) k2 from hb where k = 1)
     select caller path, start_line, end_line, authority, target_name via, from_path, score from hg where k2 = 1 order by score desc, caller, project limit 12""",
    "symbol_inspect": f"""with {_S}, {_E}, f0 as (select *, lower(coalesce(name, '')) ln, lower(coalesce(qualified_name, '')) lq from s), f1 as (select *, case when lq = '{NAME}' then 0 when ln = '{NAME}' then 1 when starts_with(lq, '{NAME}') then 2 else 3 end mt from f0 where contains(ln, '{NAME}') or contains(lq, '{NAME}')),
     f2 as (select *, row_number() over (order by mt, active desc, path, start_line, id) place from f1), f as (select * from f2 where place <= 30), b as (select count(*) filter (mt = 0) q, count(*) filter (ln = '{NAME}') n from f),
     m as (select f.*, case when q > 0 then mt = 0 when n > 0 then ln = '{NAME}' else place = 1 end prim, q + n exact from f, b), mp as (select case when prim then 'definition' else 'alternative' end part, project, path, coalesce(qualified_name, name) nm, start_line line, row_number() over (partition by prim order by place) pl from m),
     hm as (select distinct project, path from m where prim and exact > 0), lk as (select e.*, ({_T.format(c='source_name')} or {_T.format(c='source_qualified_name')}) so, ({_T.format(c='target_name')} or {_T.format(c='target_qualified_name')}) ta, coalesce(target_qualified_name, target_name) tg from e),
     kp as (select lk.* from lk left join hm a on a.project = lk.project and a.path = lk.source_path left join hm t on t.project = lk.project and t.path = lk.target_path where (so and a.path is not null) or (ta and (t.path is not null or lk.target_path is null))),
     cl as (select *, row_number() over (partition by tg, target_path order by relation, source_path, line, id) k from kp where so and relation = 'calls'), cp as (select *, row_number() over (order by relation, source_path, line, id) pl from cl where k = 1 and tg is not null),
     r1 as (select *, row_number() over (partition by so, relation, source_path, source_qualified_name, target_path, tg order by relation, source_path, line, id) k from kp), rp as (select *, row_number() over (order by case when so then 0 else 1 end, relation, source_path, line, id) pl from r1 where k = 1)
     select part, pl place, project, path, nm as name, null::varchar relation, null::varchar other_path, line from mp where (part = 'definition' and pl <= 6) or (part = 'alternative' and pl <= 3)
     union all select 'call', pl, project, source_path, tg, relation, target_path, line from cp where pl <= 24
     union all select case when so then 'outgoing' else 'incoming' end, pl, project, source_path, case when so then tg else coalesce(source_qualified_name, source_name) end, relation, target_path, line from rp where pl <= 30""",
}
