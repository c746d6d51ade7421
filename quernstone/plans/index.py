"""Queries of the stored inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.index import changed_index, index_statistics, postings, search_index
from quernstone.operators.lexical import top_hits
from quernstone.plans.retrieval import _BM25, _CHUNKS, _TOK, POOL, TERMS, _current
from quernstone.session import cut
from quernstone.tables import table


def indexed_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The best hits of the question out of the postings, which are written once."""
    index = cut(postings(_current(spark, folder)))
    return top_hits(search_index(index, index_statistics(index), TERMS), POOL, "id")


def index_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """term, documents, occurrences of an index that was made of the former generation's rows and brought up to date."""
    chunks, now = table(spark, folder, "chunks"), _current(spark, folder)
    before = chunks.join(now.select("id"), "id", "left_anti").dropDuplicates(["id"])
    index = changed_index(postings(before), before, now)
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("in_path") + F.col("in_content")).alias("occurrences"))


QUERIES = {f.__name__: f for f in (indexed_topk, index_refresh)}
ORACLE_SQL = {
    "indexed_topk": f"with {_BM25} select id, round(score, 5) score from scored order by 2 desc, 1 limit {POOL}",
    "index_refresh": f"""with {_CHUNKS}, f as (select id, unnest(list_concat({_TOK.format(x="coalesce(path, '')")}, {_TOK.format(x="coalesce(content, '')")})) term from cur),
     p as (select id, term, count(*) n from f group by all) select term, count(*) documents, sum(n)::bigint occurrences from p group by term""",
}
