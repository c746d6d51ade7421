"""A stored inverted index over chunks, kept in step with them, and BM25 that reads only a question's terms.

Postings lie in buckets by a hash of their term, so a question opens the buckets of its terms and no text. A change of chunks
removes the postings of chunks that are gone and adds those of new ones; nothing else is tokenised again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import tokens
from quernstone.operators.lexical import CONTENT_WEIGHT, PATH_WEIGHT, weigh
from quernstone.operators.publish import publish_diff

BUCKETS = 256


def bucket_of(term, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, id, in_path, in_content, length: how often each chunk holds each term in its path and content, and its tokens.

    One pass over the texts and one shuffle of (id, term), which combines on the map side. Null paths and contents count as empty;
    chunks without tokens have no postings.
    """
    fields = chunks.select("id", tokens(F.coalesce("path", F.lit(""))).alias("p"), tokens(F.coalesce("content", F.lit(""))).alias("c"))
    held = fields.select("id", (F.size("p") + F.size("c")).alias("length"), F.explode(F.concat(F.transform("p", lambda t: F.struct(t.alias("term"), F.lit(1).alias("p"))), F.transform("c", lambda t: F.struct(t.alias("term"), F.lit(0).alias("p"))))).alias("h"))
    counted = held.groupBy("id", F.col("h.term").alias("term")).agg(F.sum("h.p").alias("in_path"), F.sum(1 - F.col("h.p")).alias("in_content"), F.first("length").alias("length"))
    return counted.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "id", "in_path", "in_content", "length")


def write_index(index: DataFrame, folder: str) -> None:
    """A folder per bucket, in order of the terms, so that files tell by their statistics which terms they hold."""
    index.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def changed_index(index: DataFrame, published: DataFrame, desired: DataFrame) -> DataFrame:
    """The index behind a publishing: postings of chunks that stay, under the ids they keep, and of the new ones.

    published and desired: the chunks before and after. Only chunks that ``desired`` has and ``published`` hasn't are tokenised.
    """
    diff = publish_diff(published, desired)
    gone = diff.where("change = 'deleted'").select(F.col("old_id").alias("id"))
    new = desired.join(diff.where("change = 'inserted'").select(F.col("new_id").alias("id")), "id", "left_semi")
    return index.join(gone, "id", "left_anti").unionByName(postings(new))


def index_statistics(index: DataFrame) -> DataFrame:
    """n_docs, avg_len: of the chunks that have postings; stored with an index, so that a question needn't count."""
    return index.groupBy("id").agg(F.first("length").alias("len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))


def search_index(index: DataFrame, statistics: DataFrame, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """id, score: BM25 as over the texts, from the postings of the terms alone. No terms give an error, as does a question of stop words."""
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        raise ValueError("the question holds no term to search for")
    named = index.sparkSession.createDataFrame([(t,) for t in wanted], "term string").select(bucket_of(F.col("term"), buckets).alias("b")).distinct()
    opened = [r["b"] for r in named.collect()]
    tf = index.where(F.col("bucket").isin(*opened) & F.col("term").isin(*wanted)).select("id", "term", F.col("length").alias("len"), (PATH_WEIGHT * F.col("in_path") + CONTENT_WEIGHT * F.col("in_content")).alias("f"))
    return weigh(tf, statistics)

