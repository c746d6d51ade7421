"""Inverted index statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import tokens

#: Constants of BM25 and weights of its two fields.
K1, B, PATH_WEIGHT, CONTENT_WEIGHT = 1.2, 0.75, 2.5, 1.0


def token_frequencies(docs: DataFrame, text: str = "content") -> DataFrame:
    """term, documents, occurrences: of each token of the texts; a null text has none.

    A text's tokens are sorted in place, so that the first of equal ones marks the document: one pass, one shuffle that combines
    on the map side.
    """
    # The sorted tokens come along in an array of one, so that the lambda doesn't sort anew for each token.
    marked = F.flatten(F.transform(F.array(F.array_sort(tokens(text))), lambda t: F.transform(t, lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get(t, i - 1) != x), 1).otherwise(0).alias("d")))))
    return docs.select(F.explode(marked).alias("x")).groupBy("x.term").agg(F.sum("x.d").alias("documents"), F.count(F.lit(1)).alias("occurrences"))


def weigh(tf: DataFrame, statistics: DataFrame) -> DataFrame:
    """id, score: BM25 of term frequencies (id, term, len, f) by the corpus' one row of statistics (n_docs, avg_len)."""
    # As many rows as there are terms, and one row: both bounded by the query.
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    raw = F.log((F.col("n_docs") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    idf = F.when(raw <= 0, 1e-6).otherwise(raw)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(statistics)).groupBy("id").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, score: BM25 of the documents (id, path, content) that hold a term, over both fields with their weights.

    Statistics are those of all of docs. Only a document's length and its occurrences of the terms leave the scan; rows repeated
    in full count once, and no text is shuffled. A null content counts as empty; no terms, or none found, give no rows.
    """
    wanted = list(dict.fromkeys(terms)) or [""]
    fields = docs.select("id", tokens(F.coalesce("path", F.lit(""))).alias("p"), tokens(F.coalesce("content", F.lit(""))).alias("c"))
    held = lambda column, weight: F.transform(F.filter(column, lambda t: t.isin(*wanted)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))
    sized = fields.select("id", (F.size("p") + F.size("c")).alias("len"), F.concat(held("p", PATH_WEIGHT), held("c", CONTENT_WEIGHT)).alias("hits")).distinct()
    stats = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    # explode_outer infers no filter on the rows below it, so the statistics and the hits share one exchange.
    tf = sized.select("id", "len", F.explode_outer("hits").alias("h")).where("h is not null").groupBy("id", "len", F.col("h.term").alias("term")).agg(F.sum("h.w").alias("f"))
    return weigh(tf, stats)


def top_hits(scored: DataFrame, limit: int, *ties: str, score: str = "score") -> DataFrame:
    """The ``limit`` rows of the highest rounded score, ties in order of the given columns."""
    return scored.withColumn(score, F.round(score, 5)).orderBy(F.desc(score), *[F.asc(t) for t in ties]).limit(limit)
