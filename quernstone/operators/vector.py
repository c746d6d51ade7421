"""Vector search, backlog and freshness of embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length, with a floor for the zero vector. The length is found once: it comes along in a pair with the vector."""
    pair = F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(1e-12)).alias("n")))
    return F.transform(pair, lambda p: F.transform(p["v"], lambda x: x.cast("double") / p["n"]))[0]


def usable(vector: Column, dimension: Column) -> Column:
    """Neither null nor zero, without NaN or null elements, and as long as its dimension says."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce((F.size(vector) == dimension) & ~bad & (norm(vector) > 0), F.lit(False))


def exact_top(vectors: DataFrame, query: list[float], limit: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """key, score: the ``limit`` rows of the highest cosine to one query vector, ties by key. One pass and a top-k; no shuffle of vectors."""
    length = math.sqrt(sum(x * x for x in query)) or 1e-12
    q = F.array(*[F.lit(float(x) / length) for x in query])
    # The product over the length, not the product with a normalised vector: a lambda would find the length anew per element.
    cosine = dot(F.col(vector), q) / F.greatest(norm(F.col(vector)), F.lit(1e-12))
    return vectors.select(key, F.round(cosine, 5).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(limit)


def backlog(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """The chunks that have no vector of the model."""
    have = embeddings.where(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    return chunks.join(have, "id", "left_anti")


def semantic_status(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """project, chunks, vectors, pending, pending_ratio, recommendation: how far the vectors of a model are behind, per project."""
    have = embeddings.where(F.col("model") == model).select(F.col("chunk_id").alias("id")).distinct().withColumn("has", F.lit(1))
    counts = chunks.join(have, "id", "left").groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("vectors"))
    pending = F.col("chunks") - F.col("vectors")
    ratio = F.round(pending / F.col("chunks"), 4)
    advice = F.when(pending == 0, "current").when((pending >= 100) | (ratio >= 0.25), "required").when((pending >= 50) | (ratio >= 0.10), "recommended").otherwise("defer")
    return counts.select("project", "chunks", "vectors", pending.alias("pending"), ratio.alias("pending_ratio"), advice.alias("recommendation"))
