"""Two-stage retrieval: lexical and vector pools, fusion and reweighting, an optional second stage, and what a response shows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.code import RERANK_CHARS
from quernstone.functions.text import query_terms
from quernstone.operators.classify import SEARCHABLE
from quernstone.operators.fusion import RERANK_BASE, RANK_CONSTANT, RERANK_SHARE, reciprocal_ranks, retrieval_multiplier
from quernstone.operators.lexical import bm25, top_hits
from quernstone.operators.vector import exact_top, normalised

# Pools of the stages, terms that make a question worth a second stage, modes, quotas of seeds.
LEXICAL_MOST, POOL_LEAST, POOL_MOST, WIDE_POOL, NARROW_POOL, RERANK_TERMS = 30, 20, 60, 60, 24, 8
MODES = ("auto", "fast", "code")
IMPLEMENTATION = ("code", "schema_history")
SEED_QUOTAS, MOST_SEEDS = {"implementation": 8, "tests": 3}, 14
IMPLEMENTATION_INTENT = re.compile(r"\b(?:fix|causal|implement(?:ation)?|implementaci[oó]n|modif(?:y|ication|icar|icaci[oó]n)|production code|c[oó]digo productivo)\b", re.I)
TEST_INTENT = re.compile(r"\b(?:tests?|pruebas?|regressions?)\b", re.I)


def mixed_intent(question: str) -> bool:
    """Whether a question asks for implementation and tests at once."""
    return bool(IMPLEMENTATION_INTENT.search(question) and TEST_INTENT.search(question))


@dataclass(frozen=True)
class Reranker:
    """A second stage: scores documents (id, document) of a question as (id, second). None of both means there is none."""

    score: Callable[[str, DataFrame], DataFrame] | None = None
    name: str = "off"

    @property
    def available(self) -> bool:
        return self.score is not None


def should_rerank(question: str, mode: str, reranker: Reranker) -> bool:
    """fast never, code always, auto if there is a reranker and the question has many terms."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}")
    return mode == "code" or mode == "auto" and reranker.available and len(query_terms(question)) >= RERANK_TERMS


def with_authority(rows: DataFrame, authority: DataFrame) -> DataFrame:
    """rows with the authority that the table states for their file, tidied; of several the first, 'unknown' where it states none."""
    stated = authority.groupBy("project", "path").agg(F.min(F.lower(F.trim("authority"))).alias("authority"))
    return rows.join(stated, ["project", "path"], "left").withColumn("authority", F.coalesce("authority", F.lit("unknown")))


def keyword_hits(chunks: DataFrame, authority: DataFrame, question: str, limit: int) -> DataFrame:
    """id, score: the best searchable chunks by BM25, LEXICAL_MOST at most. Statistics are those of all chunks."""
    terms = query_terms(question)
    if not terms:
        raise ValueError("the question holds no term to search for")
    files = with_authority(chunks.select("id", "project", "path"), authority).where(F.col("authority").isin(*SEARCHABLE)).select("id")
    return top_hits(bm25(chunks, terms).join(files, "id", "left_semi"), max(1, min(limit, LEXICAL_MOST)), "id")


def semantic_hits(chunks: DataFrame, authority: DataFrame, vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """id, score: the searchable chunks whose vectors (chunk_id, vector) are nearest to the query's."""
    files = with_authority(chunks.select("id", "project", "path"), authority).where(F.col("authority").isin(*SEARCHABLE)).select(F.col("id").alias("chunk_id"))
    return exact_top(vectors.join(files, "chunk_id", "left_semi"), query, max(1, limit)).select(F.col("chunk_id").alias("id"), "score")


def hybrid_hits(chunks: DataFrame, authority: DataFrame, vectors: DataFrame, query: list[float], question: str, limit: int) -> DataFrame:
    """id, project, path, start_line, end_line, content, authority, score: both pools fused by rank, reweighted, the best ``limit``."""
    pool = max(POOL_LEAST, min(POOL_MOST, 4 * limit))
    fused = reciprocal_ranks(keyword_hits(chunks, authority, question, pool), semantic_hits(chunks, authority, vectors, query, pool), "id").withColumnRenamed("score", "fused")
    # Two top lists: LEXICAL_MOST + POOL_MOST rows at most. The texts of these alone are fetched.
    hits = with_authority(chunks.join(F.broadcast(fused), "id"), authority).where(F.col("authority").isin(*SEARCHABLE))
    score = F.col("fused") * retrieval_multiplier(question, F.col("path"), F.coalesce("content", F.lit("")), F.col("authority"))
    return hits.select("id", "project", "path", "start_line", "end_line", "content", "authority", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def rerank_document(path: Column, content: Column) -> Column:
    """What a second stage reads of a hit."""
    return F.substring(F.concat(F.lit("File: "), path, F.lit("\n"), F.coalesce(content, F.lit(""))), 1, RERANK_CHARS)


def reranked(hits: DataFrame, question: str, reranker: Reranker) -> DataFrame:
    """The hits with a score fused of their rank and the second stage's; ties by id. A hit that it doesn't score comes last there."""
    documents = hits.select("id", rerank_document(F.col("path"), F.col("content")).alias("document"))
    both = hits.join(reranker.score(question, documents), "id", "left")
    base = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    second = F.row_number().over(Window.orderBy(F.desc_nulls_last("second"), "id"))
    ranked = both.withColumn("b", base).withColumn("r", second)
    return ranked.withColumn("score", F.round(RERANK_BASE / (RANK_CONSTANT + F.col("b")) + RERANK_SHARE / (RANK_CONSTANT + F.col("r")), 8)).drop("b", "r", "second")


def retrieve(search: Callable[[int], DataFrame], question: str, mode: str, reranker: Reranker) -> tuple[DataFrame, bool, str | None]:
    """(hits, whether they were reranked, why not if it failed): a wide pool for a second stage or a mixed question, else a narrow one.

    In mode auto a second stage that fails is left out; in mode code its failure is the caller's.
    """
    second = should_rerank(question, mode, reranker)
    hits = search(WIDE_POOL if second or mixed_intent(question) else NARROW_POOL)
    if not second:
        return hits, False, None
    try:
        if not reranker.available:
            raise RuntimeError("there is no reranker")
        return reranked(hits, question, reranker), True, None
    except RuntimeError as error:
        if mode == "code":
            raise
        return hits, False, str(error)


def deep_seeds(hits: DataFrame, limit: int = MOST_SEEDS) -> DataFrame:
    """project, path, seed: files to begin a flow with, from 1: the best of implementation and of tests by quota, then the others by rank."""
    best = hits.groupBy("project", "path").agg(F.max("score").alias("score"), F.min("authority").alias("authority"))
    part = F.when(F.col("authority").isin(*IMPLEMENTATION), "implementation").when(F.col("authority") == "test", "tests").otherwise("other")
    ranked = best.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "project", "path")))
    tier = F.lit(len(SEED_QUOTAS))
    for k, (name, quota) in enumerate(SEED_QUOTAS.items()):
        tier = F.when((F.col("part") == name) & (F.col("place") <= quota), k).otherwise(tier)
    chosen = ranked.withColumn("tier", tier).orderBy("tier", F.desc("score"), "project", "path").limit(limit)
    return chosen.select("project", "path", F.row_number().over(Window.orderBy("tier", F.desc("score"), "project", "path")).alias("seed"))


def cached_vectors(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(hash, vector of every text; those among them that are new): looked up by the text's hash, embedded where the cache has none.

    texts: text. cache and what embed makes of (hash, text): hash, vector. Equal texts are embedded once; new vectors have unit length.
    """
    wanted = texts.where("text is not null").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    new = embed(wanted.join(cache.select("hash"), "hash", "left_anti")).select("hash", normalised(F.col("vector")).alias("vector"))
    known = cache.join(wanted.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.first("vector").alias("vector"))
    return known.unionByName(new), new
