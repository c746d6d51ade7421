"""Fusion of rankings and reweighting of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import INTENTS, active_intents
from quernstone.operators.classify import weight_of

RANK_CONSTANT, VECTOR_SHARE = 60, 0.9
RERANK_BASE, RERANK_SHARE = 0.25, 0.75


def ranked(hits: DataFrame, key: str, name: str, score: str = "score") -> DataFrame:
    """key and its place, from 1, by score and then by key. hits is a bounded top list."""
    return hits.select(key, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).alias(name))


def reciprocal_ranks(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """key, score: 1 / (60 + place) of the first list plus 0.9 / (60 + place) of the second; a list without the key adds nothing."""
    both = ranked(lexical, key, "l").join(ranked(semantic, key, "s"), key, "full_outer")
    part = lambda c, share: F.coalesce(F.lit(share) / (RANK_CONSTANT + F.col(c)), F.lit(0.0))
    return both.select(key, (part("l", 1.0) + part("s", VECTOR_SHARE)).alias("score"))


def rerank(hits: DataFrame, key: str, base: str, second: str) -> DataFrame:
    """key, score: a quarter of the first stage's reciprocal rank and three quarters of the second's."""
    first = ranked(hits, key, "b", base).join(ranked(hits, key, "r", second), key)
    return first.select(key, (RERANK_BASE / (RANK_CONSTANT + F.col("b")) + RERANK_SHARE / (RANK_CONSTANT + F.col("r"))).alias("score"))


def retrieval_multiplier(question: str, path: Column, content: Column, authority: Column) -> Column:
    """What a hit's score is multiplied by: its authority, how many of the question's intent terms it holds, and where it lies."""
    intents = active_intents(question)
    hay = F.lower(F.concat_ws("\n", path, content))
    found = F.lit(0)
    for name in intents:
        for term in INTENTS[name][1]:
            found = found + hay.contains(term).cast("int")
    out = weight_of(authority) * (1 + 0.08 * F.least(found, F.lit(8)))
    low = F.lower(path)
    if {"reliability", "external_write", "duplicate"} & set(intents):
        near = low.rlike("retry|worker|job|queue|command|reconcile|outbox|webhook")
        place = low.rlike("/functions/|/migrations/|/workers/|/jobs/|/server/|/api/")
        out = out * F.when(near, 1.3).when(place, 1.12).otherwise(1.0) * F.when(low.rlike("/prompts/|systemprompt"), 0.65).otherwise(1.0)
    if "tests" in intents:
        out = out * F.when(authority == "test", 1.5).otherwise(1.0)
    if "database_guarantee" in intents:
        out = out * F.when(authority == "schema_history", 1.4).otherwise(1.0)
    return out
