"""A flow: all files that bear on a question, by independent reasons, ranked by reserved slots.

Every reason is a plan of its own that yields (project, path, score, kind); they are united and aggregated once, so adding a
reason adds a branch and no lookups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.code import affinity
from quernstone.operators.classify import authority_of
from quernstone.operators.graph import bare_name, expand, lane_of, query_keys, shared_resources
from quernstone.session import cut

# How many files a lane may fill, and the kinds whose best files have slots of their own.
LANE_CAPS = {"implementation": 4, "persistence": 4, "retries": 3, "scheduling": 2, "constraints": 2, "tests": 3}
KIND_SLOTS = {"sql_override_chain": 4, "dispatch_override_chain": 4, "inheritance_chain": 4, "query_related_ui": 5, "rpc_consumer": 5, "generated_contract_consumer": 2}
MOST_CONSTRAINTS = 8


def _reason(df: DataFrame, score, kind: str) -> DataFrame:
    return df.select("project", "path", F.lit(score).cast("int").alias("score") if isinstance(score, int) else score.cast("int").alias("score"), F.lit(kind).alias("kind"))


def reasons(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    """project, path, score, kind. seeds: project, path, rank.

    Seeds, edges and symbols enter several branches, so the columns of them that count are written once.
    """
    seeds = cut(seeds.select("project", "path", "rank"))
    edges = cut(edges.select("project", "source_path", "target_name", "target_path", "relation", "resolution_confidence"))
    symbols = cut(symbols.select("project", "path", "kind", "name"))
    anchors = _reason(seeds, F.lit(100) - F.col("rank"), "search_anchor")
    reached = _reason(expand(seeds, edges).where("score < 100"), F.col("score"), "linked")
    shared = _reason(shared_resources(seeds, edges), 48, "shared_resource")
    seed_files = seeds.select("project", "path").distinct()
    named = symbols.join(seed_files, ["project", "path"], "left_semi").where("kind = 'function'").select("project", bare_name(F.col("name")).alias("name")).distinct()
    uses = edges.select("project", F.col("source_path").alias("path"), bare_name(F.col("target_name")).alias("name"), "relation")
    consumers = _reason(uses.where("relation = 'calls_rpc'").join(named, ["project", "name"], "left_semi").select("project", "path").distinct(), 64, "rpc_consumer")
    invokers = _reason(uses.where("relation = 'invokes_edge_function'").join(named, ["project", "name"], "left_semi").select("project", "path").distinct(), 56, "edge_function_invoker")
    scripts = chunks.where(F.col("path").endswith(".sql") & F.col("content").isNotNull())
    overrides = symbols.where(F.col("path").endswith(".sql") & (F.col("kind") == "function")).select("project", "path", bare_name(F.col("name")).alias("name")).join(named, ["project", "name"], "left_semi")
    overridden = _reason(overrides.select("project", "path").distinct(), 72, "sql_override_chain")
    bound = scripts.where(F.lower("content").rlike("unique index|exclude using|foreign key")).groupBy("project", "path").agg(F.count(F.lit(1)).alias("n"))
    seed_projects = seeds.select("project").distinct()
    weighed = bound.join(seed_projects, "project", "left_semi").withColumn("weight", 54 + 2 * F.least(F.lit(3), F.col("n")) + 6 * affinity(F.col("path"), terms))
    first = weighed.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("weight"), "path"))).where(F.col("k") <= MOST_CONSTRAINTS)
    constraints = _reason(first, F.col("weight"), "constraint_candidate")
    pages = chunks.where(F.lower("path").rlike(r"/pages/|/components/|\.tsx$")).select("project", "path").distinct()
    ui = _reason(pages.join(seed_projects, "project", "left_semi").where(affinity(F.col("path"), terms) > 0), 52, "query_related_ui")
    keys = query_keys(chunks)
    dropped = keys.where("invalidated").join(keys.where("not invalidated").join(seed_files, ["project", "path"], "left_semi").select("project", "key").distinct(), ["project", "key"], "left_semi")
    invalidators = _reason(dropped.select("project", "path").distinct(), 55, "cache_invalidator")
    return reduce(DataFrame.unionByName, (anchors, reached, shared, consumers, invokers, overridden, constraints, ui, invalidators))


def files_of_flow(found: DataFrame) -> DataFrame:
    """project, path, score, kinds, lane: one row per file, with its best score and all its kinds in order."""
    files = found.groupBy("project", "path").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return files.withColumn("lane", lane_of(F.col("path"), authority_of(F.col("path"))))


def rank_flow(files: DataFrame, limit: int = 16) -> DataFrame:
    """project, path, tier, place: each project's flow, cut to ``limit`` files.

    The best file of each lane comes first, then the reserved slots of kinds, then the others while their lane is under its cap,
    in order of score and path. Every tier is a rank within a partition; a file keeps its first tier.
    """
    by_score = [F.desc("score"), F.asc("path")]
    in_lane = F.row_number().over(Window.partitionBy("project", "lane").orderBy(*by_score))
    ranked = files.withColumn("lane_place", in_lane)
    tier = F.when(F.col("lane_place") == 1, 0)
    for k, (kind, slots) in enumerate(KIND_SLOTS.items(), 1):
        has = F.array_contains(F.split("kinds", ","), kind)
        ranked = ranked.withColumn(f"slot{k}", F.when(has, F.row_number().over(Window.partitionBy("project", has).orderBy(*by_score))))
        tier = tier.when(F.col(f"slot{k}") <= slots, k)
    cap = F.lit(0)
    for lane, most in LANE_CAPS.items():
        cap = F.when(F.col("lane") == lane, most).otherwise(cap)
    tier = tier.when(F.col("lane_place") <= cap, len(KIND_SLOTS) + 1)
    kept = ranked.withColumn("tier", tier).where("tier is not null")
    place = F.row_number().over(Window.partitionBy("project").orderBy("tier", *by_score))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("project", "path", "score", "lane", "tier", F.col("place").cast("bigint").alias("place"))


def structural_neighbours(hits: DataFrame, edges: DataFrame, limit: int = 36) -> DataFrame:
    """project, path, via, priority: files one resolved call away from the hits' files, callees before callers."""
    calls = edges.where((F.col("relation") == "calls") & F.col("target_path").isNotNull() & (F.col("resolution_confidence") != "unresolved") & (F.col("target_path") != F.col("source_path")))
    seeds = hits.select("project", "path").distinct()
    out = calls.join(seeds, (calls["project"] == seeds["project"]) & (calls["source_path"] == seeds["path"]), "left_semi").select("project", F.col("target_path").alias("path"), F.col("target_name").alias("via"), F.lit(0).alias("side"))
    into = calls.join(seeds, (calls["project"] == seeds["project"]) & (calls["target_path"] == seeds["path"]), "left_semi").select("project", F.col("source_path").alias("path"), F.col("target_name").alias("via"), F.lit(1).alias("side"))
    found = out.unionByName(into).join(seeds, ["project", "path"], "left_anti").groupBy("project", "path").agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("links"), F.min("via").alias("via"))
    return found.orderBy("side", F.desc("links"), "project", "path").limit(limit).select("project", "path", "via", "side", "links")
