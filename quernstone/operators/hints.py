"""What the graph says about a question's hits: their direct calls, who shares a callee with them, whose contracts differ; and the view of a symbol.

hits: rank (from 0), project, path, start_line, end_line, content, authority; a bounded top list. Each answer is one plan for all
hits: range joins within a file, then ranks within a hit.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import capped_frequency, query_terms
from quernstone.operators.graph import CLASSIFIER, UNRESOLVED

# How many hits, calls and callers of each are looked at, and shown.
ANCHOR_HITS, HINT_HITS, MOST_CALLS, SHOWN_CALLS, HINT_CALLS, HINT_CALLERS, SHOWN_NAMES = 12, 24, 80, 12, 40, 30, 12
DEFINITIONS, ALTERNATIVES, DIRECT_CALLS = 6, 3, 24
DISPATCH_TERMS = ("dispatch", "dispatched", "request", "requests", "send")


def hint_terms(question: str) -> list[str]:
    """The question's terms as they are looked for in names: letters and digits, four or more."""
    plain = (re.sub(r"[^a-z0-9]", "", t.lower()) for t in query_terms(question))
    return sorted({t for t in plain if len(t) >= 4})


def covering_active(spans: DataFrame, symbols: DataFrame, key: str = "rank") -> DataFrame:
    """key, symbol, qualified, s0, s1: of each span (key, project, path, start_line, end_line) the active symbol that covers it best.

    Functions come before methods and these before others, then the larger overlap, the smaller symbol, the first line.
    """
    s = symbols.where("active = 1").select("project", "path", F.col("name").alias("symbol"), F.coalesce("qualified_name", "name").alias("qualified"), F.col("start_line").alias("s0"), F.col("end_line").alias("s1"), F.when(F.col("kind") == "function", 0).when(F.col("kind") == "method", 1).otherwise(2).alias("kind_rank"))
    over = spans.join(s, ["project", "path"]).where((F.col("s0") <= F.col("end_line")) & (F.col("s1") >= F.col("start_line")))
    order = F.struct("kind_rank", (F.greatest("s0", "start_line") - F.least("s1", "end_line")).alias("over"), (F.col("s1") - F.col("s0")).alias("size"), "s0", "qualified")
    return over.groupBy(key).agg(F.min_by(F.struct("symbol", "qualified", "s0", "s1"), order).alias("s")).select(key, "s.*")


def _resolved_calls(edges: DataFrame) -> DataFrame:
    own = (F.col("relation") == "calls") & F.col("target_path").isNotNull() & (F.col("resolution_confidence") != UNRESOLVED)
    return edges.where(own).select("project", F.col("source_path").alias("path"), "source_name", "line", "target_name", "target_path", "resolution_confidence", F.col("id").alias("edge_id"))


def direct_calls(anchors: DataFrame, edges: DataFrame, key: str = "rank", most: int = MOST_CALLS) -> DataFrame:
    """key, target_name, target_path, confidence, line: the distinct resolved calls of each anchor's symbol, of its first ``most`` calls.

    anchors: key, project, path, symbol, s0, s1.
    """
    held = anchors.join(_resolved_calls(edges), ["project", "path"]).where((F.col("source_name") == F.col("symbol")) & F.col("line").between(F.col("s0"), F.col("s1")))
    first = held.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line", "edge_id"))).where(F.col("n") <= most)
    return first.groupBy(key, "target_name", "target_path").agg(F.min_by("resolution_confidence", "n").alias("confidence"), F.min("line").alias("line"), F.min("n").alias("n"))


def _anchors(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    return hits.select("rank", "project", "path").join(covering_active(hits, symbols), "rank")


def anchor_relationships(hits: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """rank, path, symbol, s0, s1, calls: the symbols of the first code hits that call two or more others, each symbol once, with the first of their calls."""
    anchors = _anchors(hits.where((F.col("rank") < ANCHOR_HITS) & (F.col("authority") == "code")), symbols)
    once = anchors.withColumn("n", F.row_number().over(Window.partitionBy("project", "path", "qualified").orderBy("rank"))).where("n = 1").drop("n")
    calls = direct_calls(once, edges).withColumn("place", F.row_number().over(Window.partitionBy("rank").orderBy("n"))).where(F.col("place") <= SHOWN_CALLS)
    listed = calls.groupBy("rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "target_name"))), lambda c: c["target_name"]), ",").alias("calls"), F.count(F.lit(1)).alias("n"))
    return once.join(listed.where("n >= 2"), "rank").orderBy("rank").limit(limit).select("rank", "path", F.col("qualified").alias("symbol"), "s0", "s1", "calls")


def _any_term(name: Column, terms: list[str]) -> Column:
    low = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    near = reduce(lambda a, b: a | b, [low.contains(t) | F.lit(t).contains(low) for t in terms])
    return (F.length(low) > 0) & near


def relationship_hints(question: str, hits: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, authority: DataFrame, limit: int = 2) -> DataFrame:
    """path, start_line, end_line, authority, via, from_path, score: chunks elsewhere that call a callee which a hit calls and the question names.

    authority: project, path, authority. Code comes before tests, adapters and node files first where the question speaks of them,
    then names and texts that hold its terms. One chunk per file, the best; ties by hit and line.
    """
    terms = hint_terms(question)
    if not terms:
        return hits.limit(0).select("path", "start_line", "end_line", "authority", F.lit("").alias("via"), F.lit("").alias("from_path"), F.lit(0).alias("score"))
    own = hits.where(F.col("rank") < HINT_HITS)
    covered = covering_active(own.where("authority = 'code'"), symbols)
    spans = own.join(covered.select("rank", "s0", "s1"), "rank", "left").select("rank", "project", F.col("path").alias("from_path"), F.coalesce("s0", "start_line").alias("a"), F.coalesce("s1", "end_line").alias("b"), (F.when(F.col("authority") == "code", 30).otherwise(0) + F.least(F.lit(20), capped_frequency(F.concat_ws("\n", "path", "content"), terms))).alias("anchor_score"))
    calls = _resolved_calls(edges)
    held = spans.join(calls.withColumnRenamed("path", "from_path"), ["project", "from_path"]).where(F.col("line").between(F.col("a"), F.col("b")))
    held = held.withColumn("n", F.row_number().over(Window.partitionBy("rank").orderBy("line", "edge_id"))).where((F.col("n") <= HINT_CALLS) & _any_term(F.col("target_name"), terms))
    wanted = held.groupBy("rank", "project", "from_path", "anchor_score", "target_name", "target_path").agg(F.min("n").alias("n"))
    # Callers elsewhere, by place of their call; the text of a place that holds it.
    callers = wanted.join(calls.select("project", "target_name", "target_path", F.col("path").alias("caller"), "source_name", F.col("line").alias("at"), "edge_id"), ["project", "target_name", "target_path"])
    places = chunks.where("content is not null").select("project", F.col("path").alias("caller"), "id", "start_line", "end_line", "content")
    found = callers.join(places, ["project", "caller"]).where(F.col("at").between(F.col("start_line"), F.col("end_line")))
    stated = authority.select("project", F.col("path").alias("caller"), "authority")
    found = found.join(stated, ["project", "caller"])
    kind = F.when(F.col("authority") == "code", 0).when(F.col("authority") == "test", 1).otherwise(2)
    first = Window.partitionBy("rank", "target_name", "target_path").orderBy(kind, "caller", "at", "edge_id", "id")
    found = found.withColumn("m", F.row_number().over(first)).where((F.col("m") <= HINT_CALLERS) & (F.col("caller") != F.col("from_path")))
    low, name = F.lower("caller"), F.lower(F.coalesce("source_name", F.lit("")))
    role = F.lit(0)
    if set(terms) & set(DISPATCH_TERMS):
        role = role + F.when(low.contains("/adapters/"), 40).otherwise(0)
    if "node" in terms:
        role = role + F.when(low.contains("/node/") | low.endswith("/http.js"), 30).otherwise(0)
    named = reduce(lambda a, b: a + b, [name.contains(t).cast("int") for t in terms])
    score = F.when(F.col("authority") == "code", 200).otherwise(100) + role + F.col("anchor_score") + 10 * named + capped_frequency(F.concat_ws("\n", "caller", "content"), terms)
    scored = found.withColumn("score", score.cast("int"))
    better = Window.partitionBy("project", "caller", "start_line", "end_line").orderBy(F.desc("score"), "rank", "n", "m")
    best = scored.withColumn("k", F.row_number().over(better)).where("k = 1")
    per_path = best.withColumn("k", F.row_number().over(Window.partitionBy("project", "caller").orderBy(F.desc("score"), "start_line", "end_line"))).where("k = 1")
    return per_path.orderBy(F.desc("score"), "caller", "project").limit(limit).select("project", F.col("caller").alias("path"), "start_line", "end_line", "authority", F.col("target_name").alias("via"), "from_path", "score")


def hit_contracts(hits: DataFrame, hints: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """anchor, related, shared, only_anchor, only_related: pairs of a hit's symbol and a hint's whose sets of predicate callees overlap but differ."""
    firsts = hits.where(F.col("rank") < HINT_HITS).withColumn("n", F.row_number().over(Window.partitionBy("project", "path").orderBy("rank"))).where("n = 1")
    left = _anchors(firsts, symbols)
    spans = hints.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1)
    right = _anchors(spans, symbols)

    def predicates(anchors: DataFrame, name: str) -> DataFrame:
        calls = direct_calls(anchors, edges).where(F.col("target_name").rlike(CLASSIFIER))
        named = calls.groupBy("rank", F.lower("target_name").alias("low")).agg(F.min_by("target_name", "n").alias("shown"))
        return named.groupBy("rank").agg(F.map_from_entries(F.collect_list(F.struct("low", "shown"))).alias(name))

    l = left.join(predicates(left, "l"), "rank").select("project", F.col("path").alias("from_path"), F.col("qualified").alias("anchor"), "l")  # noqa: E741
    r = spans.select("rank", "project", "from_path").join(right.select("rank", F.col("path").alias("related_path"), F.col("qualified").alias("related")), "rank").join(predicates(right, "r"), "rank")
    both = r.join(l, ["project", "from_path"]).withColumn("k", F.row_number().over(Window.partitionBy("project", "from_path", "related_path").orderBy("rank"))).where("k = 1")
    names = lambda m, keys: F.array_join(F.slice(F.transform(F.array_sort(keys), lambda x: F.element_at(m, x)), 1, SHOWN_NAMES), ",")
    lk, rk = F.map_keys("l"), F.map_keys("r")
    differs = both.where((F.size(F.array_intersect(lk, rk)) > 0) & ((F.size(F.array_except(lk, rk)) > 0) | (F.size(F.array_except(rk, lk)) > 0)))
    return differs.orderBy("rank").limit(limit).select("from_path", "related_path", "anchor", "related", names(F.col("l"), F.array_intersect(lk, rk)).alias("shared"), names(F.col("l"), F.array_except(lk, rk)).alias("only_anchor"), names(F.col("r"), F.array_except(rk, lk)).alias("only_related"))


def symbol_card(symbols: DataFrame, edges: DataFrame, name: str, limit: int, path: str | None = None) -> DataFrame:
    """part, place, path, kind, name, relation, other_path, line: definitions of a name, other symbols like it, its direct calls and its relations.

    Symbols named exactly, qualified first, are the definitions; without any the best that begins with the name or holds it is. Homonyms in
    other files are left out of the relations. path: only symbols of this file and edges that touch it.
    """
    low = name.lower()
    q, n = F.lower(F.coalesce("qualified_name", F.lit(""))), F.lower(F.coalesce("name", F.lit("")))
    rank = F.when(q == low, 0).when(n == low, 1).when(q.startswith(low), 2).otherwise(3)
    found = symbols.where(n.contains(low) | q.contains(low))
    if path:
        found = found.where(F.col("path") == path)
    found = found.withColumn("match", rank).withColumn("place", F.row_number().over(Window.orderBy("match", F.desc("active"), "path", "start_line", "id"))).where(F.col("place") <= limit)
    best = found.agg(F.min(F.when(F.col("match") == 0, 0)).alias("q"), F.min(F.when(n == low, 1)).alias("n"))  # one row
    marked = found.crossJoin(F.broadcast(best)).withColumn("primary", F.when(F.col("q").isNotNull(), F.col("match") == 0).when(F.col("n").isNotNull(), n == low).otherwise(F.col("place") == 1))
    none = lambda kind: F.lit(None).cast(kind)
    card = marked.select(F.when(F.col("primary"), "definition").otherwise("alternative").alias("part"), "place", "project", "path", "kind", F.coalesce("qualified_name", "name").alias("name"), none("string").alias("relation"), none("string").alias("other_path"), F.col("start_line").alias("line"))
    card = card.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("place"))).where((F.col("part") == "definition") & (F.col("place") <= DEFINITIONS) | (F.col("part") == "alternative") & (F.col("place") <= ALTERNATIVES))
    exact = marked.where("primary and (q is not null or n is not null)").select("project", "path").distinct()
    is_source = (F.lower(F.coalesce("source_name", F.lit(""))) == low) | (F.lower(F.coalesce("source_qualified_name", F.lit(""))) == low)
    is_target = (F.lower(F.coalesce("target_name", F.lit(""))) == low) | (F.lower(F.coalesce("target_qualified_name", F.lit(""))) == low)
    links = edges.where(is_source | is_target)
    if path:
        links = links.where((F.col("source_path") == path) | (F.col("target_path") == path))
    links = links.withColumn("is_source", is_source).withColumn("is_target", is_target)
    homes = exact.withColumn("home", F.lit(True))
    links = links.join(homes.select("project", F.col("path").alias("source_path"), F.col("home").alias("source_home")), ["project", "source_path"], "left").join(homes.select("project", F.col("path").alias("target_path"), F.col("home").alias("target_home")), ["project", "target_path"], "left")
    kept = links.where((F.col("is_source") & F.col("source_home").isNotNull()) | (F.col("is_target") & (F.col("target_home").isNotNull() | F.col("target_path").isNull())))
    target = F.coalesce("target_qualified_name", "target_name")
    order = ["relation", "source_path", "line", "id"]
    calls = kept.where(F.col("is_source") & (F.col("relation") == "calls")).withColumn("callee", target).withColumn("k", F.row_number().over(Window.partitionBy("callee", "target_path").orderBy(*order))).where("k = 1 and callee is not null")
    calls = calls.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= DIRECT_CALLS).select(F.lit("call").alias("part"), "place", "project", F.col("source_path").alias("path"), none("string").alias("kind"), F.col("callee").alias("name"), "relation", F.col("target_path").alias("other_path"), "line")
    way = F.when(F.col("is_source"), "outgoing").otherwise("incoming")
    once = Window.partitionBy(way, "relation", "source_path", "source_qualified_name", "target_path", target).orderBy(*order)
    relations = kept.withColumn("k", F.row_number().over(once)).where("k = 1").withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("is_source"), 0).otherwise(1), *order))).where(F.col("place") <= limit)
    relations = relations.select(way.alias("part"), "place", "project", F.col("source_path").alias("path"), none("string").alias("kind"), F.when(F.col("is_source"), target).otherwise(F.coalesce("source_qualified_name", "source_name")).alias("name"), "relation", F.col("target_path").alias("other_path"), "line")
    return card.unionByName(calls).unionByName(relations)
