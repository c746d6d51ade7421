"""Questions to the graph of symbols and edges: set-based, each one plan for all keys instead of lookups in a loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import cut

# Relations that carry flow, and those whose target is a shared resource.
FLOW_RELATIONS = ("calls", "imports", "calls_rpc", "invokes_edge_function", "reads_table", "writes_table", "accesses_table", "extends", "overrides")
RESOURCE_RELATIONS = ("calls_rpc", "reads_table", "writes_table", "accesses_table")
UNRESOLVED = "unresolved"
CLASSIFIER = r"^(?:is|has|can|supports|accepts|allows|validates?)(?:[A-Z0-9_]|$)"


def bare_name(name: Column) -> Column:
    """A name without its public. prefix, in lower case."""
    return F.regexp_replace(F.lower(name), r"^public\.", "")


#: Lines of a bin: what lies in some lines meets only what reaches into the same bin.
BIN = 256


def within_lines(spans: DataFrame, points: DataFrame) -> DataFrame:
    """spans (project, path, start_line, end_line, ...) with the points (project, path, line, ...) that lie in them.

    Both meet by file and bin of lines, so a file of many spans and points doesn't pair all of them. Spans without lines hold nothing.
    """
    own = spans.where("start_line is not null and end_line >= start_line")
    binned = own.withColumn("__bin", F.explode(F.sequence((F.col("start_line") / BIN).cast("int"), (F.col("end_line") / BIN).cast("int"))))
    at = points.withColumn("__bin", (F.col("line") / BIN).cast("int"))
    return binned.join(at, ["project", "path", "__bin"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("__bin")


def latest_definitions(symbols: DataFrame, prefix: str) -> DataFrame:
    """The symbols under a folder of dated scripts, with active 1 for the newest of each name and 0 for the others; tables keep their flag.

    Newest is the greatest path, then the greatest id. A window per (project, name): a name's versions, never a project's rows.
    """
    own = symbols.where(F.col("path").startswith(prefix) & (F.col("kind") != "table"))
    order = Window.partitionBy("project", F.lower("name")).orderBy(F.desc("path"), F.desc("id"))
    return own.withColumn("active", (F.row_number().over(order) == 1).cast("int"))


def resolve_targets(edges: DataFrame, symbols: DataFrame, relations: tuple[str, ...] = ("calls_rpc", "calls_sql")) -> DataFrame:
    """id, target_path, resolution_confidence of edges without target path: resolved where exactly one file defines an active function of the name."""
    keys = symbols.where((F.col("kind") == "function") & (F.col("active") == 1)).select(
        "project", "path", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name"), F.element_at(F.split(F.lower("qualified_name"), r"\."), -1)))).alias("key")
    )
    unique = keys.groupBy("project", "key").agg(F.count_distinct("path").alias("n"), F.min("path").alias("found")).where("n = 1").select("project", "key", "found")
    open_edges = edges.where(F.col("relation").isin(*relations) & F.col("target_path").isNull()).select("id", "project", F.lower("target_name").alias("key"), bare_name(F.col("target_name")).alias("bare"), "resolution_confidence")
    first = open_edges.join(unique, ["project", "key"], "left").withColumnRenamed("found", "f1")
    both = first.join(unique.select("project", F.col("key").alias("bare"), F.col("found").alias("f2")), ["project", "bare"], "left")
    found = F.coalesce("f1", "f2")
    return both.select("id", found.alias("target_path"), F.when(found.isNotNull(), "active_sql").otherwise(F.col("resolution_confidence")).alias("resolution_confidence"))


def covering_symbols(spans: DataFrame, symbols: DataFrame) -> DataFrame:
    """Of each span (span_id, project, path, start_line, end_line): the symbol that covers most of it.

    An equi join on the file with the overlap as residual condition; of the overlapping symbols other than modules the largest
    overlap wins, then the smallest symbol, then the first line, then id. Spans without one give no rows.
    """
    s = symbols.where(F.col("kind") != "module").select("project", "path", F.col("id").alias("symbol_id"), "name", "kind", F.col("start_line").alias("s0"), F.col("end_line").alias("s1"))
    joined = spans.join(s, ["project", "path"]).where((F.col("s0") <= F.col("end_line")) & (F.col("s1") >= F.col("start_line")))
    overlap = F.least("s1", "end_line") - F.greatest("s0", "start_line") + 1
    best = F.struct(overlap.alias("overlap"), (-(F.col("s1") - F.col("s0"))).alias("smaller"), (-F.col("s0")).alias("earlier"), (-F.col("symbol_id")).alias("first"))
    picked = joined.groupBy("span_id").agg(F.max_by(F.struct("symbol_id", "name", "kind"), best).alias("s"), F.max(overlap).alias("overlap"))
    return picked.select("span_id", "s.symbol_id", "s.name", "s.kind", F.col("overlap").cast("bigint").alias("overlap"))


def callers_with_chunks(edges: DataFrame, chunks: DataFrame, target: str) -> DataFrame:
    """edge_id, chunk_id: resolved calls of a target, with the chunks whose lines hold the call."""
    calls = edges.where((F.col("relation") == "calls") & (F.col("target_name") == target) & (F.col("resolution_confidence") != UNRESOLVED)).select(F.col("id").alias("edge_id"), "project", F.col("source_path").alias("path"), "line")
    held = chunks.select(F.col("id").alias("chunk_id"), "project", "path", "start_line", "end_line")
    return within_lines(held, calls).select("edge_id", "chunk_id")


def lookup(symbols: DataFrame, authority: DataFrame, name: str, limit: int) -> DataFrame:
    """Symbols of a name: exactly qualified, then of the exact name, then beginning with it, then holding it; active and earlier paths first."""
    low = name.lower()
    q, n = F.lower("qualified_name"), F.lower("name")
    rank = F.when(q == low, 0).when(n == low, 1).when(n.startswith(low), 2).otherwise(3)
    hits = symbols.where(n.contains(low) | q.contains(low)).withColumn("match_rank", rank)
    auth = authority.select("project", "path", "authority")
    return hits.join(auth, ["project", "path"], "left").orderBy("match_rank", F.desc("active"), "project", "path", "start_line", "id").limit(limit).select("id", "project", "path", "kind", "name", "match_rank", F.coalesce("authority", F.lit("unknown")).alias("authority"))


def file_neighbours(edges: DataFrame) -> DataFrame:
    """project, path, other, outgoing: distinct resolved links between two files, seen from either side."""
    links = edges.where(F.col("relation").isin(*FLOW_RELATIONS) & F.col("target_path").isNotNull() & (F.col("resolution_confidence") != UNRESOLVED) & (F.col("target_path") != F.col("source_path")))
    links = links.select("project", "source_path", "target_path").distinct()
    out = links.select("project", F.col("source_path").alias("path"), F.col("target_path").alias("other"), F.lit(True).alias("outgoing"))
    return out.unionByName(links.select("project", F.col("target_path").alias("path"), F.col("source_path").alias("other"), F.lit(False).alias("outgoing")))


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """project, path, score: files reached from the seeds (project, path) in up to ``hops`` steps; the best way to a file counts.

    Outgoing steps score 62 - 12 d, incoming ones 58 - 12 d, d steps away, seeds 100. A frontier holds only files not seen
    before, so the work is bounded by the links of the files reached. Links and seeds enter every step: each is written once.
    """
    links = cut(file_neighbours(edges))
    seen = cut(seeds.select("project", "path").distinct()).withColumn("score", F.lit(100))
    frontier = seen.select("project", "path")
    for depth in range(1, hops + 1):
        score = F.when(F.col("outgoing"), 62 - 12 * (depth - 1)).otherwise(58 - 12 * (depth - 1))
        found = frontier.join(links, ["project", "path"]).groupBy("project", F.col("other").alias("path")).agg(F.max(score).alias("score"))
        found = found.join(seen.select("project", "path"), ["project", "path"], "left_anti")
        seen = seen.unionByName(found)
        frontier = found.select("project", "path")
    return seen


def shared_resources(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """project, path, resources: other files that touch a resource which a seed file touches."""
    uses = edges.where(F.col("relation").isin(*RESOURCE_RELATIONS)).select("project", F.col("source_path").alias("path"), bare_name(F.col("target_name")).alias("resource")).distinct()
    wanted = uses.join(seeds.select("project", "path").distinct(), ["project", "path"], "left_semi").select("project", "resource").distinct()
    others = uses.join(wanted, ["project", "resource"], "left_semi").join(seeds.select("project", "path"), ["project", "path"], "left_anti")
    return others.groupBy("project", "path").agg(F.count(F.lit(1)).alias("resources"))


def callee_hints(edges: DataFrame, least_callers: int, limit: int) -> DataFrame:
    """project, target_name, target_path, callers, first_caller: callees that several files call, most callers first."""
    calls = edges.where((F.col("relation") == "calls") & F.col("target_path").isNotNull() & (F.col("resolution_confidence") != UNRESOLVED))
    per_file = calls.groupBy("project", "target_name", "target_path", "source_path").agg(F.count(F.lit(1)).alias("n"))
    hints = per_file.groupBy("project", "target_name", "target_path").agg(F.count(F.lit(1)).alias("callers"), F.min("source_path").alias("first_caller"), F.sum("n").alias("calls"))
    return hints.where(F.col("callers") >= least_callers).orderBy(F.desc("callers"), F.desc("calls"), "project", "target_name", "target_path").limit(limit)


def anchor_calls(edges: DataFrame, symbols: DataFrame, least: int = 2) -> DataFrame:
    """symbol_id, name, callees: of each function or method the distinct names it calls within its lines, joined in order of name; at least ``least``."""
    owners = symbols.where(F.col("kind").isin("function", "method", "hook", "component")).select(F.col("id").alias("symbol_id"), "project", "path", "name", "start_line", "end_line")
    calls = edges.where(F.col("relation") == "calls").select("project", F.col("source_path").alias("path"), "line", "target_name")
    held = within_lines(owners, calls).select("symbol_id", "name", "target_name").distinct()
    grouped = held.groupBy("symbol_id", "name").agg(F.array_sort(F.collect_list("target_name")).alias("callees"))
    return grouped.where(F.size("callees") >= least)


def contract_differences(edges: DataFrame, source: str = "source_qualified_name") -> DataFrame:
    """project, left_source, right_source, shared, only_left, only_right (joined names): sources of one file whose sets of predicate callees overlap but differ."""
    calls = edges.where((F.col("relation") == "calls") & F.col("target_name").rlike(CLASSIFIER)).select("project", "source_path", F.col(source).alias("source"), "target_name")
    sets = calls.where("source is not null").groupBy("project", "source_path", "source").agg(F.array_sort(F.collect_set("target_name")).alias("names"))
    left = sets.select("project", "source_path", F.col("source").alias("left_source"), F.col("names").alias("l"))
    right = sets.select("project", "source_path", F.col("source").alias("right_source"), F.col("names").alias("r"))
    # Only sources that share a name meet.
    one = lambda df, source, names: df.select("project", "source_path", source, F.explode(names).alias("name"))
    meet = one(left, "left_source", "l").join(one(right, "right_source", "r"), ["project", "source_path", "name"]).where("left_source < right_source").select("project", "source_path", "left_source", "right_source").distinct()
    pairs = meet.join(left, ["project", "source_path", "left_source"]).join(right, ["project", "source_path", "right_source"]).where(F.col("l") != F.col("r"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return pairs.select("project", "source_path", "left_source", "right_source", text(F.array_intersect("l", "r")).alias("shared"), text(F.array_except("l", "r")).alias("only_left"), text(F.array_except("r", "l")).alias("only_right"))


def lineage_of(symbols: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """project, name, path, kind, first_line, last_line: where each name (project, name) is defined or, outside its definitions, mentioned in scripts.

    Names are carried to the scripts as one array per project; they are a question's, so a bounded list.
    """
    wanted = names.select("project", F.lower("name").alias("name")).where("name <> ''").distinct()
    own = symbols.withColumn("lower_name", F.lower("name")).join(wanted.withColumnRenamed("name", "lower_name"), ["project", "lower_name"], "left_semi")
    defined = own.groupBy("project", F.col("lower_name").alias("name"), "path").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    listed = wanted.groupBy("project").agg(F.collect_set("name").alias("names"))
    low = F.lower("content")
    held = chunks.where(F.col("path").endswith(".sql") & F.col("content").isNotNull()).join(listed, "project").select("project", "path", "start_line", "end_line", F.explode(F.filter("names", lambda n: low.contains(n))).alias("name"))
    patched = held.groupBy("project", "name", "path").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).join(defined.select("project", "name", "path"), ["project", "name", "path"], "left_anti")
    return defined.withColumn("kind", F.lit("definition")).unionByName(patched.withColumn("kind", F.lit("dynamic_patch"))).select("project", "name", "path", "kind", "first_line", "last_line")


def lineage(symbols: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """project, path, kind, first_line, last_line: the lineage of one name in every project."""
    names = chunks.select("project").union(symbols.select("project")).distinct().withColumn("name", F.lit(name))
    return lineage_of(symbols, chunks, names).drop("name")


def dependency_levels(edges: DataFrame, roots: DataFrame, levels: int = 2) -> DataFrame:
    """project, name, level: names reached from the roots (project, name) over calls, each at its least level."""
    calls = edges.where(F.col("relation").isin("calls", "calls_sql", "calls_rpc")).select("project", F.col("source_name").alias("name"), F.col("target_name").alias("next")).where("name is not null and next is not null").distinct()
    seen = roots.select("project", "name").distinct().withColumn("level", F.lit(0))
    frontier = seen.select("project", "name")
    for level in range(1, levels + 1):
        found = frontier.join(calls, ["project", "name"]).select("project", F.col("next").alias("name")).distinct().join(seen.select("project", "name"), ["project", "name"], "left_anti")
        seen = seen.unionByName(found.withColumn("level", F.lit(level)))
        frontier = found
    return seen


def reverse_dependencies_of(edges: DataFrame, symbols: DataFrame, names: DataFrame) -> DataFrame:
    """project, name, source_path, source_name, calls, source_active: who refers to each name (project, name), and whether a symbol of the source's name is active there."""
    wanted = names.select("project", bare_name(F.col("name")).alias("name")).distinct()
    uses = edges.withColumn("name", bare_name(F.col("target_name"))).join(wanted, ["project", "name"], "left_semi").groupBy("project", "name", "source_path", "source_name").agg(F.count(F.lit(1)).alias("calls"))
    active = symbols.where("active = 1").select("project", F.col("path").alias("source_path"), F.col("name").alias("source_name")).distinct().withColumn("source_active", F.lit(1))
    return uses.join(active, ["project", "source_path", "source_name"], "left").withColumn("source_active", F.coalesce("source_active", F.lit(0)))


def reverse_dependencies(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """project, source_path, source_name, calls, source_active: as for many names, of one name in every project."""
    names = edges.select("project").distinct().withColumn("name", F.lit(name))
    return reverse_dependencies_of(edges, symbols, names).drop("name").select("project", "source_path", "source_name", "calls", "source_active")


def operation_edges(edges: DataFrame, operations: tuple[str, ...]) -> DataFrame:
    """The edges whose JSON metadata name one of the operations; metadata that are no JSON name none."""
    return edges.where(F.get_json_object("metadata", "$.operation").isin(*operations))


def query_keys(chunks: DataFrame) -> DataFrame:
    """project, path, key, invalidated: keys of cached queries that files use or invalidate."""
    used = r"(?i)queryKey\s*:\s*\[\s*['\"]([^'\"]+)['\"]"
    dropped = r"(?i)invalidateQueries\(\s*\{\s*queryKey\s*:\s*\[\s*['\"]([^'\"]+)['\"]"
    both = chunks.select("project", "path", F.regexp_extract_all("content", F.lit(used), F.lit(1)).alias("u"), F.regexp_extract_all("content", F.lit(dropped), F.lit(1)).alias("d"))
    keys = lambda c, flag: both.select("project", "path", F.explode(c).alias("key"), F.lit(flag).alias("invalidated"))
    return keys("u", False).unionByName(keys("d", True)).distinct()


def cache_key_audit(chunks: DataFrame) -> DataFrame:
    """project, key: keys that some file uses and none invalidates."""
    keys = query_keys(chunks)
    return keys.where("not invalidated").select("project", "key").distinct().join(keys.where("invalidated").select("project", "key"), ["project", "key"], "left_anti")


def scoped_cache_audit(chunks: DataFrame, scope: DataFrame, imports: DataFrame) -> DataFrame:
    """project, key: keys that files of the scope (project, path) use and neither they nor the files they import invalidate.

    imports: project, source_path, target_path.
    """
    keys, own = query_keys(chunks), scope.select("project", "path").distinct()
    helpers = imports.join(own.withColumnRenamed("path", "source_path"), ["project", "source_path"], "left_semi").select("project", F.col("target_path").alias("path"))
    used = keys.where("not invalidated").join(own, ["project", "path"], "left_semi").select("project", "key").distinct()
    dropped = keys.where("invalidated").join(own.union(helpers).distinct(), ["project", "path"], "left_semi").select("project", "key")
    return used.join(dropped, ["project", "key"], "left_anti")


def facet_coverage(chunks: DataFrame, facets: dict[str, tuple[str, ...]]) -> DataFrame:
    """project, facet, files: how many files of a project speak of each facet, 0 included; one pass for all facets."""
    low = F.lower("content")
    flags = {name: reduce(lambda a, b: a | b, [low.contains(word) for word in words]) for name, words in facets.items()}
    per_file = chunks.groupBy("project", "path").agg(*[F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()])
    per_project = per_file.groupBy("project").agg(*[F.count_if(name).alias(name) for name in facets])
    return per_project.select("project", F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("files")) for n in facets])).alias("f")).select("project", "f.facet", "f.files")


def lane_of(path: Column, authority: Column) -> Column:
    """What part a file plays: tests, scheduling, constraints, retries, persistence or implementation; the first that holds."""
    low = F.lower(path)
    return (
        F.when((authority == "test") | low.rlike(r"(^|/)(tests?|specs?|__tests__)/|\.test\.|_test\."), "tests")
        .when(low.rlike("schedul|cron"), "scheduling")
        .when((authority == "schema_history") & low.rlike("constraint|unique|index"), "constraints")
        .when(low.rlike("retry|retries|outbox|queue"), "retries")
        .when((authority == "schema_history") | low.endswith(".sql"), "persistence")
        .otherwise("implementation")
    )
