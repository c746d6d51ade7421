"""Branches of a flow beyond its links: dispatched overrides, schedulers, consumers by name, generated contracts; roles, impact and their diagnosis.

Names are carried to texts as one array per project, so that no pair of a name and a text is made that doesn't match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.graph import FLOW_RELATIONS, RESOURCE_RELATIONS, UNRESOLVED, bare_name
from quernstone.session import cut

# Scores of the reasons, how many files each yields, words that call for a role, and what makes an impact.
EDGE_FUNCTION, OVERRIDE, RESOURCE_CONSUMER, SCHEDULER, LEXICAL_CONSUMER, GENERATED, INVOKER = 78, 72, 57, 60, 59, 50, 56
NEWEST_OVERRIDES, MOST_SCHEDULES, MOST_CONSUMERS, MOST_GENERATED = 6, 4, 12, 6
LANES = ("implementation", "persistence", "retries", "scheduling", "constraints", "tests")
ROLE_WORDS = {"calculation": ("calcul", "saldo", "balance", "entitlement", "prorrat"), "writers": ("writer", "escrib", "crea", "modif", "aprob", "cancel"), "rpc": ("rpc", "sql"), "sql": ("rpc", "sql"), "tests": ("test", "prueba")}
CAUSAL_ROLES = ("calculation", "lifecycle", "rpc", "sql", "writers", "readers")
IMPACT_KINDS = ("incoming_edge", "outgoing_edge", "shared_resource", "resolved_edge_function", "rpc_consumer", "sql_override_chain", "cache_invalidator", "generated_contract_consumer", "rpc_consumer_lexical", "inheritance_chain", "dispatch_override_chain")
WRITES = ("update", "into", "delete from")
SEVERE = ("no_evidence", "missing_roles", "incomplete_sql_lineage")

REASON = ["project", "path", "score", "kind", "depth", "confidence"]


def _is_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def reason_rows(df: DataFrame, score, kind, confidence="lexical", depth=0) -> DataFrame:
    """project, path, score, kind, depth, confidence."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("project", "path", as_column(score).cast("int").alias("score"), as_column(kind).alias("kind"), as_column(depth).cast("int").alias("depth"), as_column(confidence).alias("confidence"))


def walk(seeds: DataFrame, edges: DataFrame, files: DataFrame, terms: list[str], hops: int = 2) -> DataFrame:
    """Reasons of the files reached from the seeds (project, path) in up to ``hops`` steps.

    Outgoing steps score 62 - 12 d, incoming 58 - 12 d, a function invoked by name whose file lies where its name says 78 - 8 d. Steps
    over extends and overrides are an inheritance_chain; an override of what a frontier's method, named by the question, calls is a
    dispatch_override_chain. files: project, path. Every file counts with its best reason of each kind.
    """
    # The edges enter every step and are written once.
    flow = cut(edges.where(F.col("relation").isin(*FLOW_RELATIONS)).select("project", "source_path", "source_name", "relation", "target_name", "target_path", "target_qualified_name", "resolution_confidence"))
    places = files.where(F.col("path").rlike(r"(^|/)functions/[^/]+/index\.(ts|js)$")).select("project", "path", F.regexp_extract("path", r"functions/([^/]+)/index\.", 1).alias("target_name")).distinct()
    seen = seeds.select("project", "path").distinct()
    frontier, out = seen, []
    for depth in range(hops):
        outgoing = flow.join(frontier.withColumnRenamed("path", "source_path"), ["project", "source_path"], "left_semi")
        incoming = flow.join(frontier.withColumnRenamed("path", "target_path"), ["project", "target_path"], "left_semi").where(F.col("resolution_confidence") != UNRESOLVED)
        dispatched = outgoing.where((F.col("relation") == "calls") & F.col("target_qualified_name").isNotNull() & F.lower("source_name").isin(*terms or [""])).select("project", "target_qualified_name", F.lit(True).alias("named")).distinct()
        inherits = F.col("relation").isin("extends", "overrides")
        invoked = outgoing.where((F.col("relation") == "invokes_edge_function") & F.col("target_path").isNull()).join(places, ["project", "target_name"]).select("project", "path")
        steps = [
            reason_rows(invoked, EDGE_FUNCTION - 8 * depth, "resolved_edge_function", "convention_verified", depth),
            reason_rows(outgoing.where(F.col("target_path").isNotNull() & (F.col("resolution_confidence") != UNRESOLVED)).withColumn("path", F.col("target_path")), 62 - 12 * depth, F.when(inherits, "inheritance_chain").otherwise("outgoing_edge"), F.col("resolution_confidence"), depth),
            reason_rows(incoming.join(dispatched, ["project", "target_qualified_name"], "left").withColumn("path", F.col("source_path")), 58 - 12 * depth, F.when(F.col("named") & (F.col("relation") == "overrides"), "dispatch_override_chain").when(inherits, "inheritance_chain").otherwise("incoming_edge"), F.col("resolution_confidence"), depth),
        ]
        found = reduce(DataFrame.unionByName, steps).distinct()
        out.append(found)
        frontier = found.select("project", "path").distinct().join(seen, ["project", "path"], "left_anti")
        seen = seen.unionByName(frontier)
    best = F.struct("score", (-F.col("depth")).alias("d"), "confidence")
    return reduce(DataFrame.unionByName, out).groupBy("project", "path", "kind").agg(F.max(best).alias("b")).select("project", "path", "b.score", "kind", (-F.col("b.d")).alias("depth"), "b.confidence")


def names_by_project(names: DataFrame) -> DataFrame:
    """project, names: the distinct names (project, name) of each project in an array; those of a question's seeds, so a bounded list."""
    return names.where("name is not null and name <> ''").groupBy("project").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names"))


def mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """project, path, name, first_line, last_line: the files in whose texts each name occurs, in any case. chunks are filtered by the caller."""
    low = F.lower("content")
    held = chunks.where("content is not null").join(names_by_project(names), "project").select("project", "path", "start_line", "end_line", F.explode(F.filter("names", lambda n: low.contains(n))).alias("name"))
    return held.groupBy("project", "path", "name").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


def _firsts(found: DataFrame, most: int, *order) -> DataFrame:
    return found.withColumn("k", F.row_number().over(Window.partitionBy("project", "name").orderBy(*order))).where(F.col("k") <= most)


def resources_of(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """project, name: the resources that the seeds' files touch, without their schema."""
    own = edges.where(F.col("relation").isin(*RESOURCE_RELATIONS)).join(seeds.select("project", F.col("path").alias("source_path")), ["project", "source_path"], "left_semi")
    return own.select("project", F.element_at(F.split(bare_name(F.col("target_name")), r"\."), -1).alias("name")).distinct()


def resource_consumers(resources: DataFrame, edges: DataFrame) -> DataFrame:
    """Reasons of files that call a resource as a remote procedure."""
    calls = edges.where("relation = 'calls_rpc'").select("project", F.col("source_path").alias("path"), bare_name(F.col("target_name")).alias("name"), "resolution_confidence")
    found = calls.join(resources, ["project", "name"], "left_semi").groupBy("project", "path").agg(F.min("resolution_confidence").alias("confidence"))
    return reason_rows(found, RESOURCE_CONSUMER, "rpc_consumer", F.col("confidence"))


def override_chain(resources: DataFrame, scripts: DataFrame) -> DataFrame:
    """Reasons of the newest scripts that define or patch a resource: those that hold its name and a definition, the last paths first."""
    patches = scripts.where(F.lower("content").contains("pg_get_functiondef") | F.lower("content").contains("create or replace function"))
    newest = _firsts(mentions(patches, resources), NEWEST_OVERRIDES, F.desc("path"))
    return reason_rows(newest.select("project", "path").distinct(), OVERRIDE, "sql_override_chain", "definition_or_patch_lexical")


def lexical_consumers(names: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Reasons of code files that hold the name of a procedure that the question speaks of."""
    relevant = names.where(_is_any(F.lower("name"), terms))
    found = _firsts(mentions(chunks.where((F.col("authority") == "code") & F.col("path").rlike(r"\.tsx?$")), relevant), MOST_CONSUMERS, "path")
    return reason_rows(found.select("project", "path").distinct(), LEXICAL_CONSUMER + 8, "rpc_consumer_lexical")


def generated_contracts(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Reasons of generated files that hold a procedure's name."""
    found = _firsts(mentions(chunks.where("authority = 'generated'"), names), MOST_GENERATED, "path")
    return reason_rows(found.select("project", "path").distinct(), GENERATED, "generated_contract_consumer")


def schedulers(functions: DataFrame, edges: DataFrame, scripts: DataFrame) -> DataFrame:
    """Reasons of files that invoke the functions (project, name), and of scripts that schedule them or post to them."""
    low = F.lower("content")
    calls = edges.where("relation = 'invokes_edge_function'").select("project", F.col("source_path").alias("path"), F.lower("target_name").alias("name"), "resolution_confidence")
    wanted = functions.select("project", F.lower("name").alias("name")).distinct()
    invoked = calls.join(wanted, ["project", "name"], "left_semi").groupBy("project", "path").agg(F.min("resolution_confidence").alias("confidence"))
    scheduled = _firsts(mentions(scripts.where(low.contains("cron.schedule") | low.contains("net.http_post")), functions), MOST_SCHEDULES, "path")
    best = scheduled.groupBy("project", "path").agg(F.max(F.col("name").contains("retry").cast("int")).alias("retry"))
    return reason_rows(invoked, INVOKER, "edge_function_invoker", F.col("confidence")).unionByName(reason_rows(best, SCHEDULER + 10 * F.col("retry"), "scheduler_lexical"))


def all_reasons(base: DataFrame, seeds: DataFrame, edges: DataFrame, symbols: DataFrame, chunks: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """project, path, score, kind, depth, confidence: every reason of a flow: those of ``flow.reasons`` (base), its links told apart, and the branches here.

    chunks: with authority. files: project, path. Procedures are those that the seeds' files and scripts reached define.
    """
    lexical = F.when(F.col("kind").isin("constraint_candidate", "query_related_ui"), "lexical").when(F.col("kind") == "cache_invalidator", "domain_lexical").when(F.col("kind") == "sql_override_chain", "definition_or_patch_lexical")
    told = reason_rows(base.where("kind <> 'linked'"), F.col("score"), F.col("kind"), lexical)
    links = walk(seeds, edges, files, terms)
    resources = resources_of(seeds, edges)
    reached = seeds.select("project", "path").union(links.select("project", "path")).distinct()
    scripts = chunks.where(F.col("path").endswith(".sql"))
    procedures = symbols.where("kind = 'function'").join(reached.where(F.col("path").endswith(".sql")), ["project", "path"], "left_semi").select("project", F.element_at(F.split(bare_name(F.col("name")), r"\."), -1).alias("name")).distinct()
    functions = reached.select("project", F.regexp_extract("path", r"functions/([^/]+)/", 1).alias("name")).where("name <> ''").distinct()
    parts = (told, links, resource_consumers(resources, edges), override_chain(resources, scripts), lexical_consumers(procedures, chunks, terms), generated_contracts(procedures, chunks), schedulers(functions, edges, scripts))
    return reduce(DataFrame.unionByName, parts)


def file_roles(files: DataFrame, edges: DataFrame, question: str) -> DataFrame:
    """project, path, roles: what a file (project, path, authority, kinds) does: joined in order; empty if nothing tells.

    Relations of its edges tell readers, writers and callers; the question's words and the path tell calculation and lifecycle.
    """
    operation = F.get_json_object("metadata", "$.operation")
    own = edges.where(F.col("relation").isin(*RESOURCE_RELATIONS)).groupBy("project", F.col("source_path").alias("path")).agg(
        F.bool_or((F.col("relation") == "writes_table") | ((F.col("relation") == "accesses_table") & F.coalesce(operation.isin(*WRITES), F.lit(False)))).alias("w"),
        F.bool_or(F.col("relation").isin("reads_table", "accesses_table")).alias("r"),
        F.bool_or(F.col("relation") == "calls_rpc").alias("c"),
    )
    low, asked = F.lower("path"), question.lower()
    calculates = _is_any(low, ("payroll", "vacation", "balance", "entitlement", "absence")) if any(w in asked for w in ROLE_WORDS["calculation"]) else F.lit(False)
    lives = _is_any(low, ("absence", "workflow", "status")) if any(w in asked for w in ("crea", "modif", "aprob", "cancel", "lifecycle", "status")) else F.lit(False)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    roles = F.array(
        F.when(calculates, "calculation"), F.when(lives, "lifecycle"), F.when(is_(F.col("r")), "readers"), F.when(is_(F.col("c")), "rpc"),
        F.when(F.col("authority") == "schema_history", "sql"), F.when(F.col("authority") == "test", "tests"), F.when(is_(F.col("w")), "writers"),
    )
    return files.join(own, ["project", "path"], "left").select("project", "path", F.array_join(F.array_compact(roles), ",").alias("roles"))


def requested_roles(question: str) -> list[str]:
    """The roles that a question's words call for, in order."""
    low = question.lower()
    return sorted(role for role, words in ROLE_WORDS.items() if any(w in low for w in words))


def coverage(evidence: DataFrame, question: str) -> DataFrame:
    """project, lanes_missing, roles_present, roles_missing: what a flow's evidence (project, lane, roles) lacks of what is expected, by name."""
    array = lambda items: F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")
    own = evidence.groupBy("project").agg(F.collect_set("lane").alias("lanes"), F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("roles", ","), lambda r: r != "")))).alias("roles"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return own.select("project", text(F.array_except(array(sorted(LANES)), "lanes")).alias("lanes_missing"), text(F.col("roles")).alias("roles_present"), text(F.array_except(array(requested_roles(question)), "roles")).alias("roles_missing"))


def impact(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, path, categories, action, basis: the files of a flow (project, path, authority, roles, kinds) that a change may touch, and why.

    categories come of path, authority, roles and text; a file with neither a category nor a reason of impact has no row.
    """
    low = F.lower("content")
    cached = chunks.where("content is not null").groupBy("project", "path").agg(F.bool_or(low.contains("invalidatequeries") | low.contains("querykey")).alias("cached"))
    path, roles, kinds = F.lower("path"), F.split("roles", ","), F.split("kinds", ",")
    has = lambda r: F.array_contains(roles, r)
    page = (path.contains("/components/") | path.contains("/pages/")) & ~path.contains("/components/ui/")
    categories = F.array_compact(
        F.array(
            F.when(path.contains("retry") | path.contains("/workers/") | path.contains("/jobs/"), "async"), F.when(F.coalesce("cached", F.lit(False)), "cache"), F.when(has("rpc"), "integration"), F.when(has("readers"), "reader"),
            F.when(F.col("authority") == "schema_history", "schema"), F.when(F.col("authority") == "test", "test"), F.when((F.col("authority") == "generated") | path.endswith("types.ts"), "types"), F.when(page, "ui"), F.when(has("writers"), "writer"),
        )
    )
    basis = F.array_intersect(F.array_sort(kinds), F.array(*map(F.lit, IMPACT_KINDS)))
    rows = evidence.join(cached, ["project", "path"], "left").withColumn("c", categories).withColumn("b", basis).where((F.size("c") > 0) | (F.size("b") > 0))
    likely = F.arrays_overlap(roles, F.array(*map(F.lit, ("calculation", "lifecycle", "writers", "rpc")))) | F.arrays_overlap("c", F.array(*map(F.lit, ("ui", "cache", "test"))))
    return rows.select(
        "project", "path", F.when(F.size("c") > 0, F.array_join("c", ",")).otherwise("dependency").alias("categories"), F.when(likely, "likely_modify").otherwise("review").alias("action"),
        F.when(F.size("b") > 0, F.array_join("b", ",")).otherwise("role_match").alias("basis"),
    )


def relevant_procedures(names: DataFrame, edges: DataFrame, terms: list[str]) -> DataFrame:
    """project, name: procedures (project, name) that the question names, with direct wrappers that it names too, if they read or have a caller."""
    short = names.select("project", F.element_at(F.split(F.lower("name"), r"\."), -1).alias("name")).where(_is_any(F.col("name"), terms)).distinct()
    wraps = edges.where("relation = 'calls_sql'").select("project", bare_name(F.col("target_name")).alias("name"), F.element_at(F.split(F.lower("source_name"), r"\."), -1).alias("wrapper"))
    wrappers = wraps.join(short, ["project", "name"], "left_semi").where(_is_any(F.col("wrapper"), terms)).select("project", F.col("wrapper").alias("name"))
    called = edges.where("relation = 'calls_rpc'").select("project", bare_name(F.col("target_name")).alias("name"), F.lit(True).alias("called")).distinct()
    return short.unionByName(wrappers).distinct().join(called, ["project", "name"], "left").where(F.col("name").startswith("get_") | F.col("called")).select("project", "name")


def consumers(procedures: DataFrame, chunks: DataFrame) -> DataFrame:
    """project, name, path, keys: the code files that hold a procedure's name, with the cache keys they use, joined in order."""
    used = r"(?i)queryKey\s*:\s*\[\s*['\"]([^'\"]+)['\"]"
    code = chunks.where((F.col("authority") == "code") & F.col("content").isNotNull())
    found = mentions(code, procedures).select("project", "path", "name")
    keys = code.select("project", "path", F.explode(F.regexp_extract_all("content", F.lit(used), F.lit(1))).alias("key")).groupBy("project", "path").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    return found.join(keys, ["project", "path"], "left").select("project", "name", "path", F.coalesce("keys", F.lit("")).alias("keys"))


def diagnose(evidence: DataFrame, reasons: DataFrame, flow: DataFrame) -> DataFrame:
    """project, quality, warnings, strengths and the shape of each flow: counts by lane, role, authority, anchor, reason and confidence, and ratios.

    evidence: project, path, lane, authority, roles, kinds. reasons: project, path, kind, confidence of that evidence. flow: a row per
    project with lanes_missing, roles_missing, uninvalidated_keys, lineage_missing, facets_missing (joined names), consumers,
    lineage_entries and shared_consumers. Maps are joined as name:count in order of name. A flow without evidence is weak.
    """

    def counts(df: DataFrame, column: Column, name: str) -> DataFrame:
        one = df.select("project", column.alias("v")).where("v is not null and v <> ''").groupBy("project", "v").agg(F.count(F.lit(1)).alias("n"))
        entries = F.array_sort(F.collect_list(F.struct("v", "n")))
        return one.groupBy("project").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["v"], F.lit(":"), e["n"].cast("string"))), ",").alias(name), F.max("n").alias(f"{name}_most"), F.array_join(F.filter(F.transform(entries, lambda e: F.when(e["n"] == 1, e["v"])), lambda x: x.isNotNull()), ",").alias(f"{name}_single"))

    roles = evidence.select("project", F.explode(F.split("roles", ",")).alias("role"))
    anchors = evidence.where(F.array_contains(F.split("kinds", ","), "search_anchor"))
    confidence = F.coalesce("confidence", F.lit("not_reported"))
    totals = evidence.groupBy("project").agg(F.count(F.lit(1)).alias("evidence_items"))
    seeds = anchors.groupBy("project").agg(F.count(F.lit(1)).alias("anchor_files"), F.count_if(F.col("authority") == "test").alias("test_anchors"))
    told = reasons.groupBy("project").agg(F.count_if(confidence.contains("lexical")).alias("lexical"), F.count_if(confidence != "not_reported").alias("reported"))
    out = flow
    for one in (
        totals, seeds, told, counts(evidence, F.col("lane"), "lane_counts"), counts(roles, F.col("role"), "role_counts"), counts(evidence, F.col("authority"), "authority_counts"), counts(anchors, F.col("authority"), "anchor_authority_counts"),
        counts(reasons, F.col("kind"), "reason_counts"), counts(reasons, confidence, "confidence_counts"),
    ):
        out = out.join(one, "project", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    t = lambda c: F.coalesce(c, F.lit(""))
    total = n("evidence_items")
    dominant = F.when(total > 0, F.col("lane_counts_most") / total).otherwise(0.0)
    lexical = F.when(n("reported") > 0, F.col("lexical") / F.col("reported")).otherwise(0.0)
    warnings = F.array_compact(
        F.array(
            F.when(total == 0, "no_evidence"), F.when((dominant >= 0.6) & (total >= 5), "lane_concentration"), F.when((lexical >= 0.5) & (n("reported") >= 4), "lexical_dominance"),
            F.when((n("anchor_files") >= 2) & (F.col("test_anchors") == F.col("anchor_files")), "test_anchor_dominance"), F.when(t("role_counts_single") != "", "thin_role_coverage"), F.when(t("roles_missing") != "", "missing_roles"),
            F.when(t("uninvalidated_keys") != "", "cache_review_required"), F.when(t("lineage_missing") != "", "incomplete_sql_lineage"), F.when(t("facets_missing") != "", "missing_question_facets"),
        )
    )
    strengths = F.array_compact(F.array(F.when(n("consumers") > 0, "consumer_fanout"), F.when(n("lineage_entries") > 0, "sql_lineage"), F.when((t("roles_missing") == "") & (t("lanes_missing") == "") & (total > 0), "nominal_coverage")))
    shaped = out.withColumn("w", warnings).withColumn("s", strengths)
    quality = F.when(F.arrays_overlap("w", F.array(*map(F.lit, SEVERE))), "weak").when(F.size("w") > 0, "review").otherwise("healthy")
    names = ("lane_counts", "role_counts", "authority_counts", "anchor_authority_counts", "reason_counts", "confidence_counts")
    return shaped.select(
        "project", quality.alias("quality"), F.array_join("w", ",").alias("warnings"), F.array_join("s", ",").alias("strengths"), total.alias("evidence_items"), n("anchor_files").alias("anchor_files"), *[t(c).alias(c) for c in names],
        F.round(lexical, 3).alias("lexical_relation_ratio"), F.round(dominant, 3).alias("dominant_lane_ratio"), n("consumers").alias("distinct_rpc_consumers"), n("lineage_entries").alias("sql_lineage_entries"), n("shared_consumers").alias("shared_dependency_consumers"), t("role_counts_single").alias("thin_roles"),
    )
