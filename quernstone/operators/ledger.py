"""Evidence: source read by ranges out of a snapshot's chunks, opened for symbols, edges and requests, named by what it holds.

A snapshot is the chunks, symbols and edges of one generation. Everything is set-based: requests of any number are one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.classify import is_safe_path
from quernstone.operators.graph import within_lines

#: Bytes of a symbol that is opened whole, lines of a preview behind its first, lines around a call within a larger symbol.
MOST_BYTES, PREVIEW_LINES, CALL_MARGIN = 100_000, 160, 80
# Kinds that hold code, what may be asked for, and how many symbols a request opens.
EXECUTABLE = ("function", "method", "hook", "component", "class", "trigger", "view", "policy")
OPERATIONS = ("symbol", "sql", "callers", "callees", "tests", "range")
MOST_SYMBOLS = 8


def read_ranges(ranges: DataFrame, chunks: DataFrame, key: str = "range_id") -> DataFrame:
    """key, content, first_line, last_line, missing: the lines of each range (key, project, path, start_line, end_line), from whatever windows hold them.

    Of two windows with the same line the one that starts first counts. missing: lines of the range that no window holds; a range of
    which there is none has no row. Lines, not windows, are grouped, so a range may cross any number of windows.
    """
    asked = ranges.select(key, "project", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    windows = chunks.where("content is not null").select("project", "path", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("s"), "content")
    last = F.col("s") + F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    held = asked.join(windows.withColumn("e", last), ["project", "path"]).where((F.col("s") <= F.col("b")) & (F.col("e") >= F.col("a")))
    low = F.greatest("a", "s")
    lines = F.slice(F.split("content", "\n", -1), (low - F.col("s") + 1).cast("int"), (F.least("b", "e") - low + 1).cast("int"))
    rows = held.select(key, "a", "b", "s", low.alias("low"), F.posexplode(lines).alias("at", "text")).select(key, "a", "b", "s", (F.col("low") + F.col("at")).alias("line"), "text")
    once = rows.groupBy(key, "line").agg(F.min_by("text", F.struct("s", "text")).alias("text"), F.first("a").alias("a"), F.first("b").alias("b"))
    whole = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"), F.first("a").alias("a"), F.first("b").alias("b"))
    return whole.select(key, F.array_join(F.col("l.text"), "\n").alias("content"), F.element_at("l.line", 1).alias("first_line"), F.element_at("l.line", -1).alias("last_line"), (F.col("b") - F.col("a") + 1 - F.size("l")).cast("bigint").alias("missing"))


def numbered(content: Column, first: Column) -> Column:
    return F.array_join(F.transform(F.split(content, "\n", -1), lambda line, i: F.concat((first + i).cast("string"), F.lit(": "), line)), "\n")


def evidence_id(snapshot: str, *parts: Column) -> Column:
    """A short name of evidence by its snapshot, place, kind and content."""
    return F.concat(F.lit("V"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(snapshot), *[p.cast("string") for p in parts]), 256), 1, 16))


def open_symbols(wanted: DataFrame, chunks: DataFrame, snapshot: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """evidence_id, project, path, start_line, end_line, kind, symbol, complete, content, of symbols (project, path, qualified_name, start_line, end_line).

    A symbol beyond ``most_bytes`` is shown by its first lines and marked incomplete. Equal evidence comes once.
    """
    keyed = wanted.select("project", "path", "qualified_name", "start_line", "end_line").distinct().withColumn("range_id", F.xxhash64("project", "path", "qualified_name", "start_line", "end_line"))
    read = keyed.join(read_ranges(keyed, chunks).select("range_id", "content", "missing"), "range_id")
    large = F.octet_length("content") > most_bytes
    shown = F.when(large, F.array_join(F.slice(F.split("content", "\n", -1), 1, PREVIEW_LINES + 1), "\n")).otherwise(F.col("content"))
    last = F.when(large, F.least(F.col("end_line"), F.col("start_line") + PREVIEW_LINES)).otherwise(F.col("end_line"))
    out = read.select("project", "path", "start_line", last.alias("end_line"), F.lit("symbol").alias("kind"), F.col("qualified_name").alias("symbol"), (~large & (F.col("missing") == 0)).alias("complete"), shown.alias("content"))
    return _named(out, snapshot)


def open_ranges(ranges: DataFrame, chunks: DataFrame, snapshot: str, kind: str = "range") -> DataFrame:
    """As open_symbols, of plain ranges (project, path, start_line, end_line, symbol)."""
    keyed = ranges.select("project", "path", "start_line", "end_line", "symbol").distinct().withColumn("range_id", F.xxhash64("project", "path", "start_line", "end_line", "symbol"))
    read = keyed.join(read_ranges(keyed, chunks).select("range_id", "content", "missing"), "range_id")
    return _named(read.select("project", "path", "start_line", "end_line", F.lit(kind).alias("kind"), "symbol", (F.col("missing") == 0).alias("complete"), "content"), snapshot)


def _named(rows: DataFrame, snapshot: str) -> DataFrame:
    named = rows.withColumn("evidence_id", evidence_id(snapshot, *map(F.col, ("project", "path", "start_line", "end_line", "kind")), F.sha2("content", 256)))
    return named.dropDuplicates(["evidence_id"]).select("evidence_id", "project", "path", "start_line", "end_line", "kind", "symbol", "complete", "content")


def containing(places: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """key, qualified_name, s0, s1: of each place (key, project, path, line) the smallest active symbol with code that holds the line."""
    own = symbols.where(F.col("kind").isin(*EXECUTABLE) & (F.col("active") == 1)).select("project", "path", "qualified_name", "start_line", "end_line")
    held = within_lines(own, places.select(key, "project", "path", "line")).withColumnsRenamed({"start_line": "s0", "end_line": "s1"})
    return held.groupBy(key).agg(F.min_by(F.struct("qualified_name", "s0", "s1"), F.struct((F.col("s1") - F.col("s0")).alias("size"), "s0", "qualified_name")).alias("s")).select(key, "s.*")


def target_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_id, project, path, qualified_name, start_line, end_line: the active symbols that an edge (edge_id, ...) leads to.

    Those that bear its qualified target, or else its target's name, in the target's file if it is known; or else, of a function
    invoked by name, the symbols below the folder of that name. The first way that finds any counts.
    """
    low = symbols.where("active = 1").select("project", "path", "qualified_name", "start_line", "end_line", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("key")).where("key is not null")
    asked = edges.select("edge_id", "project", "relation", "target_path", F.lower(F.coalesce("target_qualified_name", "target_name")).alias("first"), F.lower("target_name").alias("second"), F.col("target_name").alias("folder"))
    fits = F.col("target_path").isNull() | (F.col("target_path") == F.col("path"))
    by = lambda column, way: asked.withColumn("key", F.col(column)).join(low, ["project", "key"]).where(fits).select("edge_id", "project", "path", "qualified_name", "start_line", "end_line", F.lit(way).alias("way"))
    below = symbols.where("active = 1").select("project", "path", "qualified_name", "start_line", "end_line", F.regexp_extract("path", r"functions/([^/]+)/", 1).alias("folder")).where("folder <> ''")
    invoked = asked.where("relation = 'invokes_edge_function'").join(below, ["project", "folder"]).select("edge_id", "project", "path", "qualified_name", "start_line", "end_line", F.lit(3).alias("way"))
    every = by("first", 1).unionByName(by("second", 2)).unionByName(invoked).distinct()
    best = every.groupBy("edge_id").agg(F.min("way").alias("way"))
    return every.join(best, ["edge_id", "way"]).drop("way")


def expand_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_id, project, path, start_line, end_line, symbol, kind: what to open of each edge (edge_id, project, source_path, line, ...).

    The symbol around the call, or its line alone where there is none, and the symbols it leads to.
    """
    calls = edges.select("edge_id", "project", F.col("source_path").alias("path"), "line")
    around = calls.join(containing(calls, symbols, "edge_id"), "edge_id", "left")
    source = around.select("edge_id", "project", "path", F.coalesce("s0", "line").alias("start_line"), F.coalesce("s1", "line").alias("end_line"), F.coalesce("qualified_name", F.lit("")).alias("symbol"), F.when(F.col("s0").isNull(), "callsite").otherwise("symbol").alias("kind"))
    targets = target_symbols(edges, symbols).select("edge_id", "project", "path", "start_line", "end_line", F.col("qualified_name").alias("symbol"), F.lit("symbol").alias("kind"))
    return source.unionByName(targets).distinct()


def resolve_requests(requests: DataFrame, symbols: DataFrame, edges: DataFrame, authority: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what to open: request, project, path, start_line, end_line, symbol, kind; what can't be: request, reason).

    requests: request, project, op, path, name, start_line, end_line. Requests that ask the same are answered once, by the least
    request. op: symbol (active symbols of the name), sql (those in scripts of the schema), callers and callees (edges of the name
    with both ends), tests (edges and symbols of tests with the name), range (lines, widened to the symbol that holds them).
    authority: project, path, authority. files: project, path.
    """
    same = ["project", "op", "path", "name", "start_line", "end_line"]
    once = requests.groupBy(*same).agg(F.min("request").alias("request")).withColumn("low", F.lower(F.coalesce("name", F.lit(""))))
    known = files.select("project", "path").distinct().withColumn("known", F.lit(True))
    asked = once.join(known, ["project", "path"], "left")
    reason = (
        F.when(~F.col("op").isin(*OPERATIONS) | F.col("op").isNull(), "invalid op").when(F.col("path").isNotNull() & (~is_safe_path(F.col("path")) | F.col("known").isNull()), "invalid path")
        .when((F.col("op") == "range") & (F.col("path").isNull() | F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))), "invalid range")
    )
    judged = asked.withColumn("reason", reason)
    good = judged.where("reason is null")
    here = F.col("asked_path").isNull() | (F.col("asked_path") == F.col("path"))
    own = symbols.join(authority.select("project", "path", "authority"), ["project", "path"], "left").select("project", "path", "qualified_name", "start_line", "end_line", "active", "authority", "name")
    plain = good.select("request", "project", "op", F.col("path").alias("asked_path"), "low", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    low = own.where("active = 1").withColumn("low", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))))
    named = plain.where("op in ('symbol', 'sql')").join(low, ["project", "low"]).where(here & ((F.col("op") == "symbol") | (F.col("authority") == "schema_history")))
    place = Window.partitionBy("request").orderBy("path", "start_line", "qualified_name")
    columns = ["request", "project", "path", "start_line", "end_line", F.col("qualified_name").alias("symbol"), F.lit("symbol").alias("kind")]
    by_name = named.withColumn("n", F.row_number().over(place)).where(F.col("n") <= MOST_SYMBOLS).select(*columns)
    links = edges.select(F.col("id").alias("edge_id"), "project", "source_path", "source_name", "source_qualified_name", "relation", "target_name", "target_qualified_name", "target_path", "line")
    ends = lambda a, b: links.withColumn("low", F.explode(F.array_distinct(F.array(F.lower(a), F.lower(b))))).where("low is not null")
    into, out = ends("target_name", "target_qualified_name"), ends("source_name", "source_qualified_name")
    callers = plain.where("op = 'callers'").join(into, ["project", "low"]).where(F.col("asked_path").isNull() | (F.col("asked_path") == F.col("target_path")))
    callees = plain.where("op = 'callees'").join(out, ["project", "low"]).where(F.col("asked_path").isNull() | (F.col("asked_path") == F.col("source_path")))
    of_tests = authority.where("authority = 'test'").select("project", F.col("path").alias("source_path"))
    tests = plain.where("op = 'tests'").join(into, ["project", "low"]).join(of_tests, ["project", "source_path"], "left_semi")
    chosen = reduce(DataFrame.unionByName, [x.select("request", *links.columns) for x in (callers, callees, tests)])
    opened = expand_edges(chosen.drop("request").distinct(), symbols)
    by_edge = chosen.select("request", "edge_id").distinct().join(opened, "edge_id").drop("edge_id")
    by_test = plain.where("op = 'tests'").join(own.where("authority = 'test'"), "project").where(F.contains(F.lower(F.concat_ws(" ", "name", "qualified_name")), F.col("low"))).select(*columns)
    spans = plain.where("op = 'range'").select("request", "project", F.col("asked_path").alias("path"), F.col("a").alias("line"), "a", "b")
    around = spans.join(containing(spans, symbols, "request"), "request", "left").withColumn("inside", F.coalesce(F.col("s1") >= F.col("b"), F.lit(False)))
    by_range = around.select("request", "project", "path", F.when(F.col("inside"), F.col("s0")).otherwise(F.col("a")).alias("start_line"), F.when(F.col("inside"), F.col("s1")).otherwise(F.col("b")).alias("end_line"), F.when(F.col("inside"), F.col("qualified_name")).otherwise("").alias("symbol"), F.when(F.col("inside"), "symbol").otherwise("range").alias("kind"))
    found = reduce(DataFrame.unionByName, [by_name, by_edge, by_test, by_range]).distinct()
    nothing = good.join(found.select("request").distinct(), "request", "left_anti").select("request", F.lit("no indexed match").alias("reason"))
    return found, judged.where("reason is not null").select("request", "reason").unionByName(nothing)


def evidence_totals(evidence: DataFrame) -> DataFrame:
    """project, items, complete, bytes: how much evidence is open."""
    return evidence.groupBy("project").agg(F.count(F.lit(1)).alias("items"), F.count_if("complete").alias("complete"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


# -- answers about evidence: small objects on the driver
STATUSES, KINDS, SUPPORTS = ("answer", "need_more"), ("direct", "runtime_behavior", "indexed_relationship", "inference"), ("support", "refute", "unknown")
MOST_REQUESTS, MOST_EDGES, GROUP = 12, 24, 6


class ProtocolError(ValueError):
    """An answer that doesn't keep to the form."""


def check_form(answer: dict, expected: dict, edges: set[str], evidence: set[str]) -> dict:
    """The answer, if it has the fields, types and ids that it must have; else ProtocolError. expected: fields with fixed values."""
    lists = ("inspect_edge_ids", "claims", "requests", "contradictions", "answer_claim_ids")
    fields = {*expected, "status", "answer", *lists}

    def need(holds: bool, what: str) -> None:
        if not holds:
            raise ProtocolError(what)

    strings = lambda x: isinstance(x, list) and all(isinstance(i, str) for i in x)
    need(set(answer) == fields, f"fields differ: {sorted(set(answer) ^ fields)}")
    for name, value in expected.items():
        need(answer[name] == value, f"{name} is another request's")
    need(answer["status"] in STATUSES and isinstance(answer["answer"], str), "status or answer is invalid")
    need(all(isinstance(answer[k], list) for k in lists) and strings(answer["inspect_edge_ids"]) and strings(answer["answer_claim_ids"]), "a list is none")
    need(set(answer["inspect_edge_ids"]) <= edges, "an edge to inspect isn't in the batch")
    seen: set[str] = set()
    for claim in answer["claims"]:
        need(isinstance(claim, dict) and set(claim) == {"claim_id", "text", "kind", "support", "missing_evidence", "evidence_ids", "edge_ids"}, "a claim has other fields")
        need(all(isinstance(claim[k], str) for k in ("claim_id", "text", "kind", "support", "missing_evidence")), "a claim's field is no text")
        need(claim["kind"] in KINDS and claim["support"] in SUPPORTS, "a claim's kind or support is invalid")
        need(bool(claim["claim_id"]) and claim["claim_id"] not in seen, "a claim's id is empty or repeated")
        seen.add(claim["claim_id"])
        need(strings(claim["evidence_ids"]) and strings(claim["edge_ids"]), "a claim's ids are no texts")
        need(set(claim["edge_ids"]) <= edges and set(claim["evidence_ids"]) <= evidence, "a claim cites what isn't in the batch")
    for request in answer["requests"]:
        need(isinstance(request, dict) and set(request) == {"op", "path", "name", "qualified_name", "reason", "start_line", "end_line"} and request["op"] in OPERATIONS, "a request has other fields")
        need(all(isinstance(request[k], int) and request[k] >= 1 for k in ("start_line", "end_line")) and all(isinstance(request[k], str) for k in ("path", "name", "qualified_name", "reason")), "a request's field is invalid")
        need(request["op"] != "range" or bool(request["path"]) and request["end_line"] >= request["start_line"], "a range is invalid")
    for item in answer["contradictions"]:
        need(isinstance(item, dict) and set(item) == {"text", "claim_ids"} and isinstance(item["text"], str) and strings(item["claim_ids"]), "a contradiction has another form")
    return answer


def claim_key(text: str, kind: str) -> str:
    from hashlib import sha256

    return "C" + sha256(f"{text}\x1f{kind}".encode()).hexdigest()[:16]


def check_references(answer: dict, edges: set[str], evidence: set[str]) -> dict:
    """The answer with claims named by what they say, unknown ids dropped and reported, and support withdrawn where it has lost its ground.

    Claims stay, whatever they cite. An answer whose claims have no valid support asks for more.
    """
    out, names, invalid, claims = dict(answer), {}, [], []
    for k, raw in enumerate(c for c in answer.get("claims", []) if isinstance(c, dict)):
        kind = {"relationship": "indexed_relationship"}.get(raw.get("kind"), raw.get("kind"))
        claim = raw | {"kind": kind if kind in KINDS else "inference", "support": raw.get("support") if raw.get("support") in SUPPORTS else "unknown"}
        claim["claim_id"] = claim_key(claim.get("text", ""), claim["kind"])
        if raw.get("claim_id"):
            names[raw["claim_id"]] = claim["claim_id"]
        wrong = {}
        for field, known in (("evidence_ids", evidence), ("edge_ids", edges)):
            ids = raw.get(field) if isinstance(raw.get(field), list) else []
            claim[field], wrong[field] = [i for i in ids if i in known], [i for i in ids if i not in known]
        if wrong["evidence_ids"] or wrong["edge_ids"]:
            invalid.append({"claim": k, **wrong})
            claim |= {"support": "unknown", "invalid_references": wrong}
        ground = {"direct": "evidence_ids", "runtime_behavior": "evidence_ids", "indexed_relationship": "edge_ids"}.get(claim["kind"])
        if ground and not claim[ground]:
            claim |= {"support": "unknown", "missing_evidence": claim.get("missing_evidence") or f"no valid {ground}"}
        claims.append(claim)
    known = {c["claim_id"] for c in claims}
    valid = {c["claim_id"] for c in claims if c["support"] != "unknown"}
    contradictions = []
    for k, raw in enumerate(c for c in answer.get("contradictions", []) if isinstance(c, dict)):
        ids = [names.get(i, i) for i in raw.get("claim_ids", [])]
        if bad := [i for i in ids if i not in known]:
            invalid.append({"contradiction": k, "claim_ids": bad})
        contradictions.append(raw | {"claim_ids": [i for i in ids if i in known]})
    cited = [names.get(i, i) for i in answer.get("answer_claim_ids", [])]
    out |= {
        "claims": claims, "contradictions": contradictions, "invalid_references": invalid, "answer_claim_ids": list(dict.fromkeys(i for i in cited if i in valid)),
        "requests": [r for r in answer.get("requests", []) if isinstance(r, dict) and r.get("op") in OPERATIONS][:MOST_REQUESTS], "inspect_edge_ids": [i for i in answer.get("inspect_edge_ids", []) if i in edges][:MOST_EDGES],
        "status": answer.get("status") if answer.get("status") in STATUSES else "need_more",
    }
    if out["status"] == "answer" and not out["answer_claim_ids"]:
        out |= {"status": "need_more", "answer": "", "answer_rejected_reason": "no valid answer_claim_ids"}
    return out


def groups_of(n: int, most: int = GROUP) -> list[int]:
    """Sizes of groups of n things, ``most`` at most, none of them a single thing."""
    out = []
    while n:
        size = min(most, n)
        if n - size == 1:
            size -= 1
        if size < 2:
            raise ValueError("a single thing can't be grouped")
        out.append(size)
        n -= size
    return out


def tree_reduce(items: list, merge: Callable[[list], object], fits: Callable[[list], bool] = lambda group: True, most: int = GROUP) -> object:
    """One thing out of many by merging groups round by round. A group that doesn't fit is made smaller; two that don't fit are an error."""
    if not items:
        raise ValueError("there is nothing to reduce")
    while len(items) > 1:
        out, at = [], 0
        while at < len(items):
            size = groups_of(len(items) - at, most)[0] if len(items) - at > 1 else 1
            while size > 2 and not fits(items[at : at + size]):
                size -= 1
            if size > 1 and not fits(items[at : at + size]):
                raise ValueError("two things don't fit together")
            out.append(merge(items[at : at + size]) if size > 1 else items[at])
            at += size
        if len(out) >= len(items):
            raise ValueError("the reduction makes no progress")
        items = out
    return items[0]


def in_batches(items: Iterable, cost: Callable[[list], int], budget: int) -> list[list]:
    """The things in order, as many to a batch as its budget holds. One beyond the budget is an error, never cut."""
    out: list[list] = []
    for item in items:
        if cost([item]) > budget:
            raise ValueError("a thing exceeds the budget")
        if out and cost([*out[-1], item]) <= budget:
            out[-1].append(item)
        else:
            out.append([item])
    return out
