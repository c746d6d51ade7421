"""Candidates for a dossier, fused from several kinds of evidence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.chunking import token_estimate
from quernstone.operators.ledger import read_ranges
from quernstone.operators.results import pack
from quernstone.session import cut

# Priority of each kind of evidence; ranked kinds lose so much per rank.
PRIORITIES = {
    "hit": 2000, "neighbour": 1950, "contract": 1850, "anchor": 1820, "reverse_hint": 1800, "anchor_callee": 1600, "lineage": 1500, "dependency": 1450,
    "facet_sql": 1380, "facet_code": 1370, "rpc_consumer": 1350, "cache": 1330, "causal": 1000, "impact": 950, "flow": 900,
}
PER_RANK, MOST_RANKS, TERM_BONUS, MOST_BONUS = 20, 80, 40, 120


def fuse_candidates(sources: dict[str, DataFrame], terms: list[str]) -> DataFrame:
    """project, path, start_line, end_line, priority, reasons: one row per range, with its best priority and all kinds that name it.

    sources: kind -> project, path, start_line, end_line, rank (0 where the kind has none). Question terms in the path add to the
    priority. An invalid range means the file's first line.
    """
    parts = []
    for kind, df in sources.items():
        rank = F.least(F.coalesce(F.col("rank"), F.lit(0)), F.lit(MOST_RANKS))
        bad = F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
        parts.append(
            df.where("path is not null").select(
                "project", "path", F.when(bad, 1).otherwise(F.col("start_line")).alias("start_line"), F.when(bad, 1).otherwise(F.col("end_line")).alias("end_line"),
                (F.lit(PRIORITIES[kind]) - PER_RANK * rank).alias("priority"), F.lit(kind).alias("kind"),
            )
        )
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("project", "path", "start_line", "end_line").agg(F.max("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("reasons"))
    found = reduce(lambda a, b: a + b, [F.lower("path").contains(t).cast("int") for t in terms], F.lit(0))
    return fused.withColumn("priority", (F.col("priority") + F.least(F.lit(MOST_BONUS), TERM_BONUS * found)).cast("bigint"))


#: Share of a candidate that a symbol has to cover, lines around a range without one, lines of a file that is shown whole, characters of an excerpt, half its lines at first.
COVERED, MARGIN, WHOLE_FILE, EXCERPT_CHARS, HALF_LINES = 0.45, 24, 240, 18_000, 160
PROMPT_CHARS, MOST_REASONS, CODE_FIRST = 24_000, 10, ("code", "schema_history")


def ordered(candidates: DataFrame) -> DataFrame:
    """candidates (with priority, authority, path, start_line) and their place, from 1: by priority, code and schema first, path and line."""
    order = [F.desc("priority"), F.when(F.col("authority").isin(*CODE_FIRST), 0).otherwise(1), "path", "start_line", "project"]
    return candidates.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def candidate_symbols(candidates: DataFrame, symbols: DataFrame, terms: list[str], key: str = "place") -> DataFrame:
    """key, symbol, active, s0, s1: the symbol that stands for each candidate (key, project, path, start_line, end_line).

    One that holds all of it: active ones, functions, methods and classes first, then the smallest. Else the active one that overlaps it most,
    if it covers COVERED of it and its name has a term of the question.
    """
    kind = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "method", 1).when(F.col("kind") == "class", 2).otherwise(3)
    s = symbols.select("project", "path", F.coalesce("qualified_name", "name").alias("symbol"), F.lower(F.regexp_replace(F.concat_ws(" ", "name", "qualified_name"), "_", " ")).alias("text"), F.coalesce("active", F.lit(0)).alias("active"), kind.alias("rank"), F.col("start_line").alias("s0"), F.col("end_line").alias("s1"))
    over = candidates.select(key, "project", "path", "start_line", "end_line").join(s, ["project", "path"]).where((F.col("s0") <= F.col("end_line")) & (F.col("s1") >= F.col("start_line")))
    size, overlap = F.col("s1") - F.col("s0"), F.least("s1", "end_line") - F.greatest("s0", "start_line") + 1
    wide = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    named = reduce(lambda a, b: a | b, [F.col("text").contains(t.replace("_", " ")) for t in terms if len(t) >= 4], F.lit(False))
    holds = (F.col("s0") <= F.col("start_line")) & (F.col("s1") >= F.col("end_line"))
    one = F.struct("symbol", "active", "s0", "s1")
    best = over.groupBy(key).agg(
        F.min_by(one, F.when(holds, F.struct((-F.col("active")).alias("a"), "rank", size.alias("size"), "s0", "symbol"))).alias("inside"),
        F.min_by(F.struct(*[F.col(c) for c in ("symbol", "active", "s0", "s1")], (overlap / wide).alias("share"), named.alias("named")), F.struct((-overlap).alias("o"), (-F.col("active")).alias("a"), size.alias("size"), "symbol")).alias("most"),
    )
    fits = (F.col("most.active") == 1) & (F.col("most.share") >= COVERED) & F.col("most.named")
    chosen = F.coalesce("inside", F.when(fits, F.struct(*[F.col(f"most.{c}").alias(c) for c in ("symbol", "active", "s0", "s1")])))
    return best.select(key, chosen.alias("c")).where("c is not null").select(key, "c.*")


def _bounded(content: pd.Series, start: pd.Series, focus: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([bounded_source(c, s, f) for c, s, f in zip(content, start, focus, strict=True)], columns=["start", "end", "text", "complete"])


def bounded_source(content: str, start: int, focus: int, most: int = EXCERPT_CHARS) -> tuple[int, int, str, bool]:
    """(first line, last line, text, whether all of it) of a text that begins at line ``start``: within ``most`` characters, around the line ``focus``."""
    if len(content) <= most:
        return start, start + content.count("\n"), content, True
    lines = content.split("\n")
    end = start + len(lines) - 1
    centre = max(start, min(int(focus), end))
    low, high = max(start, centre - HALF_LINES), min(end, centre + HALF_LINES)
    while low < high:
        text = "\n".join(lines[low - start : high - start + 1])
        if len(text) <= most:
            return low, high, text, False
        if high - centre >= centre - low:
            high -= 20
        else:
            low += 20
    return centre, centre, lines[centre - start][:most], False


def excerpts(candidates: DataFrame, symbols: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    """place, symbol, start_line, end_line, full_start, full_end, content, complete: the source that stands for each candidate.

    Its symbol's lines, or the candidate's with MARGIN lines around, or a short file whole; long ones are cut around the candidate.
    A candidate of a file without text has no row.
    """
    ends = F.col("start_line") + F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    files = chunks.where("content is not null").groupBy("project", "path").agg(F.max(ends).alias("lines"))
    joined = candidates.select("place", "project", "path", F.col("start_line").alias("a"), F.col("end_line").alias("b")).join(files, ["project", "path"])
    found = joined.join(candidate_symbols(candidates, symbols, terms), "place", "left").withColumn("own", F.col("s0").isNotNull() & (F.col("s0") <= F.col("s1")) & (F.col("s0") <= F.col("lines")))
    short = F.col("lines") <= WHOLE_FILE
    low = F.when(F.col("own"), F.col("s0")).when(short, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("a") - MARGIN, F.col("lines"))))
    high = F.when(F.col("own"), F.least("s1", "lines")).when(short, F.col("lines")).otherwise(F.least(F.col("lines"), F.col("b") + MARGIN))
    ranges = found.select("place", "project", "path", low.cast("int").alias("start_line"), F.greatest(low, high).cast("int").alias("end_line"), ((F.col("a") + F.col("b")) / 2).cast("int").alias("focus"), F.when(F.col("own"), F.col("symbol")).otherwise("").alias("symbol"))
    read = ranges.join(read_ranges(ranges, chunks, "place").select("place", "content", "first_line"), "place")
    bounded = F.pandas_udf(_bounded, "struct<start:int,end:int,text:string,complete:boolean>")
    cut_ = read.withColumn("x", bounded("content", "first_line", "focus")).where(F.length(F.trim("x.text")) > 0)
    return cut_.select("place", "symbol", F.col("x.start").alias("start_line"), F.col("x.end").alias("end_line"), F.col("start_line").alias("full_start"), F.col("end_line").alias("full_end"), F.col("x.text").alias("content"), F.col("x.complete").alias("complete"))


def omissions(packed: DataFrame) -> DataFrame:
    """fate, items: why candidates were left out, and how many for each reason."""
    return packed.where("fate <> 'included'").groupBy("fate").agg(F.count(F.lit(1)).alias("items"))


def dossier(candidates: DataFrame, symbols: DataFrame, chunks: DataFrame, terms: list[str], budget: int) -> DataFrame:
    """place, project, path, start_line, end_line, symbol, priority, reasons, complete, content, fate: a question's evidence within a token budget.

    The budget is kept between 16,000 and 60,000. What is left out stays listed with its reason and without content.
    """
    budget = max(16_000, min(60_000, budget))
    own = cut(ordered(candidates))
    shown = cut(excerpts(own, symbols, chunks, terms))
    rows = own.select("place", "project", "path", "priority", "reasons").join(shown, "place", "left")
    packable = rows.where("content is not null").select(F.lit("q").alias("question"), F.col("place").cast("bigint").alias("id"), F.concat_ws("/", "project", "path").alias("path"), F.col("full_start").alias("start_line"), F.col("full_end").alias("end_line"), (-F.col("place")).cast("double").alias("priority"), token_estimate(F.length("content")).alias("tokens"))
    fates = pack(packable, budget).select(F.col("id").cast("int").alias("place"), "fate")
    joined = rows.join(fates, "place", "left").withColumn("fate", F.coalesce("fate", F.lit("not_available_in_snapshot")))
    return joined.withColumn("content", F.when(F.col("fate") == "included", F.col("content"))).select("place", "project", "path", "start_line", "end_line", "symbol", "priority", "reasons", "complete", "content", "fate")


def compact_reasons(reasons: DataFrame, most: int = MOST_REASONS) -> DataFrame:
    """project, path, kinds: of each file of a flow its first distinct reasons by score, joined."""
    once = reasons.groupBy("project", "path", "kind").agg(F.max("score").alias("score"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("project", "path").orderBy(F.desc("score"), "kind"))).where(F.col("n") <= most)
    return first.groupBy("project", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


def prompt_blocks(hits: DataFrame, most: int = PROMPT_CHARS) -> DataFrame:
    """question, id, place, block: the hits' texts that fit a prompt, in order of rank; one that doesn't fit is skipped and smaller ones may follow.

    hits: question, id, project, path, start_line, end_line, content, score; a bounded list per question.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = 0, []
        for row in pdf.sort_values(["score", "id"], ascending=[False, True]).to_dict("records"):
            block = f"[{row['project']}:{row['path']}:{row['start_line']}-{row['end_line']}]\n{row['content'] or ''}"
            if used + len(block) <= most:
                used += len(block)
                out.append((row["id"], len(out) + 1, block))
        return pd.DataFrame({"question": [pdf["question"].iloc[0]] * len(out), "id": [o[0] for o in out], "place": [o[1] for o in out], "block": [o[2] for o in out]})

    kind = hits.schema["question"].dataType.simpleString()
    return hits.groupBy("question").applyInPandas(walk, f"question {kind}, id bigint, place int, block string")


def verified(snapshot: dict[str, str], repos: DataFrame, project: str) -> dict[str, str]:
    """The snapshot, if it is the published one of its project; else an error that says what to refresh. Fields: commit_hash, content_digest, extractor_version, generation_id."""
    row = repos.where(F.col("project") == project).select(*snapshot).first()
    if row is None:
        raise LookupError(f"{project} isn't indexed")
    stale = [k for k, v in snapshot.items() if row[k] != v]
    if stale:
        raise LookupError(f"the index of {project} is stale ({', '.join(stale)}): refresh it")
    return snapshot
