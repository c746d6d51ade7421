"""Shaping of hits: snippets, diversity, quotas and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import capped_frequency

SNIPPET_LINES, SNIPPET_CHARS, MOST_HITS, MOST_PER_PATH = 14, 1800, 6, 2


def best_lines(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """id, line, matches: of each chunk the first of the lines that hold the most occurrences of the terms (each capped at 4). No shuffle."""
    scored = F.transform(F.split(F.lower("content"), "\n"), lambda text, i: F.struct(capped_frequency(text, terms, lowered=True).alias("matches"), (-i).alias("back")))
    best = chunks.where("content is not null").select("id", "start_line", F.array_max(scored).alias("m"))
    return best.select("id", (F.col("start_line") - F.col("m.back")).cast("bigint").alias("line"), F.col("m.matches").cast("bigint").alias("matches"))


def snippets(chunks: DataFrame, best: DataFrame, size: int = SNIPPET_LINES, chars: int = SNIPPET_CHARS) -> DataFrame:
    """id, first_line, snippet: up to ``size`` lines around the best line of a chunk; beyond ``chars`` characters it ends with the last whole line."""
    joined = chunks.where("content is not null").join(best.select("id", F.col("line").alias("best")), "id")
    lines = F.split("content", "\n")
    offset = F.greatest(F.lit(0), F.least(F.col("best") - F.col("start_line") - size // 2, F.size(lines) - size))
    text = F.array_join(F.slice(lines, (offset + 1).cast("int"), F.lit(size)), "\n")
    return joined.select("id", (F.col("start_line") + offset).cast("bigint").alias("first_line"), F.when(F.length(text) > chars, F.regexp_replace(F.substring(text, 1, chars), r"\n[^\n]*$", "")).otherwise(text).alias("snippet"))


def first_per_path(hits: DataFrame, limit: int) -> DataFrame:
    """The best hit of each path (project, path, id, score), the best ``limit`` of them."""
    order = Window.partitionBy("project", "path").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n").orderBy(F.desc("score"), "project", "path").limit(limit)


def per_group(hits: DataFrame, group: str, cap: int, *ties: str) -> DataFrame:
    """The ``cap`` best rows of each group with their place in it, such as the representatives of lanes."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), *[F.asc(t) for t in ties])
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def diverse_hits(hits: DataFrame, limit: int = MOST_HITS, per_path: int = MOST_PER_PATH, mixed: bool = False) -> DataFrame:
    """question, id, place: for each question up to ``limit`` hits, first one per path, then up to ``per_path``, none overlapping another.

    hits: question, id, project, path, start_line, end_line, score and, for ``mixed``, authority; a bounded top list per question.
    mixed: half of the places are first filled with implementation and one with a test. Choosing depends on what was chosen
    before, so each question's list is walked by itself; places are in order of rank.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
        taken: list[dict] = []

        def take(row: dict, cap: int) -> bool:
            same = [t for t in taken if (t["project"], t["path"]) == (row["project"], row["path"])]
            if row in taken or len(same) >= cap or any(t["start_line"] <= row["end_line"] and row["start_line"] <= t["end_line"] for t in same):
                return False
            taken.append(row)
            return True

        if mixed and limit >= 2:
            quotas = [(("code", "schema_history"), min(max(1, limit // 2), limit - 1)), (("test",), 1)]
            for kinds, quota in quotas:
                for row in rows:
                    if quota and row["authority"] in kinds:
                        quota -= take(row, 1)
        for cap in range(1, per_path + 1):
            for row in rows:
                if len(taken) < limit:
                    take(row, cap)
        taken.sort(key=lambda r: (-r["score"], r["id"]))
        return pd.DataFrame({"question": [pdf["question"].iloc[0]] * len(taken), "id": [r["id"] for r in taken], "place": range(1, len(taken) + 1)})

    kind = hits.schema["question"].dataType.simpleString()
    return hits.groupBy("question").applyInPandas(choose, f"question {kind}, id bigint, place int")


def pack(candidates: DataFrame, budget: int, reserve: int = 2000, most: int = 48, per_path: int = 4) -> DataFrame:
    """question, id, fate, used: the evidence that fits a token budget, in order of priority, and why the rest was left out.

    candidates: question, id, path, start_line, end_line, priority, tokens; a bounded list per question. What doesn't fit is
    skipped and smaller evidence behind it may still fit, so this is a walk and no running sum. fate: included,
    source_item_limit, path_limit, overlap or token_budget; used: tokens so far.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out, chosen = 0, [], []
        for row in pdf.sort_values(["priority", "path", "start_line", "id"], ascending=[False, True, True, True]).to_dict("records"):
            same = [c for c in chosen if c["path"] == row["path"]]
            if len(chosen) >= most:
                fate = "source_item_limit"
            elif len(same) >= per_path:
                fate = "path_limit"
            elif any(c["start_line"] <= row["end_line"] and row["start_line"] <= c["end_line"] for c in same):
                fate = "overlap"
            elif used + row["tokens"] + reserve > budget:
                fate = "token_budget"
            else:
                fate = "included"
                used += row["tokens"]
                chosen.append(row)
            out.append((row["id"], fate, used))
        return pd.DataFrame({"question": [pdf["question"].iloc[0]] * len(out), "id": [o[0] for o in out], "fate": [o[1] for o in out], "used": [o[2] for o in out]})

    kind = candidates.schema["question"].dataType.simpleString()
    return candidates.groupBy("question").applyInPandas(walk, f"question {kind}, id bigint, fate string, used bigint")


def similar_names(symbols: DataFrame, name: str, limit: int = 5, least: float = 0.48) -> DataFrame:
    """id, name, ratio: the symbols whose short or qualified names are most like a name that nothing bears, by matching blocks (Ratcliff and Obershelp)."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import difflib

        wanted = name.lower()
        for names in batches:
            yield names.map(lambda n: None if n is None else difflib.SequenceMatcher(None, wanted, n.lower()).ratio())

    qualified = F.col("qualified_name") if "qualified_name" in symbols.columns else F.lit(None).cast("string")
    names = symbols.select("id", "name", qualified.alias("qualified")).groupBy("name", "qualified").agg(F.min("id").alias("id"))
    rated = names.withColumn("ratio", F.round(F.greatest(ratio("name"), ratio("qualified")), 4)).where(F.col("ratio") >= least)
    return rated.groupBy("name").agg(F.max("ratio").alias("ratio"), F.min_by("id", -F.col("ratio")).alias("id")).orderBy(F.desc("ratio"), "name").limit(limit).select("id", "name", "ratio")
