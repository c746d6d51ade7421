"""Functions on names, lines, citations and JSON of code graphs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_CHARS, RERANK_CHARS, SNIPPET_HALF = 16_000, 32_000, 24
# Words that say nothing about which file a question means.
AFFINITY_IGNORED = (
    "affected", "behavior", "change", "code", "every", "find", "fix", "identify", "implementation", "investigate", "production", "regression", "repository", "should", "test", "when", "while", "with",
)


def singular(token: str) -> str:
    """A token without its plural ending."""
    if len(token) > 5 and token.endswith("ies"):
        return token[:-3] + "y"
    return token[:-1] if len(token) > 4 and token.endswith("s") and not token.endswith("ss") else token


def affinity_terms(terms: list[str]) -> list[str]:
    """The terms of a question by which paths are compared with it."""
    return list(dict.fromkeys(singular(t) for t in terms if len(t) > 3 and t not in AFFINITY_IGNORED))


def affinity(path: Column, terms: list[str]) -> Column:
    """How many of the terms a path holds."""
    low, out = F.lower(path), F.lit(0)
    for t in terms:
        out = out + low.contains(t).cast("int")
    return out


def name_words(name: Column) -> Column:
    """The lower-case words of a camelCase or snake_case name."""
    parted = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(parted)), " "), lambda w: F.length(w) > 0)


def citation(project: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(project, F.lit(":"), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def embedding_document(project: Column, path: Column, content: Column) -> Column:
    """What is embedded for a chunk: where it lies, then its text up to a limit, marked if it was cut."""
    body = F.when(F.length(content) > DOCUMENT_CHARS, F.concat(F.substring(content, 1, DOCUMENT_CHARS), F.lit("\n[cut]"))).otherwise(content)
    return F.concat(F.lit("Project: "), project, F.lit("\nFile: "), path, F.lit("\n\n"), body)


def numbered_lines(content: Column, start: Column) -> Column:
    """The text with each line's number in front."""
    return F.array_join(F.transform(F.split(content, "\n"), lambda line, i: F.concat((start + i).cast("string"), F.lit(": "), line)), "\n")


def line_range(content: Column, first: Column, low: Column, high: Column) -> Column:
    """The lines low to high of a text whose first line is ``first``; lines outside it are left out."""
    at = F.greatest(low - first + 1, F.lit(1))
    return F.array_join(F.slice(F.split(content, "\n"), at.cast("int"), F.greatest(high - first + 2 - at, F.lit(0)).cast("int")), "\n")


def strict_json(raw: str) -> dict:
    """An object out of JSON, perhaps in a Markdown fence; repeated keys, NaN and infinities are refused."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key is repeated")
        return out

    def constant(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw)
    value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def strict_object(raw: Column) -> Column:
    """The variant of a text that is one JSON object, perhaps in a Markdown fence; null for anything else, repeated keys and NaN included."""
    value = F.try_parse_json(F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def metadata_object(raw: Column) -> Column:
    """Metadata as the canonical text of an object: its keys in order; what is JSON but no object as {"value": ...}, what is none as {"raw": ...}."""
    value = F.try_parse_json(F.coalesce(raw, F.lit("{}")))
    text = F.to_json(value)
    return F.when(value.isNull(), F.to_json(F.struct(F.coalesce(raw, F.lit("")).alias("raw")))).when(F.schema_of_variant(value).startswith("OBJECT"), text).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}")))


def matched_terms(path: Column, content: Column, terms: list[str], most: int = 8) -> Column:
    """The terms that a file's path or text holds, in order, the first ``most`` of them."""
    hay = F.lower(F.concat_ws("\n", path, content))
    return F.slice(F.filter(F.array(*map(F.lit, sorted(terms))) if terms else F.array().cast("array<string>"), lambda t: F.contains(hay, t)), 1, most)


def name_tokens(name: Column) -> Column:
    """The distinct runs of more than two letters and digits in a name."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: F.length(t) > 2))
