"""Pieces of oversized texts, cut at natural boundaries (problem 3).

Balanced targets: the least number of pieces gives equal-length targets; each is snapped to the strongest boundary near it,
and a piece is added whenever one would pass the limit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece; lines, or characters within one line, that a piece repeats of the one before.
LIMIT, OVERLAP_LINES, OVERLAP_CHARS = 6000, 15, 200

# What begins a unit of its own: a definition, a section, a statement at the left margin.
_UNIT = re.compile(r"(?:export |public |private |static |async |default |abstract |pub )*(?:class|def|func|function|fn|interface|type|enum|struct|impl|trait|module|namespace|const|var|let|create|alter|insert|begin|describe|it|test|@\w)\b|#{1,6} |<h\d|\[[\w.]+\]$", re.I)
# Places within a line, strongest first.
_WITHIN = (re.compile(r"[;}\])][,;]?|[.!?。！？](?=\s|$)"), re.compile(r"[,:|&]"), re.compile(r"\s+"))


def _strength(text: str, at: int) -> int:
    """Of the boundary in front of the line that begins at ``at``."""
    end = text.find("\n", at, at + 200)
    line = text[at : end if end >= 0 else at + 200]
    above = text.rfind("\n", 0, at - 1) + 1
    previous = text[max(above, at - 200) : at - 1]
    if not previous.strip():
        return 5 if _UNIT.match(line) else 4
    if _UNIT.match(line):
        return 4
    if line[:1] not in ("", " ", "\t", "}", ")", "]") and previous[:1] in ("}", ")", "]"):
        return 3
    if len(line) - len(line.lstrip()) < len(previous) - len(previous.lstrip()):
        return 1  # in front of a closing line
    return 2


def snap(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], of equally strong ones the nearest to the target, then the first."""
    best = None
    at = text.find("\n", low - 1, high)
    while at >= 0:
        place = at + 1
        if low <= place <= high:
            rank = (-_strength(text, place), abs(place - target), place)
            if best is None or rank < best:
                best = rank
        at = text.find("\n", place, high)
    if best is not None:
        return best[2]
    for pattern in _WITHIN:
        places = [p for m in pattern.finditer(text, max(0, low - 1), high) if low <= (p := m.end()) <= high and not joined(text, p)]
        if places:
            return min(places, key=lambda p: (abs(p - target), p))
    return whole_place(text, target, low)


def joined(text: str, at: int) -> bool:
    """Whether the character at ``at`` belongs to the one before it: CR LF, marks, joiners, modifiers, halves of flags."""
    if at <= 0 or at >= len(text):
        return False
    before, c = text[at - 1], text[at]
    if c == "\n":
        return before == "\r"
    if c.isascii():
        return False
    if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Mc") or c in "\u200d\ufe0e\ufe0f" or before == "\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff" or "\U000e0020" <= c <= "\U000e007f":
        return True
    if "\U0001f1e6" <= c <= "\U0001f1ff":
        flags = at
        while flags > 0 and "\U0001f1e6" <= text[flags - 1] <= "\U0001f1ff":
            flags -= 1
        return (at - flags) % 2 == 1
    return False


def whole_place(text: str, at: int, low: int) -> int:
    """``at``, or the nearest place before it that parts no character from its marks; ``at`` if there is none down to ``low``."""
    place = at
    while place > low and joined(text, place):
        place -= 1
    return at if joined(text, place) else place


def back(text: str, cut: int, floor: int, room: int) -> int:
    """Where the piece behind a cut begins: up to OVERLAP_LINES lines earlier as far as there is room, or, where the line before
    the cut has none or the cut lies within a line, OVERLAP_CHARS earlier in that line."""
    start = cut
    if text[cut - 1] == "\n":
        at = cut
        for _ in range(OVERLAP_LINES):
            at = text.rfind("\n", 0, at - 1) + 1 if at > 0 else 0
            if at < floor or cut - at > room:
                break
            start = at
            if at == 0:
                break
    if start < cut:
        return start
    line = text.rfind("\n", 0, cut - 1) + 1
    start = place = max(floor, line, cut - min(OVERLAP_CHARS, room))
    while place < cut and joined(text, place):
        place += 1
    return place if place < cut else start


def split_text(text: str, limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """(start, end, characters repeated of the piece before) of each piece; pieces without their repeats give the text again."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    room = min(limit // 4, max(OVERLAP_CHARS, limit // 4))
    pieces = -(-n // limit)
    while True:
        size = n / pieces
        reach = int(min(size / 4, (limit - size) if limit > size else 0, limit / 4))
        out, start, cut, good = [], 0, 0, True
        for k in range(1, pieces):
            target = round(k * size)
            end = snap(text, target, max(cut + 1, target - reach), min(n - 1, target + reach, start + limit))
            if end <= cut or end - start > limit:
                good = False
                break
            out.append((start, end, cut - start))
            start, cut = back(text, end, cut if cut > start else start + 1, room), end
        if good and n - start <= limit:
            return [*out, (start, n, cut - start)]
        pieces += 1


def split_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id, project, path, piece, pieces, start_line, end_line, start_char, end_char, repeated, content: pieces of the oversized chunks.

    piece counts from 1; characters count from 0 within the chunk; ``repeated`` characters at a piece's start repeat the piece
    before. Chunks within the limit and null contents give no rows; equal rows (same id, place and content) are split once; a
    null start_line counts as 1; an empty table gives no rows; other columns are ignored. Chunks within the limit never leave
    the JVM.
    """
    if limit < 4 * OVERLAP_CHARS:
        raise ValueError(f"the limit must be at least {4 * OVERLAP_CHARS}")
    rows = chunks.where(F.length("content") > limit).select("id", "project", "path", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content").dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = {name: batch.column(k)[row].as_py() for k, name in enumerate(batch.schema.names)}
                text, line, at, out = own["content"], own["start_line"], 0, []
                parts = split_text(text, limit)
                for k, (start, end, repeated) in enumerate(parts):
                    line += text.count("\n", at, start) if start >= at else -text.count("\n", start, at)
                    at = start
                    out.append((own["id"], own["project"], own["path"], k + 1, len(parts), line, line + text.count("\n", start, end - 1), start, end, repeated, text[start:end]))
                names = ["id", "project", "path", "piece", "pieces", "start_line", "end_line", "start_char", "end_char", "repeated", "content"]
                kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 7, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return rows.mapInArrow(run, "id bigint, project string, path string, piece int, pieces int, start_line int, end_line int, start_char int, end_char int, repeated int, content string")
