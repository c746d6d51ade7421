"""Whole files out of overlapping line windows, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of one block. A file of fewer lines is one block; a longer one is spread over several rows (and tasks).
BLOCK_LINES = 4096
#: Instead of it, where a file's text is needed in one piece.
WHOLE = 2**31 - 1


def windows_by_block(chunks: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """project, path, block, starts, texts: of each block of a file the distinct windows in it, cut to its lines, in order.

    A window that reaches over several blocks is cut before the shuffle, so each of its lines is shuffled once, however long it
    is. ``collect_set`` combines on the map side, so exact copies of a row and rows left by an earlier generation (same place,
    same text) are dropped before that one shuffle. A block has a bounded number of lines, so a group stays bounded however long
    its file is. Windows are in order of their own first lines, also where they were cut. Rows without project, path or content
    hold no text of a file and are left out; a null or non-positive start_line counts as 1. Other columns are ignored.
    """
    start = F.greatest(F.coalesce(F.col("start_line"), F.lit(1)), F.lit(1))
    newlines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    block_of = lambda line: ((line - 1) / block_lines).cast("int")
    rows = chunks.where("project is not null and path is not null and content is not null").select("project", "path", start.alias("s"), "content", block_of(start).alias("b0"), block_of(start + newlines).alias("b1"))

    def piece(lines: Column, block: Column) -> Column:
        first = F.greatest(F.col("s").cast("long"), block.cast("long") * block_lines + 1)
        size = F.least((block.cast("long") + 1) * block_lines, F.col("s") + F.size(lines) - 1) - first + 1
        text = F.array_join(F.slice(lines, (first - F.col("s") + 1).cast("int"), size.cast("int")), "\n")
        return F.struct(block.alias("block"), F.struct(F.col("s"), first.cast("int").alias("at"), text.alias("content")).alias("w"))

    whole = F.array(F.struct(F.col("b0").alias("block"), F.struct(F.col("s"), F.col("s").alias("at"), F.col("content")).alias("w")))
    # The lines come along in an array of one, so that a lambda doesn't split the text anew for each block.
    parts = F.flatten(F.transform(F.array(F.split("content", "\n", -1)), lambda lines: F.transform(F.sequence("b0", "b1"), lambda block: piece(lines, block))))
    pieces = rows.select("project", "path", F.explode(F.when(F.col("b0") == F.col("b1"), whole).otherwise(parts)).alias("p")).select("project", "path", "p.block", "p.w")
    sets = pieces.groupBy("project", "path", "block").agg(F.array_sort(F.collect_set("w")).alias("w"))
    return sets.select("project", "path", "block", F.col("w.at").alias("starts"), F.col("w.content").alias("texts"))


def join_windows(starts: list[int], texts: list[str], block: int = 0, block_lines: int = BLOCK_LINES) -> tuple[int, str]:
    """(first line, text) of one block. Lines that no window holds are empty; of two texts for one line the window that starts first wins, of windows cut at the block's beginning the first given."""
    low, high = block * block_lines + 1, (block + 1) * block_lines
    if len(starts) == 1 and starts[0] >= low and (block == 0 or starts[0] > low) and texts[0].count("\n") < high - starts[0]:
        first = starts[0]
        return (1, "\n" * (first - 1) + texts[0]) if block == 0 else (low, "\n" * (first - low) + texts[0])
    lines: list[str] = []
    for s, text in sorted(zip(starts, texts, strict=True), key=itemgetter(0)):
        own = text.split("\n")
        at = low + len(lines)
        if s > at:
            lines.extend([""] * (s - at))
            at = s
        lines.extend(own[at - s :])
        if low + len(lines) > high:
            del lines[high - low + 1 :]
            break
    return low, "\n".join(lines)


def each_block(batches: Iterator[pa.RecordBatch], block_lines: int = BLOCK_LINES) -> Iterator[list[tuple[str, str, int, int, str]]]:
    """For mapInArrow over windows_by_block: lists of (project, path, block, first line, text), a batch at a time."""
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        starts, texts = columns["starts"].to_pylist(), columns["texts"].to_pylist()
        out = []
        for project, path, block, s, t in zip(columns["project"].to_pylist(), columns["path"].to_pylist(), columns["block"].to_pylist(), starts, texts, strict=True):
            first, text = join_windows(s, t, block, block_lines)
            out.append((project, path, block, first, text))
        yield out


def file_texts(chunks: DataFrame) -> DataFrame:
    """project, path, chunks, text: a file's windows one behind the other, in order of line and id; lines that windows share come twice."""
    own = chunks.where("content is not null").groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "content"))).alias("w"))
    return own.select("project", "path", F.size("w").cast("bigint").alias("chunks"), F.array_join(F.col("w.content"), "\n").alias("text"))
