"""Line windows of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_windows(files: DataFrame, text: str = "content", size: int = 80, overlap: int = 15) -> DataFrame:
    """The columns of files besides the text, then start_line, end_line and content: windows of ``size`` lines that overlap.

    The first window that reaches the end is the last. A trailing line break ends the last line and begins none. A null text has
    no windows, an empty one has none either. All in the JVM, one row in and its windows out, no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    others = [c for c in files.columns if c not in (text, "start_line", "end_line")]
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "")
    lines = F.split(body, "\n", -1)
    rows = files.where(F.length(F.col(text)) > 0).select(*others, lines.alias("__lines")).withColumn("__n", F.size("__lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / F.lit(step))) * step
    rows = rows.select(*others, "__lines", "__n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("__at"))
    start, end = F.col("__at") + 1, F.least(F.col("__at") + size, F.col("__n").cast("long"))
    window = F.array_join(F.slice("__lines", start.cast("int"), F.lit(size)), "\n")
    return rows.select(*others, start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), window.alias("content"))


def token_estimate(characters: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(characters / 4)).cast("long")
