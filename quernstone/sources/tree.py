"""Files of a checkout as rows."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.classify import MOST_BYTES, is_indexable_path, is_safe_path


def _git(folder: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", folder, *arguments], check=True, capture_output=True, text=True).stdout


def listed_files(folder: str) -> list[str] | None:
    """The files that Git tracks or doesn't ignore, in order; None where the folder is no checkout."""
    if not os.path.isdir(os.path.join(folder, ".git")):
        return None
    return sorted(filter(None, _git(folder, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")))


def head_commit(folder: str) -> str:
    """The commit that a checkout stands at, or an empty text."""
    return _git(folder, "rev-parse", "HEAD").strip() if listed_files(folder) is not None else ""


def require_clean(folder: str) -> None:
    """Raises if a checkout holds changes that aren't committed."""
    changed = _git(folder, "status", "--porcelain", "--untracked-files=all").splitlines()
    if changed:
        raise ValueError(f"the checkout isn't clean: {' | '.join(changed[:5])}")


def _walked(folder: str) -> list[str]:
    out = []
    for place, folders, files in os.walk(folder):
        folders[:] = sorted(f for f in folders if f != ".git")
        out += [os.path.relpath(os.path.join(place, f), folder) for f in sorted(files)]
    return out


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length: the files of a folder that Git lists, or all there are. Spark's own file sources leave out names that begin with _ or a dot."""
    names = listed_files(folder)
    rows = [(n, os.path.getsize(os.path.join(folder, n))) for n in (_walked(folder) if names is None else names) if os.path.isfile(os.path.join(folder, n)) and not os.path.islink(os.path.join(folder, n))]
    return spark.createDataFrame(rows, "path string, length bigint").where(is_safe_path(F.col("path")))


def _read(files: DataFrame, folder: str) -> DataFrame:
    """path, content: the bytes of the files (path), read by the tasks; the folder has to be one that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                with open(os.path.join(folder, batch.column(0)[at].as_py()), "rb") as file:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([file.read()], pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def all_files(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """project, path, length: every file of a checkout, without filters."""
    return _files(spark, folder).select(F.lit(project).alias("project"), "path", "length")


def scan_tree(spark: SparkSession, folder: str, project: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """project, path, content: the indexable text files of a folder; of a checkout those that Git lists.

    Sizes and names are filtered before a file is read. Files that aren't UTF-8 are left out, as are secrets, lock files, output
    folders and files over the limit.
    """
    rows = _read(_files(spark, folder).where(F.col("length") <= most_bytes).where(is_indexable_path(F.col("path"))), folder)
    return rows.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.lit(project).alias("project"), "path", F.col("content").cast("string").alias("content"))


def scan_scripts(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """project, path, content: the SQL scripts of a folder, of any size; bytes that are no UTF-8 are dropped from their text."""

    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    rows = _read(_files(spark, folder).where(F.lower("path").endswith(".sql")), folder)
    return rows.select(F.lit(project).alias("project"), "path", F.pandas_udf(decode, "string")("content").alias("content"))
