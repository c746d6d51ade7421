"""Generations of tables in a folder: written aside, checked, then pointed to."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.publish import publish_diff


class _Files:
    """A folder in whatever file system Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def names(self, name: str = "") -> list[str]:
        place = self._path(f"{self.folder}/{name}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read_json(self, name: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))

    def write_json(self, name: str, value: dict) -> None:
        """The file is replaced in one step: readers see the old one or the new one, also if this process dies."""
        new, target = self._path(f"{self.folder}/{name}.new"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(new, target, options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class GenerationStore:
    """folder/<generation>/<table> holds the rows; folder/POINTER names the published generation.

    Files go through Hadoop's file system, so the folder may be anything Spark can reach. A generation becomes visible by the
    replacement of one small file in one step; a failure before it leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), _Files(spark, folder)

    def published(self) -> str | None:
        return self._files.read_json("POINTER")["generation"] if self._files.exists("POINTER") else None

    def read(self, table: str) -> DataFrame:
        generation = self.published()
        if generation is None:
            raise LookupError("nothing is published")
        return self.spark.read.parquet(f"{self.folder}/{generation}/{table}")

    def publish(self, generation: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
        """Write every table, run the check on what was written, then point to it. The check raises to refuse."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{generation}/{name}")
        written = {name: self.spark.read.parquet(f"{self.folder}/{generation}/{name}") for name in tables}
        if check:
            check(written)
        self._files.write_json("POINTER", {"generation": generation})


class ProjectStore:
    """A project's tables at folder/<table>/project=<project>/<generation>, each project with a pointer of its own.

    Publishing one project touches no file of another. POINTERS/<project> names its generation and what it was made of.
    """

    TABLES = ("chunks", "source_authority", "symbols", "edges", "chunk_embeddings")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), _Files(spark, folder)

    def projects(self) -> list[str]:
        return [n for n in self._files.names("POINTERS") if not n.startswith(".") and not n.endswith(".new")]

    def snapshot(self, project: str) -> dict[str, str] | None:
        """generation_id, commit_hash, digests, extractor_version and indexed_at of what is published, or None."""
        return self._files.read_json(f"POINTERS/{project}") if self._files.exists(f"POINTERS/{project}") else None

    def repos(self) -> DataFrame:
        """A row per project with what its pointer says."""
        rows = [(p, *(self.snapshot(p).get(k) for k in ("commit_hash", "content_digest", "graph_digest", "extractor_version", "generation_id", "indexed_at"))) for p in self.projects()]
        return self.spark.createDataFrame(rows, "project string, commit_hash string, content_digest string, graph_digest string, extractor_version string, generation_id string, indexed_at string")

    def _place(self, table: str, project: str, generation: str) -> str:
        return f"{table}/project={project}/{generation}"

    def read(self, table: str, project: str | None = None) -> DataFrame | None:
        """The published rows of a table, of one project or of all; None if there are none."""
        places = []
        for p in [project] if project else self.projects():
            own = self.snapshot(p)
            if own and self._files.exists(self._place(table, p, own["tables"].get(table, own["generation_id"]))):
                places.append(f"{self.folder}/{self._place(table, p, own['tables'].get(table, own['generation_id']))}")
        return self.spark.read.parquet(*places) if places else None

    def publish(self, project: str, generation: str, tables: dict[str, DataFrame], about: dict[str, str], check: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, str]:
        """Write a project's tables as a generation, check them, point to it, and drop the one before. Tables that aren't given stay as they are."""
        before = self.snapshot(project)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{self._place(name, project, generation)}")
        if check:
            check({name: self.spark.read.parquet(f"{self.folder}/{self._place(name, project, generation)}") for name in tables})
        kept = dict(before["tables"]) if before else {}
        pointer = {**about, "generation_id": generation, "indexed_at": datetime.now(UTC).isoformat(timespec="seconds"), "tables": kept | dict.fromkeys(tables, generation)}
        self._files.write_json(f"POINTERS/{project}", pointer)
        for name in tables:
            if name in kept and kept[name] != generation:
                self._files.delete(self._place(name, project, kept[name]))
        return pointer

    def upsert_embeddings(self, project: str, arrived: DataFrame) -> None:
        """Vectors that arrive replace those of the same chunk and model, the latest of each counts; vectors of chunks that are gone go too."""
        old, chunks = self.read("chunk_embeddings", project), self.read("chunks", project)
        every = arrived if old is None else old.unionByName(arrived)
        last = every.groupBy("chunk_id", "model").agg(F.max_by(F.struct("dimension", "vector", "embedded_at"), F.struct(F.col("embedded_at").isNotNull(), "embedded_at")).alias("e")).select("chunk_id", "model", "e.*")
        if chunks is not None:
            last = last.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        own = self.snapshot(project)
        number = int(own["tables"].get("chunk_embeddings", "v0").lstrip("v") or 0) + 1 if own else 1
        last.write.mode("overwrite").parquet(f"{self.folder}/{self._place('chunk_embeddings', project, f'v{number}')}")
        self._files.write_json(f"POINTERS/{project}", own | {"tables": own["tables"] | {"chunk_embeddings": f"v{number}"}})

    def purge(self, project: str) -> dict[str, int]:
        """Remove a project's rows from every table and its pointer; how many rows each table lost."""
        counts = {}
        for name in self.TABLES:
            df = self.read(name, project)
            counts[name] = df.count() if df is not None else 0
        self._files.delete(f"POINTERS/{project}")
        for name in self.TABLES:
            self._files.delete(f"{name}/project={project}")
        return counts


def keep_ids(published: DataFrame | None, desired: DataFrame) -> DataFrame:
    """desired (id, project, path, start_line, end_line, content, ...) with the ids that equal published chunks have; a chunk there twice keeps both."""
    if published is None:
        return desired
    kept = publish_diff(published, desired).where("change = 'kept'").select(F.col("new_id").alias("id"), "old_id")
    return desired.join(kept, "id", "left").withColumn("id", F.coalesce("old_id", "id")).drop("old_id")
