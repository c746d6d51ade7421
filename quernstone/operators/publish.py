"""Publishing of generations: differences, checks, digests, purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_KEY = ("project", "path", "start_line", "end_line", "content")


def publish_diff(published: DataFrame, desired: DataFrame, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """key columns, old_id, new_id, change ('kept', 'inserted', 'deleted'): the multiset difference of two generations.

    Equal rows are numbered on both sides, so a row that is there three times and wanted twice is kept twice and deleted once.
    The content takes part as a hash, so that the shuffle doesn't carry the texts; nulls in the key are equal to each other.
    """
    hashed = [c for c in key if c == "content"]
    plain = [c for c in key if c != "content"]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        own = df.select(*plain, *[F.sha2(c, 256).alias(c) for c in hashed], (F.col("id") if "id" in df.columns else F.lit(None).cast("bigint")).alias(name))
        return own.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(name)))

    old, new = numbered(published, "old_id").alias("o"), numbered(desired, "new_id").alias("n")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*key, "copy")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    change = F.when(F.col("n.copy").isNull(), "deleted").when(F.col("o.copy").isNull(), "inserted").otherwise("kept")
    return old.join(new, on, "full_outer").select(*[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in plain], *[F.coalesce(f"o.{c}", f"n.{c}").alias(f"{c}_hash") for c in hashed], F.col("old_id"), F.col("new_id"), change.alias("change"))


def generation_uniformity(tables: dict[str, DataFrame]) -> DataFrame:
    """source, project, generations, uniform: how many generations each project's rows of each table belong to."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("project").agg(F.count_distinct("generation_id").alias("generations")).select(F.lit(name).alias("source"), "project", "generations", (F.col("generations") == 1).cast("int").alias("uniform"))
        out = one if out is None else out.unionByName(one)
    return out


def purge_counts(tables: dict[str, DataFrame], project: str) -> DataFrame:
    """source, removed: the rows of each table that purging a project removes."""
    out = None
    for name, df in tables.items():
        one = df.where(F.col("project") == project).agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("source"), "removed")
        out = one if out is None else out.unionByName(one)
    return out


def file_digests(chunks: DataFrame) -> DataFrame:
    """project, path, digest: a stable hash of a file's distinct windows in line order. A file's hashes meet in one row, not its texts."""
    own = chunks.where("content is not null").select("project", "path", "start_line", F.sha2("content", 256).alias("h")).distinct()
    return own.groupBy("project", "path").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def project_digests(chunks: DataFrame) -> DataFrame:
    """project, files, digest: a hash of a project's files, each framed by its path's length. Files' digests meet, a short string each."""
    framed = F.concat(F.lpad(F.octet_length("path").cast("string"), 8, "0"), F.col("path"), F.col("digest"))
    return file_digests(chunks).groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(framed)), ""), 256).alias("digest"))


EDGE_FIELDS = ("source_path", "source_name", "source_qualified_name", "relation", "target_name", "target_path", "target_qualified_name", "line", "resolution_confidence", "metadata")
SYMBOL_FIELDS = ("path", "kind", "qualified_name", "start_line", "end_line", "active", "metadata")


def graph_digests(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, edges, symbols, digest: a hash of all that a project's graph says, whatever order its rows come in.

    Rows are hashed with the field order fixed and nulls told from empty texts; the hashes of a file's rows meet in order, then
    those of a project's files, so that no task sees all rows of a project.
    """

    def per_file(df: DataFrame, fields: tuple[str, ...], path: str, tag: str) -> DataFrame:
        row = F.sha2(F.concat_ws("\x1e", *[F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("~")) for f in fields]), 256)
        return df.select("project", F.col(path).alias("path"), row.alias("h")).groupBy("project", "path").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d")).withColumn("tag", F.lit(tag))

    files = per_file(edges, EDGE_FIELDS, "source_path", "E").unionByName(per_file(symbols, SYMBOL_FIELDS, "path", "S"))
    entry = F.concat_ws("\x1f", "tag", F.coalesce("path", F.lit("")), "d")
    return files.groupBy("project").agg(F.sum(F.when(F.col("tag") == "E", F.col("n")).otherwise(0)).alias("edges"), F.sum(F.when(F.col("tag") == "S", F.col("n")).otherwise(0)).alias("symbols"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"))


def indexed_paths(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """project, path: the files that have chunks or symbols."""
    return chunks.select("project", "path").union(symbols.select("project", "path")).distinct()


def freeze(project: str, tables: dict[str, DataFrame], repos: DataFrame) -> dict[str, str]:
    """What names a project's snapshot: its generation and digests, if all of its rows belong to the published generation; else an error."""
    pointer = repos.where(F.col("project") == project).select("commit_hash", "generation_id").distinct().limit(2).collect()
    if len(pointer) != 1:
        raise LookupError(f"{project} has {'no' if not pointer else 'more than one'} published generation")
    own = {name: df.where(F.col("project") == project) for name, df in tables.items()}
    for name, df in own.items():
        others = df.where(~F.col("generation_id").eqNullSafe(F.lit(pointer[0]["generation_id"]))).limit(1).count()
        if others:
            raise ValueError(f"{name} holds rows of another generation of {project}")
    content, graph = project_digests(own["chunks"]).first(), graph_digests(own["edges"], own["symbols"]).first()
    return {"project": project, "commit_hash": pointer[0]["commit_hash"], "generation_id": pointer[0]["generation_id"], "content_digest": content["digest"] if content else "", "graph_digest": graph["digest"] if graph else ""}


def still_current(snapshot: dict[str, str], tables: dict[str, DataFrame], repos: DataFrame) -> None:
    """Raises if the project's snapshot isn't what it was."""
    now = freeze(snapshot["project"], tables, repos)
    if now != snapshot:
        raise ValueError(f"the snapshot changed: {sorted(k for k in now if now[k] != snapshot[k])}")


def deduplicated_evidence(chunks: DataFrame) -> DataFrame:
    """evidence_id, copies, first_id, bytes: texts by content hash, with the bytes of one."""
    own = chunks.where("content is not null").select(F.concat(F.lit("V"), F.substring(F.sha2("content", 256), 1, 16)).alias("evidence_id"), "id", F.octet_length("content").cast("bigint").alias("b"))
    return own.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.max("b").alias("bytes"))
