"""Incremental refresh of published chunks, and of their vectors, by streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.atlas import claim_id
from quernstone.sources.store import GenerationStore, ProjectStore

PLACE = ("project", "path", "start_line")


def merge_chunks(published: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """The published chunks with those that arrived: files that arrived replace their old chunks, and equal ones keep their id.

    arrived: project, path, start_line, end_line, content, with ids of their own for chunks that are new.
    """
    own = arrived.withColumn("n", F.row_number().over(Window.partitionBy(*PLACE).orderBy("id"))).where("n = 1").drop("n")
    if published is None:
        return own
    same = ["project", "path", "start_line", "end_line"]
    old = published.select(*same, F.sha2("content", 256).alias("h"), F.col("id").alias("old_id"))
    kept = own.withColumn("h", F.sha2("content", 256)).join(old, [*same, "h"], "left").withColumn("id", F.coalesce("old_id", "id")).select(*own.columns)
    touched = own.select("project", "path").distinct()
    return published.join(touched, ["project", "path"], "left_anti").select(*own.columns).unionByName(kept)


def refresh_stream(stream: DataFrame, store: GenerationStore, checkpoint: str, table: str = "chunks") -> StreamingQuery:
    """Publish a generation of the whole table per micro-batch; a batch that is repeated after a failure writes the same generation again."""

    def publish(batch: DataFrame, number: int) -> None:
        generation = f"g{number:012d}"
        current = store.published()
        if batch.isEmpty() or current == generation:
            return
        store.publish(generation, {table: merge_chunks(store.read(table) if current else None, batch)})

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_projects(stream: DataFrame, store: ProjectStore, checkpoint: str) -> StreamingQuery:
    """Publish, per micro-batch, only the projects that it holds files of; a repeated batch publishes the same generation again."""

    def publish(batch: DataFrame, number: int) -> None:
        generation = f"g{number:012d}"
        for row in batch.select("project").distinct().toLocalIterator():  # names of projects
            own = store.snapshot(row["project"])
            if own is None or own["generation_id"] != generation:
                arrived = batch.where(F.col("project") == row["project"])
                store.publish(row["project"], generation, {"chunks": merge_chunks(store.read("chunks", row["project"]), arrived)}, {"commit_hash": ""})

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claim_stream(claims: DataFrame) -> DataFrame:
    """claim_id, support, evidence, contradicted: a stream of claims (text, kind, support, evidence) merged as it comes; nothing is removed.

    State is kept per claim: the first known support, the evidence named so far and whether both support and refutal were seen.
    """

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        support, evidence, states = state.get if state.exists else ("unknown", "", "")
        held, seen = set(filter(None, evidence.split("\x1f"))), set(filter(None, states.split(",")))
        for frame in frames:
            for own, source in zip(frame["support"], frame["evidence"], strict=True):
                if own in ("support", "refute"):
                    support = own if support == "unknown" else support
                    seen.add(own)
                if source:
                    held.add(source)
        state.update((support, "\x1f".join(sorted(held)), ",".join(sorted(seen))))
        yield pd.DataFrame({"claim_id": [key[0]], "support": [support], "evidence": [len(held)], "contradicted": [int(len(seen) > 1)]})

    keyed = claims.withColumn("claim_id", claim_id(F.col("text"), F.col("kind")))
    return keyed.groupBy("claim_id").applyInPandasWithState(merge, "claim_id string, support string, evidence bigint, contradicted int", "support string, evidence string, states string", "update", GroupStateTimeout.NoTimeout)


def embedding_stream(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], known: Callable[[], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Embed the chunks of each micro-batch whose content has no vector yet.

    embed: content_hash, content -> content_hash, vector. known: the content hashes that have one.
    """

    def fill(batch: DataFrame, number: int) -> None:
        texts = batch.where("content is not null").select(F.sha2("content", 256).alias("content_hash"), "content").dropDuplicates(["content_hash"])
        embed(texts.join(known().select("content_hash"), "content_hash", "left_anti")).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(fill).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """event_type, begin, n, value: events per window of time, those later than the watermark left out; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("event_type", F.col("window.start").alias("begin"), "n", "value")
