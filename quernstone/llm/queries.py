"""The pN_ queries of this package: name to (session, folder) -> DataFrame, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.encode import encode_texts
from quernstone.llm.handwritten import judge_files
from quernstone.llm.languages import code_languages
from quernstone.llm.leaks import leaked_passages
from quernstone.llm.neighbours import nearest, similar_pairs
from quernstone.llm.parsing import invalid_rates, judge_sources
from quernstone.llm.residue import find_residue
from quernstone.llm.secrets import find_credentials, redact_chunks
from quernstone.llm.splitting import split_chunks
from quernstone.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return code_languages(table(spark, folder, "chunks")).select("project", "path", "lang")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    return code_languages(table(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(table(spark, folder, "chunk_embeddings"))
    return pairs.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "chunk_embeddings"))


def p2_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, among all rows."""
    return nearest(table(spark, folder, "chunk_embeddings"), F.col("chunk_id") % 50 == 0)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_chunks(table(spark, folder, "chunks")).where("id is not null").select("id").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_chunks(table(spark, folder, "chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_evidence(spark, folder).select("project", "path")


def p4_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return judge_files(table(spark, folder, "source_authority"), table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_credentials(table(spark, folder, "chunks")).select("project", "path", "line")


def p5_credentials(spark: SparkSession, folder: str) -> DataFrame:
    return find_credentials(table(spark, folder, "chunks"))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact_chunks(table(spark, folder, "chunks"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return judge_sources(table(spark, folder, "chunks")).where("not valid").select("project", "path")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    return invalid_rates(table(spark, folder, "chunks"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, into how many documents, and the longest passage."""
    found = leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("passage_words").alias("longest"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_shares, p2_found, p2_neighbours, p2_search, p3_found, p3_pieces, p4_found, p4_evidence, p5_found, p5_credentials, p5_redacted, p7_found, p7_rates, p8_ids, p9_found, p9_passages, p9_items, p10_found, p10_kinds)
}
ORACLE_SQL: dict[str, str] = {
    "p3_found": "select distinct id from chunks where length(content) > 6000 and id is not null",
}
