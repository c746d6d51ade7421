"""Schemas of the tables the engine works on, and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REPOS = "project string, root string, commit_hash string, content_digest string, extractor_version string, generation_id string, indexed_at timestamp"
CHUNKS = "id bigint, project string, path string, start_line int, end_line int, commit_hash string, generation_id string, content string"
SOURCE_AUTHORITY = "project string, path string, authority string, reason string, commit_hash string, generation_id string"
SYMBOLS = (
    "id bigint, project string, path string, kind string, name string, qualified_name string, start_line int, end_line int, "
    "signature string, active int, metadata string, commit_hash string, generation_id string"
)
EDGES = (
    "id bigint, project string, source_path string, source_name string, relation string, target_name string, target_path string, "
    "line int, metadata string, source_qualified_name string, target_qualified_name string, resolution_confidence string, "
    "commit_hash string, generation_id string"
)
CHUNK_EMBEDDINGS = "chunk_id bigint, model string, dimension int, vector array<float>, embedded_at timestamp"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, project string, doc_type string, updated_at timestamp"
EVAL_ITEMS = "item_id bigint, suite string, lang string, text string"


#: The columns of graph tables that questions ask for; the others are long and seldom used.
LIGHT = {
    "edges": ("id", "project", "source_path", "source_name", "relation", "target_name", "target_path", "line", "source_qualified_name", "target_qualified_name", "resolution_confidence"),
    "symbols": ("id", "project", "path", "kind", "name", "qualified_name", "start_line", "end_line", "active"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema, in its order and types; columns that it lacks are null, others are left out."""
    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
