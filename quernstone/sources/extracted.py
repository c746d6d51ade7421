"""Graphs that another extractor made, as files of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.tables import EDGES, SYMBOLS, conformed


def read_extracted(spark: SparkSession, symbols: str, edges: str) -> dict[str, DataFrame]:
    """symbols and edges of JSON lines whose fields are named as the tables' columns; metadata may be an object or text.

    Fields that a line lacks are null, except that an edge's source is its qualified source by default, its confidence unresolved
    and a symbol active; symbols without a name and edges without a target are left out, and signatures are cut to 500 characters.
    """

    def read(path: str, schema: str) -> DataFrame:
        raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.try_parse_json("value").alias("v")).where("v is not null")
        fields = [f.split() for f in schema.split(", ")]
        columns = [(F.coalesce(F.try_variant_get("v", f"$.{name}", "string"), F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))) if name == "metadata" else F.try_variant_get("v", f"$.{name}", kind)).alias(name) for name, kind in fields]
        return conformed(raw.select(*columns), schema)

    s = read(symbols, SYMBOLS).where("name is not null and name <> ''")
    s = s.withColumn("qualified_name", F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), "name")).withColumn("signature", F.substring("signature", 1, 500)).withColumn("active", F.coalesce("active", F.lit(1)))
    e = read(edges, EDGES).where("target_name is not null and target_name <> ''")
    e = e.withColumn("source_qualified_name", F.coalesce("source_qualified_name", "source_name")).withColumn("resolution_confidence", F.coalesce("resolution_confidence", F.lit("unresolved")))
    return {"symbols": s, "edges": e}
