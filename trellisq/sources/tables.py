"""Table sources: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "ifc_source_models model_families source_model_catalog_entries ifc_entities ifc_relationships "
    "relationship_members rag_documents attribute_catalog eval_items"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
