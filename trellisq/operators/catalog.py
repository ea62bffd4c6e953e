"""The version catalog: models with their entries and families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.model import DEFAULT_LIMIT, Op, PlanError
from trellisq.operators.predicate import compile_catalog


def catalog(models: DataFrame, entries: DataFrame, families: DataFrame) -> DataFrame:
    """Every model, with its entry and family where it has them."""
    e = entries.select(
        F.col("source_model_id").alias("e_model"), "model_family_id", F.col("display_name").alias("entry_name"), "version_label", "version_order", "is_current", "project_type", "discipline", "tags", "status"
    )
    f = families.select(F.col("id").alias("f_id"), "family_key", F.col("display_name").alias("family_name"))
    m = models.select(F.col("id").alias("source_model_id"), "file_name", "file_fingerprint", "ifc_schema", "total_entity_count", "eligible_entity_count")
    return (
        m.join(e, F.col("source_model_id") == F.col("e_model"), "left")
        .join(f, F.col("model_family_id") == F.col("f_id"), "left")
        .drop("e_model", "f_id")
        .withColumn("display_name", F.coalesce("entry_name", F.concat(F.lit("Model "), F.col("source_model_id"))))
    )


def list_models(cat: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return cat.orderBy("source_model_id").limit(limit)


def filter_models(cat: DataFrame, op: str, conditions: list[tuple[str, Op, object]]) -> DataFrame:
    return cat.where(compile_catalog(op, conditions)).orderBy("source_model_id")


def list_versions(cat: DataFrame, family_key: str) -> DataFrame:
    """Versions of a family in order; those without an order come last."""
    return cat.where(F.col("family_key") == family_key).orderBy(F.col("version_order").asc_nulls_last(), "source_model_id")


def rank_by_entities(cat: DataFrame, entities: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Models by their number of entities; models without any are not ranked. Aggregated before the join."""
    n = entities.groupBy(F.col("source_model_id").alias("c_model")).agg(F.count(F.lit(1)).alias("n_entities"))
    return cat.join(n, F.col("source_model_id") == F.col("c_model")).drop("c_model").orderBy(F.desc("n_entities"), "source_model_id").limit(limit)


def metadata(cat: DataFrame, model: int) -> DataFrame:
    """The model's row; a missing model is an error."""
    row = cat.where(F.col("source_model_id") == model)
    if not row.take(1):
        raise PlanError(f"no model {model}")
    return row


def describe(cat: DataFrame) -> DataFrame:
    """One line a model: identity, version, whether it is current, status and schema, without what is unknown."""
    identity = F.concat("display_name", F.lit(" (id "), "source_model_id", F.lit(")"))
    current = F.when(F.col("is_current"), "current version")
    return cat.select("source_model_id", F.concat_ws(" — ", identity, F.nullif("version_label", F.lit("")), current, "status", "ifc_schema").alias("line"))


def current_conflicts(cat: DataFrame) -> DataFrame:
    """Families with several current versions."""
    return cat.where("is_current and family_key is not null").groupBy("family_key").agg(F.count(F.lit(1)).alias("n_current")).where("n_current > 1")


def selector_models(cat: DataFrame) -> DataFrame:
    """What a chooser of models shows, by id: no paths and no records."""
    return cat.select("source_model_id", F.col("file_fingerprint").alias("source_fingerprint"), F.col("entry_name").alias("display_name"), "status").orderBy("source_model_id")


def asset_identity(cat: DataFrame, model: int) -> DataFrame:
    """Identity that an asset request needs; no row if the model does not exist."""
    return cat.where(F.col("source_model_id") == model).select("source_model_id", F.col("file_fingerprint").alias("source_fingerprint"), "status")
