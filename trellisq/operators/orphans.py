"""References to records that do not exist (problem 6).

Tagged parent and child keys are united in long form and grouped by parent field, model and key; the groups
that lack a parent, or whose first parent came too late, are kept and joined back to the child rows.
The grouping carries three numbers per key, so a hot key costs a partial aggregate per task and nothing more.

Defined results: a reference whose own column is null is no reference; a null source_model_id matches no
parent (state ``missing``); a null time on either side is never ``late``; repeated member rows each give a
row; empty tables give an empty result. Extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REF_FIELDS = ("entity_id", "endpoint_global_id", "endpoint_step_id")


def _long(fields: list[tuple[str, Column]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(n).alias("ref_field"), c.cast("string").alias("key")) for n, c in fields)))


def references(members: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row for each reference that is stated: member_id, ref_field, source_model_id, key, rel_ts."""
    step = F.when(F.col("endpoint_global_id").isNotNull(), F.col("endpoint_step_id"))
    m = members.select(
        F.col("id").alias("member_id"),
        "relationship_id",
        "source_model_id",
        _long([("entity_id", F.col("entity_id")), ("endpoint_global_id", F.col("endpoint_global_id")), ("endpoint_step_id", step)]).alias("r"),
    ).where("r.key is not null")
    r = relationships.select(F.col("id").alias("relationship_id"), F.col("import_timestamp").alias("rel_ts")).where("id is not null")
    return m.join(r, "relationship_id", "left").select("member_id", F.col("r.ref_field").alias("ref_field"), "source_model_id", F.col("r.key").alias("key"), "rel_ts")


def orphan_references(members: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """member_id, ref_field, state, rel_ts of each reference that finds no entity or only a later one."""
    refs = references(members, relationships)
    parents = entities.where("source_model_id is not null").select(
        "source_model_id",
        F.col("import_timestamp").alias("parent_ts"),
        _long([("entity_id", F.col("id")), ("endpoint_global_id", F.col("global_id")), ("endpoint_step_id", F.col("step_id"))]).alias("r"),
    ).where("r.key is not null")
    null_ts = F.lit(None).cast("timestamp_ntz")
    tagged = refs.select("ref_field", "source_model_id", "key", F.lit(False).alias("is_parent"), null_ts.alias("parent_ts"), F.col("rel_ts").cast("timestamp_ntz").alias("rel_ts")).unionByName(
        parents.select("r.ref_field", "source_model_id", "r.key", F.lit(True).alias("is_parent"), F.col("parent_ts").cast("timestamp_ntz").alias("parent_ts"), null_ts.alias("rel_ts"))
    )
    suspect = (
        tagged.groupBy("ref_field", "source_model_id", "key")
        .agg(F.max("is_parent").alias("has_parent"), F.min("is_parent").alias("only_parent"), F.min("parent_ts").alias("first_parent"), F.min("rel_ts").alias("first_ref"))
        .where("not only_parent and (not has_parent or first_parent > first_ref)")
        .select("ref_field", F.col("source_model_id").alias("s_model"), "key", "has_parent", "first_parent")
    )
    c = refs.alias("c")
    s = suspect.alias("s")
    on = (F.col("c.ref_field") == F.col("s.ref_field")) & (F.col("c.key") == F.col("s.key")) & F.col("c.source_model_id").eqNullSafe(F.col("s.s_model"))
    return (
        c.join(s, on)
        .select("c.member_id", "c.ref_field", F.when(~F.col("has_parent"), "missing").when(F.col("first_parent") > F.col("c.rel_ts").cast("timestamp_ntz"), "late").alias("state"), F.col("c.rel_ts").alias("rel_ts"))
        .where("state is not null")
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Counts by reference field, state and month of the relationship (null month: no such relationship or time)."""
    return orphans.groupBy("ref_field", "state", F.date_format("rel_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
