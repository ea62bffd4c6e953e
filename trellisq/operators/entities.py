"""Typed operations on entities: count, list, point reads, aggregates with coverage, groups, missing values, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.model import AggregatePlan, FieldKind, FieldRef, ListPlan, PlanError, Scope
from trellisq.operators import fields
from trellisq.operators.predicate import in_scope, matching

NAME = FieldRef(FieldKind.ATTRIBUTE, "name")
STOREY = FieldRef(FieldKind.ATTRIBUTE, "storey_name")
IDENTITIES = 2000


def hydrate(rows: DataFrame) -> DataFrame:
    """id, global_id, ifc_class, name and storey of entities, with a one-line summary."""
    name, storey = fields.as_text(NAME), fields.as_text(STOREY)
    summary = F.nullif(F.concat_ws(" ", F.nullif(name, F.lit("")), F.concat(F.lit("on "), F.nullif(storey, F.lit("")))), F.lit(""))
    return rows.select("id", "global_id", "ifc_class", name.alias("name"), storey.alias("storey_name"), summary.alias("summary"))


def count_entities(entities: DataFrame, scope: Scope, where=None) -> DataFrame:
    return matching(entities, scope, where).agg(F.count(F.lit(1)).alias("n"))


def count_by_class(rows: DataFrame) -> DataFrame:
    """Exact histogram over classes, largest first."""
    return rows.groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ifc_class")


def list_entities(entities: DataFrame, plan: ListPlan) -> DataFrame:
    """A page of matching entities with the exact number of all that match.

    Sorting is by text unless a key is numeric; nulls come last, ids break ties.
    """
    keys = []
    for k in plan.sort:
        c = fields.as_number(k.field) if k.numeric else fields.as_text(k.field)
        keys.append(c.desc_nulls_last() if k.descending else c.asc_nulls_last())
    rows = matching(entities, plan.scope, plan.where)
    # The total is its own small aggregate: a window over everything would put all rows into one task.
    total = rows.agg(F.count(F.lit(1)).alias("exact_total"))
    page = rows.orderBy(*keys, F.col("id").asc()).offset(plan.offset).limit(plan.limit)
    return hydrate(page).crossJoin(total)  # one row


def get_entity(entities: DataFrame, model: int, entity_id: int | None = None, global_id: str | None = None) -> DataFrame:
    if (entity_id is None) == (global_id is None):
        raise PlanError("exactly one of id and global_id")
    rows = in_scope(entities, Scope(model))
    return rows.where(F.col("id") == entity_id) if entity_id is not None else rows.where(F.col("global_id") == global_id)


def select_by_ids(entities: DataFrame, model: int, ids: DataFrame) -> DataFrame:
    return in_scope(entities, Scope(model)).join(ids.select("id").distinct(), "id", "left_semi")


def _aggregate(function: str, number: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg}[function](number)


def aggregate_entities(entities: DataFrame, plan: AggregatePlan) -> DataFrame:
    """value, matched and coverage: how many rows match and how many of them have a number. No coverage, no value."""
    rows = matching(entities, plan.scope, plan.where)
    if plan.field is None:
        return rows.agg(F.count(F.lit(1)).cast("double").alias("value"), F.count(F.lit(1)).alias("matched"), F.count(F.lit(1)).alias("coverage"))
    number = fields.as_number(plan.field)
    return rows.agg(_aggregate(plan.function, number).alias("value"), F.count(F.lit(1)).alias("matched"), F.count(number).alias("coverage"))


def group_entities(entities: DataFrame, plan: AggregatePlan) -> DataFrame:
    """Groups by the text of a field, null being a group, largest first; ties by key."""
    if plan.group_by is None:
        raise PlanError("a group needs a field")
    rows = matching(entities, plan.scope, plan.where)
    aggs = [F.count(F.lit(1)).alias("n")]
    if plan.field is not None:
        number = fields.as_number(plan.field)
        aggs += [_aggregate(plan.function, number).alias("value"), F.count(number).alias("coverage")]
    return rows.groupBy(fields.as_text(plan.group_by).alias("key")).agg(*aggs).orderBy(F.desc("n"), F.col("key").asc_nulls_last()).limit(plan.limit)


def missing_values(entities: DataFrame, scope: Scope, ref: FieldRef, where=None) -> DataFrame:
    """Rows of each of absent, present_null, present_empty and present."""
    return matching(entities, scope, where).groupBy(fields.state(ref).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def missing_examples(entities: DataFrame, scope: Scope, ref: FieldRef, k: int = 3) -> DataFrame:
    """The first k ids of each state that is not present, in one pass.

    The window's partitions are cut to k rows per task first (a window group limit), so none is collected whole.
    """
    rows = matching(entities, scope).select("id", fields.state(ref).alias("state")).where("state <> 'present'")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("state").orderBy("id"))).where(F.col("nth") <= k)


def identities(rows: DataFrame, limit: int = IDENTITIES) -> DataFrame:
    """Identities for a viewer: the first ones by id, the exact total and whether the list is cut."""
    total = rows.agg(F.count(F.lit(1)).alias("exact_total"))
    return rows.orderBy("id").limit(limit).select("id", "global_id", "ifc_class").crossJoin(total).withColumn("truncated", F.col("exact_total") > limit)


def _folded(ref: FieldRef) -> Column:
    return F.lower(F.trim(fields.as_text(ref)))


def same_type(entities: DataFrame, scope: Scope, type_name: str | None = None, type_global_id: str | None = None) -> DataFrame:
    """Instances of a type, by its global id or by its name without regard to case and outer blanks."""
    if (type_name is None) == (type_global_id is None):
        raise PlanError("exactly one of type name and type global id")
    rows = in_scope(entities, scope)
    if type_global_id is not None:
        return rows.where(fields.as_text(FieldRef(FieldKind.TYPE_FACT, "type_global_id")) == type_global_id)
    return rows.where(_folded(FieldRef(FieldKind.TYPE_FACT, "type_name")) == type_name.strip().lower())


def same_property(entities: DataFrame, scope: Scope, ref: FieldRef, value: str) -> DataFrame:
    """Entities whose property (a family name, say) equals the value without regard to case and outer blanks."""
    return in_scope(entities, scope).where(_folded(ref) == value.strip().lower())


def normalize_global_ids(ids: list[str | None]) -> list[str]:
    """Trimmed, without blanks and repeats, in order of first mention."""
    return list(dict.fromkeys(x.strip() for x in ids if x and x.strip()))


def resolve_selection(entities: DataFrame, model: int, global_ids: list[str | None]) -> DataFrame:
    """The selected entities in the order asked for; ids of other models do not resolve."""
    wanted = normalize_global_ids(global_ids)
    spark = entities.sparkSession
    asked = spark.createDataFrame([(i, g) for i, g in enumerate(wanted)], "pos int, global_id string")
    first = in_scope(entities, Scope(model)).join(asked, "global_id").groupBy("pos", "global_id").agg(F.min("id").alias("id"), F.min_by("ifc_class", "id").alias("ifc_class"))
    return first.orderBy("pos")


def details(entities: DataFrame, model: int, global_id: str, per_section: int = 24, materials: int = 12, width: int = 120) -> DataFrame:
    """Display rows of one entity: properties and quantities by set and name, materials without repeats."""
    one = get_entity(entities, model, global_id=global_id)
    f = fields.entity_fields(one).where("value is not null and value <> ''").select("section", "set_name", "field_name", F.substring("value", 1, width).alias("value"))
    w = Window.partitionBy("section").orderBy("set_name", "field_name")
    sets = f.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_section)
    names = F.from_json(F.get_json_object("canonical_json", "$.materials"), "array<struct<name:string>>")["name"]
    m = one.select(F.posexplode(F.slice(F.array_distinct(names), 1, materials)).alias("nth", "value")).select(
        F.lit("materials").alias("section"), F.lit(None).cast("string").alias("set_name"), F.lit("name").alias("field_name"), F.substring("value", 1, width).alias("value"), (F.col("nth") + 1).alias("nth")
    )
    return sets.unionByName(m)
