"""Profiles of a dataset: vocabularies, coverage, container shapes, units and relationships."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.runtime import Scratch

MIN_OCCURRENCES = 2
CATEGORICAL_VALUES, PER_FIELD = 15, 8
ENUMERATED = 200
SCHEMA_RATIO, MIN_FIELDS = 8.0, 64
UNIT_VARIANTS = 8
STRICT_NUMBER = r"^-?\d+(\.\d+)?\z"
STEM_SUFFIX = r"_\(#\d+\)$"


def top_per(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k commonest values of each key; ties by value. Counts are pre-aggregated, so the window sees distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def is_noise(text: Column) -> Column:
    """Values that say nothing of a vocabulary: blanks, long texts, references, identifiers and numbers."""
    return (
        text.isNull() | (F.trim(text) == "") | (F.char_length(text) > 60) | text.rlike(r"^#\d") | text.rlike(r"^[0-9A-Za-z_$]{22}\z")
        | text.rlike(r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}\z") | text.rlike(STRICT_NUMBER)
    )


def name_stem(name: Column) -> Column:
    return F.regexp_replace(name, STEM_SUFFIX, "")


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_model_id", "ifc_class").agg(F.count(F.lit(1)).alias("n"))


def name_stems(entities: DataFrame, k: int = 20) -> DataFrame:
    stem = name_stem(F.get_json_object("canonical_json", "$.identity.name"))
    rows = entities.select("ifc_class", stem.alias("stem"))
    return top_per(rows.where(~is_noise(F.col("stem"))), ["ifc_class"], "stem", k)


def materials(entities: DataFrame) -> DataFrame:
    """Materials of each class by the number of entities that have them."""
    m = F.from_json(F.get_json_object("canonical_json", "$.materials"), "array<struct<name:string>>")
    return entities.select("id", "ifc_class", F.explode(m["name"]).alias("material")).where("material is not null").groupBy("ifc_class", "material").agg(F.countDistinct("id").alias("n"))


def classifications(entities: DataFrame) -> DataFrame:
    c = F.from_json(F.get_json_object("canonical_json", "$.classifications"), "array<struct<system:string,code:string,description:string>>")
    return entities.select("id", F.explode(c).alias("c")).groupBy("c.system", "c.code").agg(F.countDistinct("id").alias("n"))


def field_coverage(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """How many entities of a class state each field: absent, partial or populated."""
    total = entities.groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n_total"))
    filled = F.when(F.col("value").isNotNull() & (F.col("value") != ""), F.col("entity_id"))
    got = fields.groupBy("ifc_class", "section", "set_name", "field_name").agg(F.countDistinct(filled).alias("n_filled"))
    state = F.when(F.col("n_filled") == 0, "absent").when(F.col("n_filled") >= F.col("n_total"), "populated").otherwise("partial")
    return got.join(total, "ifc_class").withColumn("coverage", state)


def value_facts(fields: DataFrame, min_occurrences: int = MIN_OCCURRENCES) -> DataFrame:
    """Values of categorical property fields: length 2 to 40, repeated, of fields with at most 15 such values; 8 a field."""
    v = fields.where("section = 'property_sets' and value_kind = 'string' and char_length(value) between 2 and 40")
    n = v.groupBy("ifc_class", "field_name", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_occurrences)
    key = ["ifc_class", "field_name"]
    few = n.groupBy(*key).agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") <= CATEGORICAL_VALUES)
    w = Window.partitionBy(*key).orderBy(F.desc("n"), "value")
    return n.join(few, key).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= PER_FIELD)


def data_type(fields: DataFrame) -> DataFrame:
    """boolean if all stated values are, number if all are plain numbers, else text."""
    v = fields.where("value is not null and value <> ''")
    kind = F.when(F.bool_and(F.lower("value").isin("true", "false")), "boolean").when(F.bool_and(F.col("value").rlike(STRICT_NUMBER)), "number").otherwise("text")
    return v.groupBy("section", "set_name", "field_name").agg(kind.alias("data_type"), F.count(F.lit(1)).alias("n"))


def field_values(fields: DataFrame, limit: int = ENUMERATED) -> DataFrame:
    """Fields with few distinct values are enumerated, those with more only searchable."""
    d = fields.where("value is not null and value <> ''").groupBy("section", "set_name", "field_name").agg(F.countDistinct("value").alias("n_values"))
    few = d.where(F.col("n_values") <= limit).select("section", "set_name", "field_name")
    on = (F.col("a.section") == F.col("b.section")) & F.col("a.set_name").eqNullSafe(F.col("b.set_name")) & (F.col("a.field_name") == F.col("b.field_name"))
    listed = fields.alias("a").join(few.alias("b"), on, "left_semi").where("value is not null and value <> ''").groupBy("section", "set_name", "field_name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    on = (F.col("d.section") == F.col("l.section")) & F.col("d.set_name").eqNullSafe(F.col("l.set_name")) & (F.col("d.field_name") == F.col("l.field_name"))
    return d.alias("d").join(listed.alias("l"), on, "left").select("d.section", "d.set_name", "d.field_name", "n_values", "values", F.when(F.col("n_values") > limit, "searchable").otherwise("enumerated").alias("access"))


def container_shapes(fields: DataFrame) -> DataFrame:
    """Whether the sets of a name share a schema: unreliable with 64 fields or more and 8 times those of one entity."""
    g = fields.where("set_name is not null").groupBy("section", "set_name").agg(
        F.countDistinct("field_name").alias("n_fields"), F.countDistinct("entity_id").alias("n_entities"), F.count(F.lit(1)).alias("n_instances")
    )
    ratio = F.col("n_fields") / (F.col("n_instances") / F.col("n_entities"))
    return g.withColumn("schema_ratio", ratio).withColumn("reliable", ~((F.col("n_fields") >= MIN_FIELDS) & (ratio >= SCHEMA_RATIO)))


def measure_facts(fields: DataFrame, defaults: DataFrame, symbols: DataFrame) -> DataFrame:
    """Whether the numbers of a field are on one scale: uniform, mixed or unknown, and why not.

    defaults: source_model_id, measure_type, unit_key; symbols: source_model_id, unit_key, symbol.
    """
    v = fields.where("value is not null and value <> ''")
    d = defaults.select("source_model_id", "measure_type", F.col("unit_key").alias("default_key"))
    e = v.join(d, ["source_model_id", "measure_type"], "left").withColumn("unit_key", F.coalesce("unit_override_key", "default_key"))
    e = e.join(symbols.select("source_model_id", "unit_key", "symbol"), ["source_model_id", "unit_key"], "left")
    typed = F.col("measure_type").isNotNull()
    key = ["source_model_id", "section", "set_name", "field_name"]
    unit = F.coalesce("unit_key", F.lit(""))
    g = e.groupBy(*key).agg(
        F.count_if(typed).alias("n_typed"),
        F.count_if(~typed).alias("n_untyped"),
        F.countDistinct("measure_type").alias("n_measures"),
        F.min("measure_type").alias("a_measure"),
        F.countDistinct(F.when(typed, unit)).alias("n_units"),
        F.min(F.when(typed, unit)).alias("a_unit"),
        F.min(F.when(typed, F.col("symbol"))).alias("a_symbol"),
    )
    reason = (
        F.when(F.col("n_typed") == 0, "not measured")
        .when(F.col("n_measures") > 1, "several measure types")
        .when(F.col("n_untyped") > 0, "partly untyped")
        .when(F.col("n_units") > 1, "several units")
        .when(F.col("a_unit") == "", "no default unit")
        .when(F.col("a_symbol").isNull(), "unit not resolved")
    )
    state = F.when(reason.isNull(), "uniform").when(reason == "several units", "mixed").when(reason == "not measured", "none").otherwise("unknown")
    return g.select(*key, "n_typed", "n_untyped", F.when(F.col("n_measures") == 1, F.col("a_measure")).alias("measure_type"), state.alias("unit_state"), reason.alias("limitation"), F.when(state == "uniform", F.col("a_symbol")).alias("symbol"))


def unit_tables(models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defaults, symbols) that the models declare."""
    meta = F.from_json("extraction_metadata", "struct<dimension_units:struct<defaults:map<string,string>,definitions:map<string,struct<symbol:string,resolved:boolean>>>>")["dimension_units"]
    m = models.select(F.col("id").alias("source_model_id"), meta.alias("u"))
    defaults = m.select("source_model_id", F.explode("u.defaults").alias("measure_type", "unit_key")).where("unit_key is not null")
    symbols = m.select("source_model_id", F.explode("u.definitions").alias("unit_key", "d")).where("coalesce(d.resolved, true)").select("source_model_id", "unit_key", F.col("d.symbol").alias("symbol"))
    return defaults, symbols


def fair_trim(rows: DataFrame, buckets: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most cap rows, taken in turn from each bucket: first all firsts, then all seconds."""
    nth = F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))
    # No bucket gives more than cap rows; the bound lets each task drop the rest of a large bucket before it is shuffled.
    return rows.withColumn("turn", nth).where(F.col("turn") <= cap).orderBy("turn", *buckets).limit(cap)


def reliable_structure(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Of each role how many endpoints resolve, over the members of known relationships."""
    known = entities.select(F.col("id").alias("entity_id"), F.lit(True).alias("known"))
    return members.join(known, "entity_id", "left").groupBy(F.lower("role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known")).alias("n_resolved"))


def building_profile(entities: DataFrame, families: int = 12, categories: int = 8) -> DataFrame:
    """The commonest classes and materials of each model."""
    cls = top_per(entities.select("source_model_id", F.col("ifc_class").alias("value")), ["source_model_id"], "value", families).withColumn("kind", F.lit("class"))
    m = F.from_json(F.get_json_object("canonical_json", "$.materials"), "array<struct<name:string>>")
    mat = entities.select("source_model_id", F.explode(m["name"]).alias("value")).where("value is not null")
    return cls.unionByName(top_per(mat, ["source_model_id"], "value", categories).withColumn("kind", F.lit("material")))


def nearest_rank(rows: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """Percentiles by nearest rank, at index round(f * (n - 1)) of the sorted values.

    Values are counted first; the counts are sorted by ranges, and a range knows its start from the totals of those
    before it, one number a range.
    """
    s = Scratch(rows.sparkSession, "ranks")
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    run = s.cut(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in run.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a range
        before[r.part], total = total, total + r.n
    asks = rows.sparkSession.createDataFrame([(f, int(math.floor(f * (total - 1) + 0.5)) + 1) for f in fractions] if total else [], "fraction double, at long")
    start = F.create_map(*(F.lit(x).cast("long") if i else F.lit(x) for kv in before.items() for i, x in enumerate(kv))) if before else F.lit(None)
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = run.withColumn("upto", upto + (start[F.col("part")] if before else F.lit(0)))
    hit = placed.join(F.broadcast(asks), (F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("n")))  # a row for each fraction asked for
    return hit.select("fraction", "value")
