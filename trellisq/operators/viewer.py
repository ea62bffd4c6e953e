"""Facts of a selected object for a viewer: type, family, storey and elevation as the record states them, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of properties that name a family, folded. Fixed values.
FAMILY_NAMES = ("family", "familyname", "familyandtype", "reference", "objecttypeoverride")
_NONE = "array<struct<set_name:string,field_name:string,value:string>>"


def object_facts(entities: DataFrame) -> DataFrame:
    """id, type_name, type_global_id, type_predefined_type, family, family_set, family_property, storey_name, storey_global_id, elevation.

    The family is the first family-like property with a value, by set and property name; the elevation counts only as
    a number. Blank texts are null; one parse a record.
    """
    v = entities.select("id", F.try_parse_json("canonical_json").alias("v"))
    g = lambda p: F.nullif(F.trim(F.try_variant_get("v", p, "string")), F.lit(""))
    sets = F.try_variant_get("v", "$.property_sets", "map<string,variant>")
    rows = v.withColumn("sets", F.transform_values(sets, lambda _, x: F.try_variant_get(x, "$", "map<string,variant>")))

    def of_set(name):
        fields = F.col("sets")[name]
        like = F.filter(F.array_sort(F.map_keys(fields)), lambda f: F.lower(F.regexp_replace(f, r"[^\p{L}\p{N}]", "")).isin(list(FAMILY_NAMES)))
        return F.coalesce(F.transform(like, lambda f: F.struct(name.alias("set_name"), f.alias("field_name"), F.nullif(F.trim(F.try_variant_get(fields[f], "$.value", "string")), F.lit("")).alias("value"))), F.array().cast(_NONE))

    families = F.filter(F.flatten(F.transform(F.coalesce(F.array_sort(F.map_keys("sets")), F.array().cast("array<string>")), of_set)), lambda x: x["value"].isNotNull())
    rows = rows.withColumn("first", F.try_element_at(families, F.lit(1)))
    typed = g("$.type.name").isNotNull() | g("$.type.global_id").isNotNull()
    number = F.schema_of_variant(F.try_variant_get("v", "$.placement.elevation", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|INT|FLOAT)")
    return rows.select(
        "id", g("$.type.name").alias("type_name"), g("$.type.global_id").alias("type_global_id"), F.when(typed, g("$.type.predefined_type")).alias("type_predefined_type"),
        F.col("first.value").alias("family"), F.col("first.set_name").alias("family_set"), F.col("first.field_name").alias("family_property"),
        g("$.storey.name").alias("storey_name"), g("$.storey.global_id").alias("storey_global_id"), F.when(number, F.try_variant_get("v", "$.placement.elevation", "double")).alias("elevation"),
    )
