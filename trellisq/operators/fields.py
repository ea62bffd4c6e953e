"""Field access on rows with a semi-structured column, and the long table of all fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.model import AmbiguousField, FieldKind, FieldRef, PlanError

#: Attributes that are columns of their own.
COLUMNS = ("global_id", "ifc_class", "step_id")
#: Attributes and type facts inside the JSON column. Fixed values.
PATHS = {
    "name": ("identity", "name"),
    "description": ("identity", "description"),
    "object_type": ("identity", "object_type"),
    "tag": ("identity", "tag"),
    "long_name": ("identity", "long_name"),
    "composition_type": ("identity", "composition_type"),
    "predefined_type": ("meta", "predefined_type"),
    "storey_name": ("storey", "name"),
    "storey_global_id": ("storey", "global_id"),
}
TYPE_PATHS = {"type_name": ("type", "name"), "type_global_id": ("type", "global_id"), "type_predefined_type": ("type", "predefined_type")}
NUMERIC = r"^-?\d+(\.\d+)?\z"


def path_of(ref: FieldRef) -> tuple[str, ...] | None:
    """Keys down to the leaf in the JSON column; None for a column of its own."""
    if ref.kind is FieldKind.ATTRIBUTE:
        if ref.name in COLUMNS:
            return None
        if ref.name in PATHS:
            return PATHS[ref.name]
    elif ref.kind is FieldKind.TYPE_FACT and ref.name in TYPE_PATHS:
        return TYPE_PATHS[ref.name]
    elif ref.kind is FieldKind.PROPERTY:
        return ("property_sets", ref.set_name, ref.name, "value")
    elif ref.kind is FieldKind.QUANTITY:
        return ("quantity_sets", ref.set_name, ref.name, "value")
    elif ref.kind is FieldKind.MEASUREMENT:
        return ("measurements", ref.name, "value")
    raise PlanError(f"unknown field {ref.kind.value} {ref.name}")


def json_path(keys: tuple[str, ...]) -> str:
    if any("'" in k or "]" in k for k in keys):
        raise PlanError("a path key may not hold a quote or bracket")
    return "$" + "".join(f"['{k}']" for k in keys)


def as_text(ref: FieldRef) -> Column:
    """The leaf as text: raw JSON text of numbers and objects, null for JSON null and absent keys."""
    keys = path_of(ref)
    return F.col(ref.name).cast("string") if keys is None else F.get_json_object("canonical_json", json_path(keys))


def as_number(ref: FieldRef) -> Column:
    """The leaf as double where its text is a plain decimal number, else null."""
    return guarded_number(as_text(ref))


def guarded_number(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def has_key(ref: FieldRef) -> Column:
    """Whether the key is there at all, be its value null."""
    keys = path_of(ref)
    if keys is None:
        return F.lit(True)
    return F.try_variant_get(F.try_parse_json("canonical_json"), json_path(keys), "variant").isNotNull()


def usable(ref: FieldRef) -> Column:
    """The key is there with a value that is neither null nor empty."""
    text = as_text(ref)
    return F.coalesce(text != "", F.lit(False))


def state(ref: FieldRef) -> Column:
    """absent, present_null, present_empty or present."""
    text = as_text(ref)
    return F.when(text.isNotNull() & (text != ""), "present").when(text.isNotNull(), "present_empty").when(has_key(ref), "present_null").otherwise("absent")


def entity_fields(entities: DataFrame) -> DataFrame:
    """One row per field of the property, quantity and measurement sections, keys with a JSON null kept.

    source_model_id, entity_id, ifc_class, section, set_name, field_name, value, value_kind, measure_type,
    unit_override_key. A set that is no object has no fields.
    """
    view = entities.select(F.col("id").alias("entity_id"), "source_model_id", "ifc_class", F.try_parse_json("canonical_json").alias("v"))
    part = lambda col, path: F.try_variant_get(col, path, "string")
    get = lambda section: F.try_variant_get("v", f"$.{section}", "variant")
    members = lambda c: F.map_entries(F.try_variant_get(c, "$", "map<string,variant>"))
    none = "array<struct<section:string,set_name:string,o:variant>>"
    # One parse and one pass: the sets of both sections and the measurements, which lie in no set, in one array.
    of_sets = lambda section: F.coalesce(F.transform(members(get(section)), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("set_name"), e["value"].alias("o"))), F.array().cast(none))
    flat = F.array(F.struct(F.lit("measurements").alias("section"), F.lit(None).cast("string").alias("set_name"), get("measurements").alias("o")))
    sets = view.select("entity_id", "source_model_id", "ifc_class", F.inline(F.concat(of_sets("property_sets"), of_sets("quantity_sets"), flat)))
    rows = sets.select("entity_id", "source_model_id", "ifc_class", "section", "set_name", F.explode(F.try_variant_get("o", "$", "map<string,variant>")).alias("field_name", "f"))
    value = F.try_variant_get("f", "$.value", "variant")
    return rows.select(
        "source_model_id",
        "entity_id",
        "ifc_class",
        "section",
        "set_name",
        "field_name",
        part(F.col("f"), "$.value").alias("value"),
        F.when(value.isNull(), "absent").otherwise(F.regexp_extract(F.lower(F.schema_of_variant(value)), "^[a-z]+", 0)).alias("value_kind"),
        part(F.col("f"), "$.measure_type").alias("measure_type"),
        part(F.col("f"), "$.unit_override_key").alias("unit_override_key"),
    )


def field_summary(fields: DataFrame) -> DataFrame:
    """Which field is in which set, in how many entities: the lookup table of the resolver."""
    return fields.groupBy("source_model_id", "section", "set_name", "field_name").agg(F.countDistinct("entity_id").alias("n_entities"))


def resolve_dimension(summary: DataFrame, model: int, name: str) -> FieldRef:
    """The one quantity set that has the field; ambiguous or missing ones are plan errors."""
    sets = [r.set_name for r in summary.where((F.col("source_model_id") == model) & (F.col("section") == "quantity_sets") & (F.col("field_name") == name)).select("set_name").distinct().orderBy("set_name").limit(51).collect()]
    if not sets:
        raise PlanError(f"no quantity {name} in model {model}")
    if len(sets) > 1:
        raise AmbiguousField(name, sets)
    return FieldRef(FieldKind.QUANTITY, name, sets[0])


def schema_catalog(fields: DataFrame, per_set: int | None = 500) -> DataFrame:
    """Distinct sets and fields of each model with their counts; at most per_set fields of a set, by name, or all (None)."""
    from pyspark.sql import Window

    g = fields.groupBy("source_model_id", "section", "set_name", "field_name").agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("ifc_class").alias("n_classes"))
    if per_set is None:
        return g
    w = Window.partitionBy("source_model_id", "section", "set_name").orderBy("field_name")
    return g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_set).drop("rn")


def resolve_names(names: DataFrame, summary: DataFrame, model: int) -> DataFrame:
    """item_id, section, set_name, field_name, n_entities, rung and n_matches: every field of a model that a name means.

    names: item_id, name and optionally section and set_name, which narrow the search. A name matches exactly, else
    when letter case and signs are ignored; exact matches leave no others. n_matches above 1 is an ambiguity, which
    the caller decides; nothing is chosen silently.
    """
    fold = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    asked = names.select("item_id", F.col("name").alias("asked"), *(F.col(c).alias(f"a_{c}") if c in names.columns else F.lit(None).cast("string").alias(f"a_{c}") for c in ("section", "set_name")))
    s = summary.where(F.col("source_model_id") == model)
    narrowed = (F.col("a_section").isNull() | (F.col("a_section") == F.col("section"))) & (F.col("a_set_name").isNull() | (F.col("a_set_name") == F.col("set_name")))
    met = asked.withColumn("key", fold(F.col("asked"))).join(s.withColumn("key", fold(F.col("field_name"))), "key").where(narrowed & (F.col("key") != ""))
    from pyspark.sql import Window

    exact = F.col("asked") == F.col("field_name")
    best = F.max(exact).over(Window.partitionBy("item_id"))
    kept = met.withColumn("exact", exact).withColumn("best", best).where("exact or not best")
    return kept.withColumn("n_matches", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).select("item_id", "section", "set_name", "field_name", "n_entities", F.when(F.col("exact"), "exact").otherwise("folded").alias("rung"), "n_matches")


def resolve_field(summary: DataFrame, model: int, ref: FieldRef) -> FieldRef:
    """The field as the model has it; a missing one, or a quantity in several sets without one named, is a plan error."""
    if ref.kind in (FieldKind.ATTRIBUTE, FieldKind.TYPE_FACT):
        path_of(ref)
        return ref
    section = {FieldKind.PROPERTY: "property_sets", FieldKind.QUANTITY: "quantity_sets", FieldKind.MEASUREMENT: "measurements"}[ref.kind]
    if ref.kind is FieldKind.QUANTITY and ref.set_name is None:
        return resolve_dimension(summary, model, ref.name)
    rows = summary.where((F.col("source_model_id") == model) & (F.col("section") == section) & (F.col("field_name") == ref.name) & F.col("set_name").eqNullSafe(ref.set_name))
    if not rows.take(1):
        raise PlanError(f"no {section} field {ref.set_name or ''} {ref.name} in model {model}")
    return ref
