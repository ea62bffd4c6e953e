"""What a model can be asked: attributes, levels, missing capabilities, concepts and vocabulary of every model at once.

Each operator makes rows keyed by source_model_id, so one run profiles all models; a document is the rows of a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.model import FieldKind, FieldRef
from trellisq.operators import fields as FL
from trellisq.operators import profile as P

#: Attributes of the object level. Fixed values.
ATTRIBUTES = ("name", "description", "object_type", "tag", "long_name", "composition_type", "predefined_type", "type_name", "type_predefined_type", "storey_name")
COVERAGES = ("populated", "partial", "absent", "extraction_failure")
UNIT_STATES = ("uniform", "mixed", "unknown", "none")
SECTIONS = ("object_level", "container_level", "relationship_level", "global_level")
IDENTITY = ("source_model_id", "file_fingerprint", "version", "content_hash")
VALUES = 20
FACTS = 1500


def is_artifact(text: Column) -> Column:
    """Values that only identify: blanks, 22-sign ids and step references. Numbers and long texts are values."""
    plain = F.trim(text)
    return text.isNull() | (plain == "") | plain.rlike(r"^[0-9A-Za-z_$]{22}\z") | plain.rlike(r"^#\d+\z")


def coverage(filled: Column, total: Column) -> Column:
    return F.when(filled == 0, "absent").when(filled >= total, "populated").otherwise("partial")


def _attribute(name: str) -> Column:
    kind = FieldKind.TYPE_FACT if name in FL.TYPE_PATHS else FieldKind.ATTRIBUTE
    return FL.as_text(FieldRef(kind, name))


def object_level(entities: DataFrame) -> DataFrame:
    """source_model_id, ifc_class, attribute, n_total, n_filled, n_values and coverage of the fixed attributes.

    One pass: the attributes are unpivoted from one parse of each record.
    """
    parsed = entities.withColumn("v", F.try_parse_json("canonical_json"))
    get = lambda a: F.try_variant_get("v", "$." + ".".join((FL.PATHS | FL.TYPE_PATHS)[a]), "string")
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), get(a).alias("value")) for a in ATTRIBUTES))
    rows = parsed.select("source_model_id", "ifc_class", F.explode(pairs).alias("p")).select("source_model_id", "ifc_class", "p.attribute", F.when(~is_artifact(F.col("p.value")), F.trim("p.value")).alias("value"))
    # Values are counted first, so that a class of very many rows is not held by a distinct count.
    few = rows.groupBy("source_model_id", "ifc_class", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    g = few.groupBy("source_model_id", "ifc_class", "attribute").agg(F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_filled"), F.count("value").alias("n_values"))
    return g.withColumn("coverage", coverage(F.col("n_filled"), F.col("n_total")))


def storey_rows(entities: DataFrame) -> DataFrame:
    """Storeys of each model by elevation, those without one last, then by name and id."""
    v = entities.where("ifc_class = 'IfcBuildingStorey'")
    z = F.get_json_object("canonical_json", "$.placement.elevation").try_cast("double")
    rows = v.select("source_model_id", "global_id", F.get_json_object("canonical_json", "$.identity.name").alias("name"), z.alias("elevation"))
    return rows.orderBy("source_model_id", F.col("elevation").asc_nulls_last(), F.col("name").asc_nulls_last(), "global_id")


def global_level(entities: DataFrame) -> DataFrame:
    """source_model_id, n_entities, n_classes, n_storeys, n_in_storey and the coverage of containment."""
    placed = FL.as_text(FieldRef(FieldKind.ATTRIBUTE, "storey_global_id")).isNotNull()
    by_class = entities.groupBy("source_model_id", "ifc_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(placed).alias("n_in"))
    g = by_class.groupBy("source_model_id").agg(
        F.sum("n").alias("n_entities"), F.count("ifc_class").alias("n_classes"), F.coalesce(F.sum(F.when(F.col("ifc_class") == "IfcBuildingStorey", F.col("n"))), F.lit(0)).alias("n_storeys"), F.sum("n_in").alias("n_in_storey")
    )
    return g.withColumn("containment", coverage(F.col("n_in_storey"), F.col("n_entities")))


def measured_fields(facts: DataFrame) -> DataFrame:
    """Distinct measured fields of each model (rows of ``profile.measure_facts``)."""
    return facts.where("n_typed > 0").select("source_model_id", "section", "set_name", "field_name").distinct().groupBy("source_model_id").agg(F.count(F.lit(1)).alias("n_measured"))


def container_shapes(fields: DataFrame) -> DataFrame:
    """``profile.container_shapes`` of each model by itself."""
    g = fields.where("set_name is not null").groupBy("source_model_id", "section", "set_name").agg(F.countDistinct("field_name").alias("n_fields"), F.countDistinct("entity_id").alias("n_entities"), F.count(F.lit(1)).alias("n_instances"))
    ratio = F.col("n_fields") / (F.col("n_instances") / F.col("n_entities"))
    return g.withColumn("reliable", ~((F.col("n_fields") >= P.MIN_FIELDS) & (ratio >= P.SCHEMA_RATIO)))


def missing_capabilities(models: DataFrame, shapes: DataFrame, facts: DataFrame, defaults: DataFrame, symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """source_model_id, capability, scope and reason of what a model can't be asked.

    Unreliable containers, failed extractions, sections without a reliable container, no measured field, and default
    units that don't resolve.
    """
    capability = lambda c: F.concat(F.regexp_replace(c, "_sets$", ""), F.lit("_queries"))
    out = shapes.where("not reliable").select("source_model_id", capability(F.col("section")).alias("capability"), F.col("set_name").alias("scope"), F.lit("its fields share no schema").alias("reason"))
    warned = entities.select("source_model_id", F.explode(F.from_json("extraction_warnings", "array<string>")).alias("w")).withColumn("w", F.lower("w"))
    failed = warned.select("source_model_id", F.regexp_extract("w", "(propert|quantit)", 1).alias("k")).where("k <> ''").distinct()
    out = out.unionByName(failed.select("source_model_id", F.when(F.col("k") == "propert", "property_queries").otherwise("quantity_queries").alias("capability"), F.lit(None).cast("string").alias("scope"), F.lit("extraction failed").alias("reason")))
    all_models = models.select(F.col("id").alias("source_model_id")).where("source_model_id is not null")
    for section in ("property_sets", "quantity_sets"):
        good = shapes.where((F.col("section") == section) & F.col("reliable")).select("source_model_id").distinct()
        none = all_models.join(good, "source_model_id", "left_anti")
        out = out.unionByName(none.select("source_model_id", F.lit(section.removesuffix("_sets") + "_queries").alias("capability"), F.lit(None).cast("string").alias("scope"), F.lit("no reliable container").alias("reason")))
    without = all_models.join(measured_fields(facts), "source_model_id", "left_anti")
    out = out.unionByName(without.select("source_model_id", F.lit("dimensional_queries").alias("capability"), F.lit(None).cast("string").alias("scope"), F.lit("no measured field").alias("reason")))
    open_units = defaults.join(symbols.where("symbol is not null").select("source_model_id", "unit_key"), ["source_model_id", "unit_key"], "left_anti")
    return out.unionByName(open_units.select("source_model_id", F.lit("dimensional_queries").alias("capability"), F.col("measure_type").alias("scope"), F.lit("default unit not resolved").alias("reason")))


def problems_of(document: dict, version: int, digest: Callable[[dict], str]) -> list[str]:
    """What is wrong with a profile document (identity, content) before it is put in place."""
    identity, content = document.get("identity"), document.get("content")
    if not isinstance(identity, dict) or not isinstance(content, dict):
        return ["no identity or no content"]
    out = [f"identity.{f} is missing" for f in IDENTITY if identity.get(f) in (None, "")]
    if identity.get("version") != version:
        out.append(f"version {identity.get('version')!r} instead of {version}")
    if identity.get("content_hash") != digest(content):
        out.append("content_hash is not that of the content")
    out += [f"content.{s} is missing" for s in SECTIONS if s not in content]
    ids: set[str] = set()
    stack: list[tuple[str, object]] = [("content", content)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            if value.get("unit_state") == "uniform" and not value.get("symbol"):
                out.append(f"{path} is uniform in no unit")
            for key, x in value.items():
                if key == "coverage" and x not in COVERAGES:
                    out.append(f"{path}.coverage is {x!r}")
                elif key == "unit_state" and x not in UNIT_STATES:
                    out.append(f"{path}.unit_state is {x!r}")
                elif key == "id" and isinstance(x, str):
                    if x in ids:
                        out.append(f"id {x} repeats")
                    ids.add(x)
                stack.append((f"{path}.{key}", x))
        elif isinstance(value, list):
            stack += [(f"{path}[{i}]", x) for i, x in enumerate(value)]
    return sorted(out)


def concepts(objects: DataFrame, coverage_rows: DataFrame, facts: DataFrame) -> DataFrame:
    """source_model_id, concept, kind, label, ifc_class, n_filled, n_total and unit_state: all levels in one flat table.

    objects: rows of ``object_level``; coverage_rows: fields of each class and model with n_filled and n_total; facts:
    rows of ``profile.measure_facts``. Fields without any value are no concept.
    """
    attributes = objects.where("n_filled > 0").select(
        "source_model_id", F.concat_ws(":", F.lit("attribute"), "ifc_class", "attribute").alias("concept"), F.lit("attribute").alias("kind"), F.col("attribute").alias("label"), "ifc_class", "n_filled", "n_total", F.lit("none").alias("unit_state")
    )
    units = facts.select("source_model_id", "section", F.coalesce("set_name", F.lit("")).alias("set_key"), "field_name", "unit_state")
    rows = coverage_rows.where("n_filled > 0").withColumn("set_key", F.coalesce("set_name", F.lit("")))
    of_sets = rows.join(units, ["source_model_id", "section", "set_key", "field_name"], "left").select(
        "source_model_id", F.concat_ws(":", "section", "ifc_class", F.nullif("set_key", F.lit("")), "field_name").alias("concept"), F.regexp_replace("section", "_sets$", "").alias("kind"), F.col("field_name").alias("label"),
        "ifc_class", "n_filled", "n_total", F.coalesce("unit_state", F.lit("none")).alias("unit_state"),
    )
    return attributes.unionByName(of_sets)


def field_coverage(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """How many entities of a class of a model state each field."""
    total = entities.groupBy("source_model_id", "ifc_class").agg(F.count(F.lit(1)).alias("n_total"))
    filled = F.when(F.col("value").isNotNull() & (F.col("value") != ""), F.col("entity_id"))
    got = fields.groupBy("source_model_id", "ifc_class", "section", "set_name", "field_name").agg(F.countDistinct(filled).alias("n_filled"))
    return got.join(total, ["source_model_id", "ifc_class"])


def merged_coverage(coverage_rows: DataFrame) -> DataFrame:
    """Coverage and quantities of a field over all classes that have it: sums of the rows of the classes."""
    g = coverage_rows.groupBy("source_model_id", "section", "set_name", "field_name").agg(F.sum("n_filled").alias("n_filled"), F.sum("n_total").alias("n_total"), F.count(F.lit(1)).alias("n_classes"))
    return g.withColumn("coverage", coverage(F.col("n_filled"), F.col("n_total")))


def merged_labels(counts: DataFrame, label: Column) -> DataFrame:
    """A histogram (ifc_class, n) by label: classes of one label are added up and empty ones left out."""
    return counts.groupBy(label.alias("label")).agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "label")


def vocabulary(entities: DataFrame, k: int = VALUES) -> DataFrame:
    """source_model_id, ifc_class, kind, value, n and nth: the k commonest values of each kind of each class of every model.

    Kinds: predefined_type, object_type, type_name, storey_name, name_stem, material, classification and the names of
    property and quantity sets. One parse of each record; values are counted before they are ranked.
    """
    v = entities.withColumn("v", F.try_parse_json("canonical_json"))
    g = lambda p: F.try_variant_get("v", p, "string")
    one = lambda kind, value: F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    many = lambda kind, values: F.coalesce(F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))), F.array().cast("array<struct<kind:string,value:string>>"))
    mats = F.from_json(g("$.materials"), "array<struct<name:string>>")["name"]
    codes = F.from_json(g("$.classifications"), "array<struct<code:string>>")["code"]
    sets = lambda s: F.map_keys(F.try_variant_get("v", f"$.{s}", "map<string,variant>"))
    said = F.concat(
        one("predefined_type", g("$.meta.predefined_type")), one("object_type", g("$.identity.object_type")), one("type_name", g("$.type.name")), one("storey_name", g("$.storey.name")), one("name_stem", P.name_stem(g("$.identity.name"))),
        many("material", F.array_distinct(mats)), many("classification", F.array_distinct(codes)), many("property_set", sets("property_sets")), many("quantity_set", sets("quantity_sets")),
    )
    rows = v.select("source_model_id", "ifc_class", F.explode(said).alias("s")).select("source_model_id", "ifc_class", "s.kind", "s.value").where(~P.is_noise(F.col("value")))
    return P.top_per(rows, ["source_model_id", "ifc_class", "kind"], "value", k)


def profile_texts(words: DataFrame, counts: DataFrame, per_kind: int = 5) -> DataFrame:
    """source_model_id, ifc_class and text: a class in one paragraph, from the rows of ``vocabulary`` and class counts."""
    top = words.where(F.col("nth") <= per_kind).groupBy("source_model_id", "ifc_class", "kind").agg(F.array_sort(F.collect_list(F.struct("nth", "value")))["value"].alias("values"))
    lines = top.groupBy("source_model_id", "ifc_class").agg(F.array_sort(F.collect_list(F.concat(F.regexp_replace("kind", "_", " "), F.lit(": "), F.array_join("values", ", ")))).alias("lines"))
    c = counts.select("source_model_id", "ifc_class", "n")
    head = F.concat("ifc_class", F.lit(": "), "n", F.lit(" objects"))
    return c.join(lines, ["source_model_id", "ifc_class"], "left").select("source_model_id", "ifc_class", F.concat_ws(". ", head, F.array_join("lines", ". ")).alias("text"))


def excerpt(text: Column, limit: int = 400) -> Column:
    """A text cut at a blank before the limit, with a sign that it was cut."""
    head = F.substring(text, 1, limit - 1)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit("…")))


def ontology(classes: DataFrame) -> DataFrame:
    """class, ancestors, role, words and text of every class of a table (class, parent, description).

    Ancestors come nearest first. The inheritance of a schema is a table of a few thousand rows of small depth, so it
    is walked by joins, one a generation. role: relationship, type, spatial or product, by the nearest ancestor that
    tells.
    """
    from trellisq.functions.lexical import identifier_words

    base = classes.where("class is not null").groupBy("class").agg(F.min("parent").alias("parent"), F.min("description").alias("description"))
    up = base.select(F.col("class").alias("c"), F.col("parent").alias("p"))
    rows = base.withColumn("ancestors", F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))).withColumn("top", F.col("parent"))
    for _ in range(16):
        rows = rows.join(up, F.col("top") == F.col("c"), "left")
        fresh = F.col("p").isNotNull() & ~F.coalesce(F.array_contains("ancestors", F.col("p")), F.lit(False)) & (F.col("p") != F.col("class"))
        rows = rows.select("class", "parent", "description", F.when(fresh, F.concat("ancestors", F.array("p"))).otherwise(F.col("ancestors")).alias("ancestors"), F.when(fresh, F.col("p")).alias("top"))
    line = F.concat(F.array("class"), "ancestors")
    has = lambda *names: F.exists(line, lambda x: F.lower(x).isin([n.lower() for n in names]))
    role = F.when(has("IfcRelationship"), "relationship").when(has("IfcTypeObject"), "type").when(has("IfcSpatialElement", "IfcSpatialStructureElement"), "spatial").when(has("IfcProduct"), "product")
    text = F.concat_ws(". ", F.array_join(identifier_words(F.col("class")), " "), "description")
    return rows.select("class", "ancestors", role.alias("role"), identifier_words(F.col("class")).alias("words"), text.alias("text"))


class Cache:
    """Frames held under a fingerprint and versions; another fingerprint of the same name takes the place of the old one."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[tuple, DataFrame]] = {}

    def get(self, name: str, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        old = self.held.get(name)
        if old and old[0] == key:
            return old[1]
        if old:
            old[1].unpersist()
        made = make().persist()
        self.held[name] = (key, made)
        return made
