"""Candidates for the words of a question: classes, fields and values ranked by shared words, and class closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.lexical import identifier_words

PER_ITEM, TOTAL = 6, 40


def concepts(entities: DataFrame, fields: DataFrame) -> DataFrame:
    """All that a question can mean: kind, name, how often, and its words."""
    cls = entities.groupBy(F.col("ifc_class").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("name is not null").withColumn("kind", F.lit("class"))
    fld = fields.groupBy(F.concat_ws(".", "section", "set_name", "field_name").alias("name"), F.col("field_name").alias("label")).agg(F.countDistinct("entity_id").alias("n")).withColumn("kind", F.lit("field"))
    both = cls.withColumn("label", F.col("name")).unionByName(fld)
    return both.select("kind", "name", "label", "n", identifier_words(F.col("label")).alias("words"))


def _singular(word: Column) -> Column:
    return F.when(word.rlike(".{3,}ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike(".{2,}[^su]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def scored(items: DataFrame, found: DataFrame) -> DataFrame:
    """item_id, kind, name, n and score of each item (item_id, text) and concept that share a word: 10 and the number of words if all words agree, 6 if the item's
    words are all in the concept, else 3 and the share of them; without a shared word there is no candidate.

    Items meet concepts by their words, never each with each.
    """
    iw = items.select("item_id", F.array_distinct(F.transform(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), _singular)).alias("iw"))
    cw = found.select("kind", "name", "n", F.array_distinct(F.transform("words", _singular)).alias("cw"))
    shared = iw.select("item_id", F.size("iw").alias("ni"), F.explode("iw").alias("word")).join(cw.select("kind", "name", "n", F.size("cw").alias("nc"), F.explode("cw").alias("word")), "word")
    g = shared.groupBy("item_id", "kind", "name", "n", "ni", "nc").agg(F.count(F.lit(1)).alias("hits"))
    points = F.when((F.col("hits") == F.col("ni")) & (F.col("hits") == F.col("nc")), 10.0 + F.col("hits")).when(F.col("hits") == F.col("ni"), 6.0).otherwise(3.0 + F.col("hits") / F.col("ni"))
    return g.select("item_id", "kind", "name", "n", points.alias("score"))


def score(items: DataFrame, found: DataFrame, per_item: int = PER_ITEM, total: int = TOTAL) -> DataFrame:
    """The best concepts of each item, at most per_item each and total in all."""
    ranked = scored(items, found).withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.desc("n"), "kind", "name")))
    return ranked.where(F.col("nth") <= per_item).orderBy("nth", F.desc("score"), "item_id").limit(total).select("item_id", "kind", "name", "n", "score", "nth")


def occurrence_of_type(cls: Column) -> Column:
    """The class of the objects that a type or style class types: IfcDoorStyle and IfcDoorType give IfcDoor."""
    return F.when(cls.rlike("(?i).(Type|Style)$"), F.regexp_replace(cls, "(?i)(Type|Style)$", "")).otherwise(cls)


def closure(ontology: DataFrame, present: DataFrame, asked: list[str]) -> DataFrame:
    """Asked classes and their descendants of the same role that the model has; absent when it has none.

    ontology: class, ancestors (array), role; present: ifc_class, n.
    """
    ask = ontology.where(F.col("class").isin(asked)).select(F.col("class").alias("asked"), F.col("role").alias("asked_role"))
    below = ontology.select("class", "role", F.explode(F.concat(F.array("class"), F.coalesce("ancestors", F.array().cast("array<string>")))).alias("asked"))
    members = below.join(ask, "asked").where(F.col("role").eqNullSafe(F.col("asked_role")))
    joined = members.join(present, F.col("class") == F.col("ifc_class"), "left")
    return joined.groupBy("asked").agg(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("class")))).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum("n"), F.lit(0)) == 0).alias("absent"))


def order_subjects(rows: DataFrame) -> DataFrame:
    """Subjects by kind of result, specificity, presence and count."""
    return rows.orderBy("result_kind", F.desc("specificity"), F.desc(F.col("n") > 0), F.desc("n"), "ifc_class")


#: Candidates of each kind that a slate offers.
SLATE = {"class": 12, "field": 12, "value": 8, "floor": 4, "relationship": 4}


def slate_concepts(entities: DataFrame, fields: DataFrame, facts: DataFrame, bands: DataFrame, relationships: DataFrame) -> DataFrame:
    """All that a slate can offer of one model: classes, fields, values, floors and relationship classes, with their words.

    facts: rows of ``profile.value_facts``; bands: rows of ``spatial.band_summary``.
    """
    of = lambda kind, df, name, label: df.select(F.lit(kind).alias("kind"), name.alias("name"), F.col("n").cast("long").alias("n"), identifier_words(label).alias("words"))
    values = of("value", facts, F.concat_ws("=", "field_name", "value"), F.col("value"))
    floors = of("floor", bands.withColumnRenamed("n_storeys", "n"), F.col("label"), F.col("label"))
    rels = relationships.where("ifc_class is not null").groupBy("ifc_class").agg(F.count(F.lit(1)).alias("n"))
    return concepts(entities, fields).select("kind", "name", "n", "words").unionByName(values).unionByName(floors).unionByName(of("relationship", rels, F.col("ifc_class"), F.regexp_replace("ifc_class", "^IfcRel", "")))


def slate(items: DataFrame, found: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """candidate_id, kind, name, n, score and items: what a question's items may mean, the best of each kind.

    A concept that several items share counts once, with its best score. Candidates are numbered within their kind.
    """
    caps = caps or SLATE
    g = scored(items, found).groupBy("kind", "name").agg(F.max("n").alias("n"), F.max("score").alias("score"), F.array_sort(F.collect_set("item_id")).alias("items"))
    ranked = g.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("n"), "name")))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    kept = ranked.where(F.col("nth") <= F.coalesce(cap[F.col("kind")], F.lit(0)))
    return kept.select(F.concat(F.upper(F.substring("kind", 1, 1)), "nth").alias("candidate_id"), "kind", "name", "n", F.round("score", 4).alias("score"), F.array_join("items", ",").alias("items"))
