"""Document generation from canonical records, budgets, hashes and incremental re-ingestion."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_CHARS, MAX_TOKENS = 4000, 2000
#: Sentence kinds in order of priority, with their wording. Fixed values.
SENTENCES = (
    ("identity", "This is an {} entity."),
    ("name", "Its name is '{}'."),
    ("global_id", "Its IFC GlobalId is {}."),
    ("predefined_type", "Predefined type: {}."),
    ("object_type", "Object type: {}."),
    ("tag", "Tag: {}."),
    ("long_name", "Long name: {}."),
    ("composition", "Composition type: {}."),
    ("storey", "Located on storey '{}'."),
    ("type_name", "Element type: '{}'."),
    ("material", "Material: '{}'."),
    ("classification", "Classification {} ({}): {}."),
    ("placement_elev", "Storey elevation: {}."),
    ("description", "Description: {}."),
    ("property", "Property '{}' in '{}': {}."),
    ("quantity", "Quantity '{}' in '{}': {}."),
)
#: The order in which the sentences stand in the text.
ORDER = ("identity", "name", "global_id", "predefined_type", "object_type", "tag", "long_name", "composition", "description", "storey", "type_name", "material", "classification", "placement_elev", "property", "quantity")
NO_TYPE = ("NOTDEFINED", "USERDEFINED", "NONE")
_KINDS = [k for k, _ in SENTENCES]
_WORDS = dict(SENTENCES)
_STRUCT = "array<struct<priority:int,place:int,sentence:string>>"
_SIZED = "array<struct<priority:int,place:int,sentence:string,tokens:int>>"


def _composed(text: str | None) -> str | None:
    """The composed form (NFC); a text with escapes is written anew first, so that accents in escapes compose too."""
    if text is None:
        return None
    if "\\u" in text:
        try:
            text = json.dumps(json.loads(text), ensure_ascii=False).encode("utf-8", "replace").decode()
        except (ValueError, RecursionError):
            pass
    return text if text.isascii() else unicodedata.normalize("NFC", text)


@F.arrow_udf(StringType())
def composed_json(texts: pa.Array) -> pa.Array:
    """The composed form (NFC) of JSON texts."""
    return pa.array([_composed(t) for t in texts.to_pylist()], pa.string())


def record_hash(text: Column) -> Column:
    """SHA-256 of a record that does not depend on the order of its keys (a variant keeps them sorted); of the text itself if unreadable."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(text)), text), 256)


def clean(text: Column) -> Column:
    """Control characters and runs of blanks to one blank, outer white space off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"[ \t]+", " "), r"^\s+|\s+\z", "")


def _say(kind: str, *values: Column) -> Column:
    """The sentence of a kind; null if its first value is null."""
    parts = _WORDS[kind].split("{}")
    bits = [F.lit(parts[0])]
    for v, rest in zip(values, parts[1:]):
        bits += [v, F.lit(rest)]
    return F.struct(F.lit(_KINDS.index(kind)).alias("priority"), F.lit(ORDER.index(kind)).alias("place"), clean(F.concat(*bits)).alias("sentence"))


def _one(kind: str, value: Column) -> Column:
    return F.array(_say(kind, F.nullif(value, F.lit(""))))


def _sets(kind: str, column: str) -> Column:
    """Sentences of the fields of all sets, by set and field name; sets that are no objects have none.

    column holds a map of maps, made in a projection of its own so that it is made once a row.
    """

    def of_set(name: Column) -> Column:
        return F.transform(F.array_sort(F.map_keys(F.col(column)[name])), lambda f: _say(kind, f, name, F.nullif(F.trim(F.try_variant_get(F.col(column)[name][f], "$.value", "string")), F.lit(""))))

    named = F.filter(F.coalesce(F.array_sort(F.map_keys(column)), F.array().cast("array<string>")), lambda n: ~n.startswith("_"))
    return F.flatten(F.transform(named, lambda n: F.coalesce(of_set(n), F.array().cast(_STRUCT))))


def _with_sets(df: DataFrame, *sections: str) -> DataFrame:
    for section in sections:
        outer = F.try_variant_get("v", f"$.{section}", "map<string,variant>")
        df = df.withColumn(section, F.transform_values(outer, lambda _, x: F.try_variant_get(x, "$", "map<string,variant>")))
    return df


def entity_sentences(entities: DataFrame) -> DataFrame:
    """id, source_model_id, source_hash and the sentences of each entity in text order, without repeats."""
    g = lambda p: F.try_variant_get("v", p, "string")
    ptype = g("$.meta.predefined_type")
    mats = F.from_json(g("$.materials"), "array<struct<name:string>>")
    cls = F.from_json(g("$.classifications"), "array<struct<system:string,code:string,description:string>>")
    none = F.array().cast(_STRUCT)
    code, system, text = (lambda c: F.coalesce(c["code"], F.lit(""))), (lambda c: F.coalesce(F.nullif(c["system"], F.lit("")), F.lit("unknown"))), (lambda c: F.coalesce(c["description"], F.lit("")))
    parts = [
        _one("identity", F.coalesce(g("$.meta.ifc_class"), F.lit("IfcRoot"))),
        _one("name", g("$.identity.name")),
        _one("global_id", F.coalesce(g("$.meta.global_id"), F.lit(" "))),
        _one("predefined_type", F.when(~F.upper(ptype).isin(list(NO_TYPE)), ptype)),
        _one("object_type", g("$.identity.object_type")),
        _one("tag", g("$.identity.tag")),
        _one("long_name", g("$.identity.long_name")),
        _one("composition", g("$.identity.composition_type")),
        _one("description", g("$.identity.description")),
        _one("storey", g("$.storey.name")),
        _one("type_name", g("$.type.name")),
        F.coalesce(F.transform(mats, lambda m: _say("material", F.nullif(m["name"], F.lit("")))), none),
        F.coalesce(F.transform(F.filter(cls, lambda c: (code(c) != "") | (text(c) != "")), lambda c: _say("classification", code(c), system(c), text(c))), none),
        _one("placement_elev", g("$.placement.elevation")),
        _sets("property", "property_sets"),
        _sets("quantity", "quantity_sets"),
    ]
    said = F.filter(F.concat(*parts), lambda s: s["sentence"].isNotNull() & (s["sentence"] != ""))
    # Places run through the whole text, so that the order can be restored after the budget.
    numbered = F.transform("said", lambda s, i: F.struct(s["priority"].alias("priority"), i.alias("place"), s["sentence"].alias("sentence")))
    first = F.filter("numbered", lambda s: F.array_position("texts", s["sentence"]) == s["place"] + 1)
    base = entities.select("id", "source_model_id", record_hash(F.col("canonical_json")).alias("source_hash"), F.try_parse_json(composed_json("canonical_json")).alias("v")).where("v is not null")
    made = _with_sets(base, "property_sets", "quantity_sets").withColumn("said", said).withColumn("numbered", numbered).withColumn("texts", F.transform("said", lambda x: x["sentence"]))
    return made.withColumn("sentences", first).select("id", "source_model_id", "source_hash", "sentences")


def within_budget(sentences: Column, size, budget: int) -> Column:
    """Sized sentences kept in order of priority while they fit; one that doesn't is skipped, later ones may still fit."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast(_SIZED).alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        need = size(s)
        fits = acc["used"] + need <= budget
        return F.when(fits, F.struct((acc["used"] + need).alias("used"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)

    return F.aggregate(F.array_sort(sentences), start, step)["kept"]


def surrogate_tokens(text: Column) -> Column:
    """Words and signs: stands for a tokenizer where none is given."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def render(docs: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """document_text, text_truncated, original and encoded token counts and text_hash of sentence arrays.

    The tokens of each sentence are counted once, in a projection of their own.
    """
    sized = F.transform("sentences", lambda s: F.struct(s["priority"].alias("priority"), s["place"].alias("place"), s["sentence"].alias("sentence"), surrogate_tokens(s["sentence"]).alias("tokens")))
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + s["tokens"])
    d = docs.withColumn("sized", sized)
    d = d.withColumn("by_chars", within_budget(F.col("sized"), lambda s: F.char_length(s["sentence"]) + 1, max_chars))
    d = d.withColumn("kept", within_budget(F.col("by_chars"), lambda s: s["tokens"], max_tokens))
    ordered = F.array_sort("kept", lambda a, b: a["place"] - b["place"])
    text = d.select(
        *[c for c in docs.columns if c != "sentences"],
        F.concat_ws(" ", F.transform(ordered, lambda s: s["sentence"])).alias("document_text"),
        (F.size("kept") < F.size("sentences")).alias("text_truncated"),
        count(F.col("sized")).alias("original_token_count"),
        count(F.col("kept")).alias("encoded_token_count"),
    )
    return text.withColumn("text_hash", F.sha2("document_text", 256))


def entity_documents(entities: DataFrame) -> DataFrame:
    return render(entity_sentences(entities))


def relationship_documents(relationships: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Texts of relationships: identity, scalars by name, single ends, then listed ends, without repeats.

    With members, the resolved entity of an end (by role and place, null for a single end; the largest of repeated
    rows) is named too.
    """
    g = lambda p: F.try_variant_get("v", p, "string")
    say = lambda p, s: F.struct(F.lit(p).alias("priority"), F.lit(p).alias("place"), clean(s).alias("sentence"))
    filled = lambda c: F.nullif(c, F.lit(""))
    part = lambda label, c: F.concat(F.lit(label), c)

    def end(e: Column, key: Column) -> Column:
        get = lambda k: F.try_variant_get(e, f"$.{k}", "string")
        entity = F.try_element_at("known", key).cast("string")
        inner = F.concat_ws(", ", part("STEP: ", get("step_id")), part("GlobalId: ", filled(get("global_id"))), F.concat(F.lit("Name: '"), filled(get("name")), F.lit("'")), part("Entity ID: ", entity))
        return F.concat(F.coalesce(get("ifc_class"), F.lit("")), F.when(inner != "", F.concat(F.lit(" ("), inner, F.lit(")"))).otherwise(""))

    base = relationships.select(
        "id", "source_model_id", record_hash(F.col("canonical_json")).alias("source_hash"), F.try_parse_json(composed_json("canonical_json")).alias("v")
    ).where("v is not null")
    if members is None:
        base = base.withColumn("known", F.create_map().cast("map<string,long>"))
    else:
        place = F.concat("role", F.lit("|"), F.coalesce(F.col("member_order").cast("string"), F.lit("")))
        one = members.where("role is not null and entity_id is not null").groupBy(F.col("relationship_id").alias("m_rel"), place.alias("at")).agg(F.max("entity_id").alias("entity"))
        known = one.groupBy("m_rel").agg(F.map_from_entries(F.collect_list(F.struct("at", "entity"))).alias("known"))
        base = base.join(known, F.col("id") == F.col("m_rel"), "left").drop("m_rel")
    base = base.withColumn("scalars", F.try_variant_get("v", "$.scalars", "map<string,variant>")).withColumn("ends", F.try_variant_get("v", "$.endpoints", "map<string,variant>"))
    none = F.array().cast(_STRUCT)
    names = lambda m: F.coalesce(F.array_sort(F.map_keys(m)), F.array().cast("array<string>"))
    shape = lambda k, kind: F.schema_of_variant(F.col("ends")[k]).startswith(kind)
    scalar = lambda k: say(4, F.concat(k, F.lit(": "), F.try_variant_get(F.col("scalars")[k], "$", "string"), F.lit(".")))
    single = lambda k: say(5, F.concat(k, F.lit(": "), end(F.col("ends")[k], F.concat(k, F.lit("|"))), F.lit(".")))
    one_of = lambda k: lambda e, i: say(6, F.concat(k, F.lit("["), i, F.lit("]: "), end(e, F.concat(k, F.lit("|"), i)), F.lit(".")))
    listed = lambda k: F.coalesce(F.transform(F.try_variant_get(F.col("ends")[k], "$", "array<variant>"), one_of(k)), none)
    parts = F.concat(
        F.array(say(0, F.concat(F.lit("This is an "), F.coalesce(g("$.meta.ifc_class"), F.lit("IfcRelationship")), F.lit(" relationship.")))),
        F.array(say(1, F.concat(F.lit("Its GlobalId is "), F.coalesce(g("$.meta.global_id"), F.lit("")), F.lit(".")))),
        F.array(say(2, F.concat(F.lit("Its name is '"), filled(g("$.identity.name")), F.lit("'.")))),
        F.array(say(3, F.concat(F.lit("Description: "), filled(g("$.identity.description")), F.lit(".")))),
        F.transform(F.filter(names("scalars"), lambda k: k != "OwnerHistory_step_id"), scalar),
        F.transform(F.filter(names("ends"), lambda k: shape(k, "OBJECT")), single),
        F.flatten(F.transform(F.filter(names("ends"), lambda k: shape(k, "ARRAY")), listed)),
    )
    d = base.withColumn("parts", parts).withColumn("said", F.filter("parts", lambda s: s["sentence"].isNotNull() & (s["sentence"] != "")))
    d = d.withColumn("texts", F.transform("said", lambda s: s["sentence"]))
    d = d.withColumn("numbered", F.transform("said", lambda s, i: F.struct(s["priority"].alias("priority"), i.alias("place"), s["sentence"].alias("sentence"))))
    d = d.withColumn("sentences", F.filter("numbered", lambda s: F.array_position("texts", s["sentence"]) == s["place"] + 1))
    return render(d.select("id", "source_model_id", "source_hash", "sentences"))


def classify_changes(prior: DataFrame, now: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """new, changed, unchanged or removed for each key; nulls compare as values."""
    p = prior.select(*(F.col(k).alias(f"p_{k}") for k in keys), *(F.col(c).alias(f"p_{c}") for c in compare), F.lit(True).alias("was"))
    n = now.select(*keys, *compare, F.lit(True).alias("is"))
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in keys]
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return n.join(p, on, "full").select(*(F.coalesce(k, f"p_{k}").alias(k) for k in keys), state.alias("state"))


def to_embed(prior: DataFrame, now: DataFrame, dim: int, keys: list[str]) -> DataFrame:
    """Documents that need a vector: without a prior one of the same hashes and dimension."""
    valid = prior.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).select(*keys, "source_hash", "text_hash").distinct()
    return now.join(valid, [*keys, "source_hash", "text_hash"], "left_anti")


def embed(docs: DataFrame, encoder, dim: int, text_col: str = "document_text") -> DataFrame:
    """embedding of each text by an injected encoder (texts to a matrix), normalised; a bad vector fails the job."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        x = np.asarray(encoder(texts.fillna("").tolist()), dtype=np.float64)
        if x.shape != (len(texts), dim) or not np.isfinite(x).all():
            raise ValueError("the encoder gave vectors of another shape or not finite")
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return pd.Series(list((x / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return docs.withColumn("embedding", vectors(F.col(text_col)))


def hash_encoder(dim: int):
    """A deterministic encoder for tests: hashed words, no model."""
    import zlib

    def encode(texts: list[str]):
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 1 << 20 else -1
        return out

    return encode
