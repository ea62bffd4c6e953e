"""Levels from elevations: storeys clustered into bands by the gaps between them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 0.3
REFERENCE = 0.01
STOREY_CLASS = "ifcbuildingstorey"


def storeys(entities: DataFrame) -> DataFrame:
    """Storeys with an elevation, else the local height; those without a number are left out."""
    num = lambda p: F.get_json_object("canonical_json", p).try_cast("double")
    z = F.coalesce(num("$.placement.elevation"), num("$.placement.local_z"))
    return (
        entities.where(F.lower("ifc_class") == STOREY_CLASS)
        .select("source_model_id", "id", "global_id", F.get_json_object("canonical_json", "$.identity.name").alias("name"), z.alias("elevation"))
        .where("source_model_id is not null and elevation is not null and not isnan(elevation)")
    )


def bands(levels: DataFrame) -> DataFrame:
    """The band of each storey, from 0 upwards: a gap over 0.3 of the model's largest starts a new one.

    Gaps within rounding (1e-9 of the model's extent) are none. The method has no scale: metres and millimetres
    give the same bands.
    """
    order = Window.partitionBy("source_model_id").orderBy("elevation", "global_id")
    whole = Window.partitionBy("source_model_id")
    span = F.max("elevation").over(whole) - F.min("elevation").over(whole)
    g = levels.withColumn("gap", F.col("elevation") - F.lag("elevation").over(order)).withColumn("eps", F.greatest(span, F.lit(1.0)) * 1e-9)
    g = g.withColumn("largest", F.max(F.when(F.col("gap") > F.col("eps"), F.col("gap"))).over(whole))
    starts = F.coalesce((F.col("gap") > GAP * F.col("largest")).cast("int"), F.lit(0))
    return g.withColumn("starts", starts).withColumn("band", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("gap", "largest", "eps", "starts")


def band_summary(banded: DataFrame) -> DataFrame:
    """Bands with their range, reference (the first around 0 within 1 % of the span, else the lowest) and label."""
    b = banded.groupBy("source_model_id", "band").agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"), F.count(F.lit(1)).alias("n_storeys"))
    w = Window.partitionBy("source_model_id")
    slack = (F.max("high").over(w) - F.min("low").over(w)) * REFERENCE
    near = F.when((F.col("low") - slack <= 0) & (F.col("high") + slack >= 0), F.col("band"))
    ref = b.withColumn("reference", F.coalesce(F.min(near).over(w), F.min("band").over(w)))
    step = F.col("band") - F.col("reference")
    label = F.when(step >= 0, F.concat(F.lit("Floor "), step + 1)).otherwise(F.concat(F.lit("Lower level "), -step))
    return ref.withColumn("label", label)


def cut_ranges(summary: DataFrame, cut: float = 1.2) -> DataFrame:
    """Heights of a plan view of each band: cut over its base but under the next one, down to half way to the one below."""
    w = Window.partitionBy("source_model_id").orderBy("band")
    above, below = F.lead("low").over(w), F.lag("high").over(w)
    top = F.when(above.isNull(), F.col("low") + cut).otherwise(F.least(F.col("low") + cut, above))
    return summary.withColumn("plan_top", top).withColumn("plan_bottom", F.when(below.isNull(), F.col("low")).otherwise((below + F.col("low")) / 2))


#: Words for levels. Fixed values.
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10}
TOP, BOTTOM = {"top", "highest", "uppermost", "last"}, {"bottom", "lowest", "lowermost"}
GROUND = {"ground"}


def resolve_floor(words: str) -> tuple[str, int | None] | None:
    """('top' | 'bottom' | 'ground', None) or ('ordinal', n) that a phrase names; None if it names no level."""
    tokens = re.findall(r"[a-z]+|\d+(?:st|nd|rd|th)?", words.lower())
    for i, t in enumerate(tokens):
        if t in TOP:
            return "top", None
        if t in BOTTOM:
            return "bottom", None
        if t in GROUND:
            return "ground", None
        if t in ORDINALS:
            return "ordinal", ORDINALS[t]
        if m := re.fullmatch(r"(\d+)(?:st|nd|rd|th)", t):
            return "ordinal", int(m[1])
        if t in ("floor", "level", "storey", "story") and i + 1 < len(tokens) and tokens[i + 1].isdigit():
            return "ordinal", int(tokens[i + 1])
    return None


def floor_bands(summary: DataFrame, concept: tuple[str, int | None]) -> DataFrame:
    """The band of each model that a resolved phrase means."""
    w = Window.partitionBy("source_model_id")
    kind, n = concept
    want = {"top": F.max("band").over(w), "bottom": F.min("band").over(w), "ground": F.col("reference"), "ordinal": F.col("reference") + F.lit((n or 1) - 1)}[kind]
    return summary.withColumn("want", want).where("band = want").drop("want")
