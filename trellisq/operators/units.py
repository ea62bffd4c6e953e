"""Quantities recorded in different units (problem 1).

Every statement of a length, area or volume is read once; its unit is the one in its own text, else the one
of its override key, else the model's default for its measure type. What is left has no known unit. For it a
calibrated tree ensemble predicts the unit from magnitude, source, category and neighbouring fields: a random
forest fitted on a bounded sample of labelled statements, its confidence made a probability by isotonic
regression on held-out statements. Confident predictions are converted; the others are routed for review.

Defined results: null or unreadable JSON has no statements, nor has a row without id; a statement without a finite number has a null
value and counts for no comparison; a unit without usable definition is no unit; repeated statements each
give a row. What has no unit and no number above zero, or no dimension, is for review. Extra columns are never
read. All units that the sample of labelled statements holds are classes of the ensemble.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.functions.measures import model_units, plain_number, written_quantity
from trellisq.operators import forest
from trellisq.operators.shred import _inner, _load
from trellisq.runtime import Scratch

SECTIONS = ("quantity_sets", "measurements", "property_sets")
#: Labelled statements to fit the classifier on, at most; the same number again calibrates it.
FIT_ROWS = 20_000
#: Calibrated probability from which a predicted unit is applied.
CONFIDENT = 0.9
STATEMENT = "entity_id long, source_model_id int, ifc_class string, section string, set_name string, quantity_name string, raw double, own_dim string, own_value double, measure_type string, override_key string"


def _statements_of(record: dict) -> Iterator[tuple]:
    for section in SECTIONS:
        sets = record.get(section)
        if type(sets) is str:
            sets = _inner(sets)
        if type(sets) is not dict:
            continue
        for set_name, fields in ((None, sets),) if section == "measurements" else sets.items():
            if type(fields) is str:
                fields = _inner(fields)
            if type(fields) is not dict:
                continue
            for name, st in fields.items():
                measure = key = None
                if type(st) is dict:
                    value, measure, key = st.get("value"), st.get("measure_type"), st.get("unit_override_key")
                else:
                    value = st
                raw = dim = own = None
                kind = type(value)
                if kind is float or kind is int:
                    raw = float(value)
                elif kind is str:
                    if section == "property_sets" and not any(c.isdigit() for c in value):
                        continue
                    raw = plain_number(value)
                    if raw is None:
                        if got := written_quantity(value):
                            dim, own = got
                if section == "property_sets" and own is None and measure is None and key is None:
                    continue  # a plain property: no quantity is stated
                if raw is not None and not math.isfinite(raw):
                    raw = None
                yield section, set_name, name, raw, dim, own, measure if type(measure) is str else None, key if type(key) is str else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.string())
    names = [f.split()[0] for f in STATEMENT.split(", ")]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for eid, model, cls, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            record = _load(text)
            if type(record) is not dict:
                continue
            for st in _statements_of(record):
                for o, x in zip(out, (eid, model, cls, *st)):
                    o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=names)


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, list, list, list, list] = ([], [], [], [], [])
        for model, meta in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys, defaults = model_units(meta)
            for is_key, units in ((True, keys), (False, defaults)):
                for name, unit in units.items():
                    for o, x in zip(out, (model, is_key, name, unit and unit[0], unit and unit[1])):
                        o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.float64()))], names=["model", "is_key", "name", "dim", "factor"])


def statements(entities: DataFrame, models: DataFrame) -> DataFrame:
    """All statements with the unit that is known: dim, factor and si_value are null where none is.

    ``unit_source`` says where the unit comes from: text, override, default or none.
    """
    said = entities.where("id is not null").select(F.col("id").cast("long"), F.col("source_model_id").cast("int"), "ifc_class", "canonical_json").mapInArrow(_rows, STATEMENT)
    units = models.select(F.col("id").cast("int"), "extraction_metadata").mapInArrow(_units_of, "model int, is_key boolean, name string, dim string, factor double")
    keys = units.where("is_key").select(F.col("model").alias("k_model"), F.col("name").alias("k_name"), F.col("dim").alias("k_dim"), F.col("factor").alias("k_factor"))
    defaults = units.where("not is_key").select(F.col("model").alias("d_model"), F.col("name").alias("d_name"), F.col("dim").alias("d_dim"), F.col("factor").alias("d_factor"))
    joined = said.join(keys, (F.col("source_model_id") == F.col("k_model")) & (F.lower("override_key") == F.col("k_name")), "left").join(
        defaults, (F.col("source_model_id") == F.col("d_model")) & (F.lower("measure_type") == F.col("d_name")), "left"
    )
    source = (
        F.when(F.col("own_value").isNotNull(), "text")
        .when(F.col("override_key").isNotNull(), F.when(F.col("k_factor").isNotNull(), "override").otherwise("none"))
        .when(F.col("d_factor").isNotNull(), "default")
        .otherwise("none")
    )
    s = F.col("unit_source")
    factor = F.when(s == "text", F.lit(1.0)).when(s == "override", F.col("k_factor")).when(s == "default", F.col("d_factor"))
    return (
        joined.withColumn("unit_source", source)
        .withColumn("dim", F.when(s == "text", F.col("own_dim")).when(s == "override", F.col("k_dim")).when(s == "default", F.col("d_dim")))
        .withColumn("factor", factor)
        .withColumn("si_value", F.when(s == "text", F.col("own_value")).otherwise(F.col("raw") * F.col("factor")))
        .select("entity_id", "source_model_id", "ifc_class", "section", "set_name", "quantity_name", "raw", "measure_type", "unit_source", "dim", "factor", "si_value")
    )


def contradictions(converted: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Entities and quantity names whose statements of known unit differ by more than the tolerance.

    Of the rows of ``convert_units`` those with a predicted unit count for no comparison.
    """
    known = F.col("decision") == "known" if "decision" in converted.columns else F.lit(True)
    dims = ("length", "area", "volume")
    aggs = [F.max(F.col("section") == "quantity_sets").alias("has")]
    for d in dims:
        v = F.when((F.col("dim") == d) & known, F.col("si_value"))
        aggs += [F.count(v).alias(f"n_{d}"), F.min(v).alias(f"lo_{d}"), F.max(v).alias(f"hi_{d}")]
    differs = F.lit(False)
    for d in dims:
        differs = differs | F.coalesce((F.col(f"n_{d}") >= 2) & (F.col(f"hi_{d}") - F.col(f"lo_{d}") > tolerance * F.abs(F.col(f"hi_{d}")) * (1 + 1e-9)), F.lit(False))
    return converted.groupBy("entity_id", "quantity_name").agg(*aggs).where(F.col("has") & differs).select("entity_id", "quantity_name")


FEATURES = ["magnitude", "source_level", "source_known", "expected", "has_expected", "class_code", "is_length", "is_area", "is_volume", "neighbour", "has_neighbour"]
DIMS = ("length", "area", "volume")
KEYS = ["entity_id", "source_model_id", "ifc_class", "section", "set_name", "quantity_name", "raw", "measure_type", "unit_source"]


def _features(stated: DataFrame, rows: DataFrame) -> DataFrame:
    """Magnitude, source, category and neighbouring fields of rows (with ``want``, the dimension) as numbers.

    The statistics are per name, per model and per entity over all statements, aggregated before they are joined, and
    a labelled row's own value is taken out of each.
    """
    positive = F.col("si_value") > 0
    usual = stated.where(positive).groupBy(F.col("quantity_name").alias("u_name"), F.col("dim").alias("u_dim")).agg(F.sum(F.log10("si_value")).alias("u_sum"), F.count(F.lit(1)).alias("u_n"))
    known = F.col("unit_source").isin("override", "default") & (F.col("raw") > 0)
    level = stated.where(known).groupBy(F.col("source_model_id").alias("l_model"), F.col("dim").alias("l_dim")).agg(F.sum(F.log10("factor")).alias("l_sum"), F.count(F.lit(1)).alias("l_n"))
    wanted = rows.select("entity_id").distinct()
    near = stated.where(positive).join(wanted, "entity_id", "left_semi").groupBy(F.col("entity_id").alias("n_entity"), F.col("dim").alias("n_dim")).agg(F.sum(F.log10("si_value")).alias("n_sum"), F.count(F.lit(1)).alias("n_n"))
    joined = (
        rows.join(usual, (F.col("quantity_name") == F.col("u_name")) & (F.col("want") == F.col("u_dim")), "left")
        .join(level, F.col("source_model_id").eqNullSafe(F.col("l_model")) & (F.col("want") == F.col("l_dim")), "left")
        .join(near, (F.col("entity_id") == F.col("n_entity")) & (F.col("want") == F.col("n_dim")), "left")
    )
    own = F.when(F.col("labelled"), 1).otherwise(0)

    def mean(total: str, n: str, value: Column) -> tuple[Column, Column]:
        left = F.coalesce(n, F.lit(0)) - own
        return F.when(left > 0, (F.coalesce(total, F.lit(0.0)) - F.when(F.col("labelled"), value).otherwise(0.0)) / left), left > 0

    mag = F.log10("raw")
    expected, has_expected = mean("u_sum", "u_n", F.log10("si_value"))
    source, has_source = mean("l_sum", "l_n", F.log10("factor"))
    near_by, has_near = mean("n_sum", "n_n", F.log10("si_value"))
    return joined.select(
        *KEYS, "labelled", "want", "factor",
        mag.alias("magnitude"),
        F.coalesce(source, F.lit(0.0)).alias("source_level"),
        has_source.cast("double").alias("source_known"),
        F.coalesce(expected - mag, F.lit(0.0)).alias("expected"),
        has_expected.cast("double").alias("has_expected"),
        (F.pmod(F.xxhash64(F.lower(F.coalesce("ifc_class", F.lit("")))), F.lit(32))).cast("double").alias("class_code"),
        *((F.col("want") == d).cast("double").alias(f"is_{d}") for d in DIMS),
        F.coalesce(near_by - mag, F.lit(0.0)).alias("neighbour"),
        has_near.cast("double").alias("has_neighbour"),
    )


def _fitted(sample: pa.Table) -> tuple[forest.Forest, list[tuple[str, float]]] | None:
    """(forest, (dimension, factor) of each class) from labelled rows; None if there are too few to fit and calibrate.

    The rows of every second entity calibrate what those of the others have taught.
    """
    rows = sample.sort_by([("place", "ascending"), ("magnitude", "ascending")])
    names = [(d, float(f"{f:.6e}")) for d, f in zip(rows.column("want").to_pylist(), rows.column("factor").to_pylist())]
    units = sorted(set(names))
    if len(units) < 2:
        return None
    code = {u: i for i, u in enumerate(units)}
    y = np.array([code[n] for n in names])
    x = np.stack([rows.column(f).to_numpy() for f in FEATURES], 1).astype(np.float64)
    held = rows.column("held").to_numpy(zero_copy_only=False)
    if held.all() or not held.any():
        return None
    model = forest.fit(x[~held], y[~held], len(units))
    guess, score = _best(model, x[held], np.array([d for d, _ in units]), rows.column("want").to_numpy(zero_copy_only=False)[held])
    model.calibrate(score, guess == y[held])
    return model, units


def _best(model: forest.Forest, x: np.ndarray, dims: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest class of the wanted dimension and its share."""
    share = model.shares(x) * (dims[None, :] == want[:, None])
    return share.argmax(1), share.max(1)


def convert_units(stated: DataFrame, fit_rows: int = FIT_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """Every statement with its decision: ``known`` (declared unit), ``converted`` (predicted unit) or ``review``.

    dim, factor and si_value are those of the declared or predicted unit, probability is 1 for declared ones. What
    has no finite number above zero, or no dimension that its name or measure type tells, is for review with
    probability 0, and so is all of unknown unit when nothing is labelled.
    """
    spark = stated.sparkSession
    s = Scratch(spark, "units")
    stated = s.cut(stated)
    counts = stated.where("dim is not null").groupBy("quantity_name", "dim").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy(F.col("quantity_name").alias("d_name")).agg(F.max(F.struct("n", "dim"))["dim"].alias("usual_dim"))
    known = stated.where("si_value is not null").select(*KEYS, "dim", "factor", "si_value", F.lit(1.0).alias("probability"), F.lit("known").alias("decision"))
    unknown = stated.where("si_value is null").join(usual, F.col("quantity_name") == F.col("d_name"), "left").withColumn("want", F.coalesce("dim", F.lower("measure_type"), "usual_dim"))
    fits = F.coalesce((F.col("raw") > 0) & F.col("want").isin(*DIMS) & (F.col("unit_source") == "none"), F.lit(False))
    asked = s.cut(unknown.withColumn("fits", fits).select(*KEYS, "dim", "factor", "want", "fits", F.lit(None).cast("double").alias("si_value"), F.lit(False).alias("labelled")))
    rest = asked.where("not fits").select(*KEYS, F.coalesce("dim", F.when(F.col("want").isin(*DIMS), F.col("want"))).alias("dim"), "factor", "si_value", F.lit(0.0).alias("probability"), F.lit("review").alias("decision"))
    labelled = stated.where("si_value > 0 and raw > 0 and unit_source <> 'text' and factor > 0").select(*KEYS, "dim", "factor", F.col("dim").alias("want"), F.lit(True).alias("fits"), "si_value", F.lit(True).alias("labelled"))
    order = F.xxhash64("entity_id", "quantity_name", "set_name", "section")
    sample = s.cut(labelled.orderBy(order, "raw").limit(2 * fit_rows))
    rows = s.cut(_features(stated, asked.where("fits").unionByName(sample)))
    taught = rows.where("labelled").select(order.alias("place"), "want", "factor", (F.pmod(F.xxhash64("entity_id"), F.lit(2)) == 1).alias("held"), *(F.col(f).cast("float").alias(f) for f in FEATURES))
    held = spark.sparkContext.broadcast(_fitted(taught.toArrow()))
    names = known.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            factor, p, sure = np.full(n, np.nan), np.zeros(n), np.zeros(n, bool)
            if held.value is not None and n:
                model, units = held.value
                x = np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(np.float32) for f in FEATURES], 1).astype(np.float64)
                best, score = _best(model, x, np.array([d for d, _ in units]), b.column("want").to_numpy(zero_copy_only=False))
                factor = np.where(score > 0, np.array([f for _, f in units])[best], np.nan)
                p = np.where(score > 0, model.probability(score), 0.0)
                sure = (score > 0) & (p >= confident)
            raw = b.column("raw").to_numpy(zero_copy_only=False)
            cols = [b.column(c) for c in KEYS] + [b.column("want"), pa.array(factor, mask=np.isnan(factor)), pa.array(raw * factor, mask=~sure), pa.array(p), pa.array(np.where(sure, "converted", "review"))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    predicted = rows.where("not labelled").mapInArrow(predict, known.schema)
    return s.finish(known.unionByName(predicted).unionByName(rest))


def predict_units(stated: DataFrame, fit_rows: int = FIT_ROWS, confident: float = CONFIDENT) -> DataFrame:
    """The statements without known unit, with the predicted factor, its calibrated probability and the decision.

    decision: ``converted`` (si_value is filled) or ``review``; ``review`` for all when nothing is labelled.
    """
    rows = convert_units(stated, fit_rows, confident).where("decision <> 'known' and unit_source = 'none'")
    return rows.select("entity_id", "source_model_id", "section", "set_name", "quantity_name", "raw", "dim", F.col("factor").alias("predicted_factor"), "probability", "decision", "si_value")
