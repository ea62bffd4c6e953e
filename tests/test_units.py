import json

import pytest

from trellisq.functions.measures import model_units, note_units, plain_number, unit_of, written_quantity
from trellisq.operators import units as U
from trellisq.operators.unit_rules import FieldUnits, decide, equivalent


@pytest.mark.parametrize(
    "text,dim,value",
    [
        ("976 millimetres", "length", 0.976), ("1 764l", "volume", 1.764), ("5,66 m^2", "area", 5.66), (" 9441 CENTIMETRES ", "length", 94.41), ("5'-11 7/8\"", "length", 71.875 * 0.0254), ("11 ft 9 3/4 in", "length", 141.75 * 0.0254),
        ("3/4\"", "length", 0.75 * 0.0254), ("10 ft 0 in", "length", 3.048), ("ca. 96.3SF", "area", 96.3 * 0.09290304), ("47.7 cbm netto", "volume", 47.7), ("3920 200 cm2", "area", 392.02), ("25,1 sq ft (clear)", "area", 25.1 * 0.09290304),
        ("1943 MM", "length", 1.943), ("104 in", "length", 104 * 0.0254), ("nom. 2 dm³", "volume", 0.002), ("7.1 ft³", "volume", 7.1 * 0.028316846592), ("2'", "length", 0.6096), ("1 234 567 mm", "length", 1234.567), ("8 cu yd", "volume", 8 * 0.9144**3),
    ],
)
def test_written_quantities(text, dim, value):
    got = written_quantity(text)
    assert got[0] == dim and got[1] == pytest.approx(value, rel=1e-9)


@pytest.mark.parametrize("text", ["REI 90", "12", "", "x mm", "3 pieces", "5 m 30", "2 m/s", "E 120", "3 in 5", "m"])
def test_no_quantities(text):
    assert written_quantity(text) is None


def test_plain_numbers():
    assert plain_number(" 1 234,5 ") == 1234.5 and plain_number("1.5e3") == 1500 and plain_number("12 m") is None and plain_number("") is None


def test_models():
    defs, defaults = model_units(json.dumps({"dimension_units": {"defaults": {"length": "lengthunit:MM", "area": None, "volume": "volumeunit:cubic foot"}, "definitions": {
        "lengthunit:mm": {"si_name": "METRE", "prefix": "MILLI", "resolved": True}, "lengthunit:grid": {"resolved": False, "symbol": "m"}, "areaunit:square foot": {"conversion": {"value": 92903.04, "unit_symbol": "mm²"}, "resolved": True}, "lengthunit:inch": {"name": "INCH", "resolved": True}}}}))
    assert defaults["length"] == ("length", 0.001) and "area" not in defaults and defaults["volume"][1] == pytest.approx(0.028316846592)
    assert defs["lengthunit:grid"] is None and defs["areaunit:square foot"][1] == pytest.approx(0.09290304) and defs["lengthunit:inch"] == ("length", 0.0254)
    assert model_units(None) == model_units("{broken") == model_units("[]") == ({}, {})
    assert note_units("Alle Längen in cm, Flächen in m², Volumen in Litern l") == {"length": ("length", 0.01), "area": ("area", 1.0), "volume": ("volume", 0.001)}
    assert unit_of("Square Foot") == unit_of("sq ft") == unit_of("SF") and unit_of("furlong") is None


def q(value, **more):
    return {"value": value, **more}


def test_contradictions(spark, entities):
    models = spark.createDataFrame([(1, json.dumps({"dimension_units": {"defaults": {"length": "lengthunit:mm"}, "definitions": {"lengthunit:mm": {"si_name": "METRE", "prefix": "MILLI", "resolved": True}, "lengthunit:grid": {"resolved": False}, "lengthunit:foot": {"name": "Foot", "resolved": True}}}}), "x")], "id int, extraction_metadata string, name string")
    mm, ft = {"measure_type": "length"}, {"measure_type": "length", "unit_override_key": "lengthunit:FOOT"}
    rows = entities([
        (1, "IfcWall", {"quantity_sets": {"Q": {"Width": q(1000.0, **mm)}}, "property_sets": {"P": {"Width": q("1.05 m")}}}),  # 5 % apart
        (2, "IfcWall", {"quantity_sets": {"Q": {"Width": q(1000.0, **mm)}}, "property_sets": {"P": {"Width": q("1,01 m")}}}),  # 1 % apart
        (3, "IfcWall", {"quantity_sets": {"Q": {"Width": q("1000", **mm)}}, "measurements": {"Width": q(1.0, **ft)}}),
        (4, "IfcWall", {"quantity_sets": {"Q": {"Width": q(5.0)}}, "property_sets": {"P": {"Width": q("1 m")}, "R": {"Width": q("2 m")}}}),  # occurs without a unit
        (5, "IfcWall", {"property_sets": {"P": {"Width": q("1 m")}, "R": {"Width": q("2 m")}}}),  # no quantity
        (6, "IfcWall", {"quantity_sets": {"Q": {"Width": q(1.0, measure_type="length", unit_override_key="lengthunit:grid")}}, "property_sets": {"P": {"Width": q("3 m")}}}),  # not resolved
        (7, "IfcWall", {"quantity_sets": {"Q": {"Width": q(1000.0, **mm)}}, "property_sets": {"P": {"width": q("3 m")}}}),  # names match exactly
        (8, "IfcWall", {"quantity_sets": {"Q": "unreadable", "R": {"Width": q("2 m")}}, "property_sets": {"P": {"Width": q("2,5 m (clear)")}}}),
        (9, "IfcWall", {"quantity_sets": {"Q": {"Width": q(None, **mm), "Area": q(True)}}, "property_sets": None}),
        (10, "IfcWall", None), (11, None, "broken"),
    ])
    stated = U.statements(rows, models)
    assert {(r.entity_id, r.quantity_name) for r in U.contradictions(stated).collect()} == {(1, "Width"), (3, "Width"), (4, "Width"), (8, "Width")}
    assert U.contradictions(U.statements(rows.where("false"), models)).count() == 0
    assert U.predict_units(U.statements(rows, models)).where("decision <> 'review'").count() == 0


def test_prediction_on_held_out_units(spark):
    """Units are taken from known statements and predicted; confident predictions must be right 9 times in 10."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    from pyspark.sql import functions as F

    from trellisq.sources import table

    stated = U.statements(table(spark, d, "ifc_entities"), table(spark, d, "ifc_source_models")).cache()
    hide = (F.pmod(F.xxhash64("entity_id"), F.lit(5)) == 0) & F.col("unit_source").isin("override", "default") & (F.col("raw") > 0)
    truth = stated.where(hide).select("entity_id", "section", "set_name", "quantity_name", "factor")
    blind = stated.withColumn("h", hide)
    for c in ("dim", "factor", "si_value"):
        blind = blind.withColumn(c, F.when(~F.col("h"), F.col(c)))
    blind = blind.withColumn("unit_source", F.when(F.col("h"), "none").otherwise(F.col("unit_source"))).drop("h")
    got = U.predict_units(blind, fit_rows=5000).where("decision = 'converted'").alias("g")
    t = truth.alias("t")
    on = (F.col("g.entity_id") == F.col("t.entity_id")) & (F.col("g.section") == F.col("t.section")) & F.col("g.set_name").eqNullSafe(F.col("t.set_name")) & (F.col("g.quantity_name") == F.col("t.quantity_name"))
    r = got.join(t, on).agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.col("predicted_factor") / F.col("t.factor") - 1) < 1e-3).cast("int")).alias("right")).first()
    assert r.n > 0.3 * truth.count() and r.right >= 0.9


def test_unit_decisions():
    mm = FieldUnits("uniform", "mm")
    assert decide("w", mm, "millimetres").ok and decide("w", mm, "millimetres").note and decide("w", mm, "mm").note is None
    assert not decide("w", mm, "m").ok and not decide("n", FieldUnits(), "mm").ok and decide("n", FieldUnits(), None).ok
    assert not decide("w", FieldUnits("mixed", limitation="two units"), None).ok
    assert equivalent("m^2", "square metres") and equivalent("MM", "mm.") and not equivalent("m", "cm") and not equivalent(None, "m") and equivalent("parsec", " Parsec")
