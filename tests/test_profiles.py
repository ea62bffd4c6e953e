import json

import pytest
from pyspark.sql import functions as F

from trellisq.functions import lexical as X
from trellisq.operators import candidates as K
from trellisq.operators import profile as P
from trellisq.operators import spatial as S
from trellisq.operators import vectors as V

FIELD = "source_model_id int, entity_id long, ifc_class string, section string, set_name string, field_name string, value string, value_kind string, measure_type string, unit_override_key string"


def levels(spark, heights, factor=1.0):
    return S.bands(spark.createDataFrame([(1, i, f"g{i}", f"n{i}", h * factor) for i, h in enumerate(heights)], "source_model_id int, id long, global_id string, name string, elevation double"))


@pytest.mark.parametrize(
    "heights,bands",
    [([0, 3, 6], [0, 1, 2]), ([0, 3, 3.05, 6, 6.05], [0, 1, 1, 2, 2]), ([5, 5, 5], [0, 0, 0]), ([2], [0]), ([], []), ([-3, 0, 3], [0, 1, 2]), ([0, 0.5, 10], [0, 0, 1])],
)
def test_bands_have_no_scale(spark, heights, bands):
    for factor in (1.0, 1000.0):
        assert [r.band for r in levels(spark, heights, factor).orderBy("elevation", "global_id").collect()] == bands


def test_reference_and_words(spark):
    b = S.band_summary(levels(spark, [-3, 0, 3, 6])).orderBy("band").collect()
    assert [r.label for r in b] == ["Lower level 1", "Floor 1", "Floor 2", "Floor 3"]
    assert [r.label for r in S.band_summary(levels(spark, [10, 13])).orderBy("band").collect()] == ["Floor 1", "Floor 2"]
    assert S.resolve_floor("on the second floor") == ("ordinal", 2) and S.resolve_floor("Level 3") == ("ordinal", 3) and S.resolve_floor("the 11th storey") == ("ordinal", 11)
    assert S.resolve_floor("top floor") == ("top", None) and S.resolve_floor("the lowest level") == ("bottom", None) and S.resolve_floor("walls") is None
    summary = S.band_summary(levels(spark, [-3, 0, 3, 6]))
    at = lambda c: [r.low for r in S.floor_bands(summary, c).collect()]
    assert at(("ordinal", 2)) == [3] and at(("top", None)) == [6] and at(("ground", None)) == [0] and at(("ordinal", 9)) == []
    cut = S.cut_ranges(summary).orderBy("band").collect()
    assert cut[1].plan_top == 1.2 and cut[1].plan_bottom == -1.5


def fields(spark, rows):
    return spark.createDataFrame([(1, e, "IfcWall", "quantity_sets", s, f, v, "string", m, k) for e, s, f, v, m, k in rows], FIELD)


def test_measure_ladder(spark):
    rows = [(1, "Q", "uniform", "1", "length", None), (2, "Q", "uniform", "2", "length", None), (1, "Q", "override", "1", "length", "in"), (1, "Q", "mixed", "1", "length", None), (2, "Q", "mixed", "1", "length", "in"), (1, "Q", "partly", "1", "length", None), (2, "Q", "partly", "1", None, None)]
    rows += [(1, "Q", "nodefault", "1", "area", None), (1, "Q", "unresolved", "1", "length", "grid"), (1, "Q", "two", "1", "length", None), (2, "Q", "two", "1", "area", None), (1, "Q", "plain", "1", None, None), (1, "Q", "empty", "", "length", None)]
    defaults = spark.createDataFrame([(1, "length", "mm")], "source_model_id int, measure_type string, unit_key string")
    symbols = spark.createDataFrame([(1, "mm", "mm"), (1, "in", "inch")], "source_model_id int, unit_key string, symbol string")
    got = {r.field_name: (r.unit_state, r.symbol, r.limitation) for r in P.measure_facts(fields(spark, rows), defaults, symbols).collect()}
    assert got == {
        "uniform": ("uniform", "mm", None), "override": ("uniform", "inch", None), "mixed": ("mixed", None, "several units"), "partly": ("unknown", None, "partly untyped"), "nodefault": ("unknown", None, "no default unit"),
        "unresolved": ("unknown", None, "unit not resolved"), "two": ("unknown", None, "several measure types"), "plain": ("none", None, "not measured"),
    }


@pytest.mark.parametrize("n_fields,per,want", [(6, 1, True), (64, 8, False), (64, 9, True), (63, 1, True)])
def test_containers(spark, n_fields, per, want):
    rows = [(e, "S", f"f{(e * per + k) % n_fields}", "1", None, None) for e in range(n_fields) for k in range(per)]
    assert P.container_shapes(fields(spark, rows)).first().reliable is want


def test_vocabulary(spark):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] * 3 + [("a", "z"), ("b", "x")], "ifc_class string, v string")
    assert [(r.v, r.nth) for r in P.top_per(rows, ["ifc_class"], "v", 2).where("ifc_class = 'a'").orderBy("nth").collect()] == [("x", 1), ("y", 2)]
    trimmed = P.fair_trim(rows, ["ifc_class"], [F.col("v")], 3).collect()
    assert [(r.ifc_class, r.turn) for r in trimmed] == [("a", 1), ("b", 1), ("a", 2)]
    noise = spark.createDataFrame([("",), ("#12",), ("12.5",), ("x" * 61,), ("2H_lRmEQgaUOJXBRoQsBHR",), ("Wall",)], "v string")
    assert [r.v for r in noise.where(~P.is_noise(F.col("v"))).collect()] == ["Wall"]
    stem = spark.createDataFrame([("Door_(#12)",), ("Door",)], "v string").select(P.name_stem(F.col("v")).alias("s")).distinct()
    assert [r.s for r in stem.collect()] == ["Door"]
    ranks = P.nearest_rank(spark.range(1, 12).withColumnRenamed("id", "x"), "x", [0.0, 0.5, 0.9, 1.0])
    assert {r.fraction: r.value for r in ranks.collect()} == {0.0: 1, 0.5: 6, 0.9: 10, 1.0: 11}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0])], "id long, embedding array<float>")
    got = V.search(rows, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r.id, round(r.similarity, 6)) for r in got] == [(1, 1.0), (4, 1.0), (2, 0.0), (3, -1.0)]
    assert V.search(rows, [1.0, 0.0], 1).first().id == 1
    assert V.search(rows, [1.0, 0.0], 5, scope=rows.where("false").select("id")).count() == 0
    assert [r.id for r in V.search(rows, [1.0, 0.0], 5, threshold=0.5, scope=rows.where("id in (2, 4)").select("id")).where("accepted").collect()] == [4]
    assert {(r.id, r.reason) for r in V.invalid_vectors(rows, 2).collect()} == {(5, "null"), (6, "zero"), (7, "length")}
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    fused = V.fuse({"entity": a, "relationship": a}).collect()
    assert [(r.kind, r.id) for r in fused] == [("entity", 1), ("relationship", 1), ("entity", 2), ("relationship", 2)] and fused[0].score == pytest.approx(1 / 61)
    with pytest.raises(ValueError):
        V.search(rows, [1.0], 101)


def test_words(spark):
    assert X.normalize("  Façade—Nord_2 ") == "facade nord 2" and X.split_identifier("IfcWallStandardCase") == ["wall", "standard", "case"] and X.split_identifier("Pset_WallCommon") == ["pset", "wall", "common"]
    assert [X.singular(w) for w in ("walls", "storeys", "entries", "boxes", "glass", "bus")] == ["wall", "storey", "entry", "box", "glass", "bus"]
    seen = ["Yes", "EI 30", "walls", "Größe"]
    assert X.resolve_value("EI 30", seen) == ("EI 30", "exact") and X.resolve_value("ei-30", seen) == ("EI 30", "normalized") and X.resolve_value("wall", seen) == ("walls", "singular") and X.resolve_value("true", seen) == ("Yes", "boolean")
    assert X.resolve_value("ei-30", seen, exact=True) is None and X.resolve_value("EI", seen) is None and X.resolve_value("EI", seen, contains=True) == ("EI 30", "contains") and X.resolve_value(None, seen) is None
    df = spark.createDataFrame([("Wall 10",), ("Wall 9",), ("wall 2",), (None,)], "t string")
    assert [r.t for r in df.orderBy(X.natural_key(F.col("t")).asc_nulls_last()).collect()] == ["wall 2", "Wall 9", "Wall 10", None]
    assert [r.x for r in spark.createDataFrame([("Façade—N_2",)], "t string").select(X.normalized(F.col("t")).alias("x")).collect()] == ["facade n 2"]


def test_candidates_and_closure(spark):
    found = spark.createDataFrame([("class", "IfcWall", "IfcWall", 10, ["wall"]), ("class", "IfcWallType", "IfcWallType", 5, ["wall", "type"]), ("field", "P.FireRating", "FireRating", 7, ["fire", "rating"])], "kind string, name string, label string, n long, words array<string>")
    items = spark.createDataFrame([("L1", "walls"), ("L2", "fire resistance rating")], "item_id string, text string")
    got = {(r.item_id, r.name): r.score for r in K.score(items, found).collect()}
    assert got == {("L1", "IfcWall"): 11.0, ("L1", "IfcWallType"): 6.0, ("L2", "P.FireRating"): pytest.approx(3 + 2 / 3)}
    onto = spark.createDataFrame([("IfcWall", ["IfcElement"], "occurrence"), ("IfcWallStandardCase", ["IfcWall", "IfcElement"], "occurrence"), ("IfcWallType", ["IfcWall"], "type"), ("IfcRamp", ["IfcElement"], "occurrence")], "class string, ancestors array<string>, role string")
    present = spark.createDataFrame([("IfcWallStandardCase", 60), ("IfcWallType", 3)], "ifc_class string, n long")
    c = {r.asked: (r.classes, r.n, r.absent) for r in K.closure(onto, present, ["IfcWall", "IfcRamp"]).collect()}
    assert c == {"IfcWall": (["IfcWallStandardCase"], 60, False), "IfcRamp": ([], 0, True)}
    t = spark.createDataFrame([("IfcDoorStyle",), ("IfcWallType",), ("IfcWall",)], "c string").select(K.occurrence_of_type(F.col("c")).alias("o"))
    assert [r.o for r in t.collect()] == ["IfcDoor", "IfcWall", "IfcWall"]
    assert json.dumps(got and 1) == "1"
