import datetime as dt

import pytest

from trellisq.operators.pivot import columns_of, pivot, read, read_date, statements

CATALOG = [("IfcWall", "LoadBearing", "boolean"), ("IfcWall", "FireRating", "string"), ("IfcWall", "Rating", "int"), ("IfcWall", "U", "double"), ("IfcWall", "Install Date", "date"), ("IfcSlab", "Rating", "string")]


@pytest.mark.parametrize(
    "value,kind,want",
    [
        (".T.", "boolean", "true"), ("Nein", "boolean", "false"), (1, "boolean", "true"), (0.0, "boolean", "false"), ("vrai", "boolean", "true"), ("partly", "boolean", None), (2, "boolean", None), (" OUI ", "boolean", "true"),
        ("+53", "int", "53"), ("53,0", "int", "53"), (53.0, "int", "53"), ("5.3e1", "int", "53"), ("53.5", "int", None), (True, "int", None), ("EI 30", "int", None), (10**30, "int", None), ("9" * 400, "int", None), ("9007199254740993.0", "int", "9007199254740993"), ("9007199254740993", "int", "9007199254740993"), ("1e999999999", "int", None), ("5e-999999999", "int", None), ("0e5", "int", "0"),
        ("34,07", "double", "34.07"), ("3.407e+01", "double", "34.07"), ("-0", "double", "0.0"), ("nan", "double", None), ("1e999", "double", None), ("1.2.3", "double", None), ("< 5", "double", None),
        (" EI 30 ", "string", "ei 30"), (5, "string", "5"), ([1], "string", "[1]"), ("Ä", "string", "ä"),
    ],
)
def test_readings(value, kind, want):
    assert read(value, kind) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("2019-02-22T00:00:00", "2019-02-22"), ("31.12.2020", "2020-12-31"), ("01.02.2020", "2020-02-01"), ("2020/02/30", None), ("20210131", "2021-01-31"), ("13/04/2020", "2020-04-13"), ("04/13/2020", "2020-04-13"), ("04/05/2020", None),
        ("5/5/2020", "2020-05-05"), ("spring 2020", None), ("2020-05", None), ("week 12", None), ("12 March 2021", "2021-03-12"), ("3. März 2020", "2020-03-03"), ("Mar 3, 2020", "2020-03-03"), ("2021-17-11", None), ("2021-13-05", None), ("2021/13/05", None), ("05.13.2020", None), ("31122020", "2020-12-31"),
        ("2024-02-29 10:00", "2024-02-29"), ("2023-02-29", None), ("1/2/20", None), ("2020-01-02Tx", None),
    ],
)
def test_dates(text, want):
    assert read_date(text) == want


def test_wide_rows_and_unsettled(spark, entities):
    ps = lambda *sets: {"property_sets": {f"s{i}": {k: {"value": v} for k, v in s.items()} for i, s in enumerate(sets)}}
    rows = entities([
        (1, "IFCWALL", ps({"load_bearing": "yes", "FIRE RATING": "EI 30", "Rating": "5.0", "U": "1,5", "InstallDate": "01.02.2020"}, {"LoadBearing": True, "FireRating": "ei 30 ", "Rating": 5})),
        (2, "IfcWall", ps({"LoadBearing": "yes"}, {"LoadBearing": "no"})),
        (3, "IfcWall", ps({"LoadBearing": "partly", "Rating": None, "U": "  "}, {"LoadBearing": "yes"})),
        (4, "IfcSlab", ps({"Rating": "A", "LoadBearing": "yes"})),
        (5, "IfcDoor", ps({"Rating": "A"})), (6, None, ps({"Rating": "A"})), (7, "IfcWall", None), (8, "IfcWall", "broken"),
        (9, "IfcWall", {"property_sets": {"a": "text", "b": {"U": 5, "Rating": {"value": [1]}}}}),
    ])
    out = {r.entity_id: r for r in pivot(statements(rows, CATALOG), CATALOG).collect()}
    assert set(out) == {1, 2, 3, 4, 9}
    one = out[1]
    assert (one.LoadBearing, one.FireRating, one.Rating_int, one.U, one["Install Date"], one.unsettled) == (True, "EI 30", 5, 1.5, dt.date(2020, 2, 1), [])
    assert out[2].unsettled == ["LoadBearing"] and out[2].LoadBearing is None
    assert out[3].unsettled == ["LoadBearing"] and out[3].Rating_int is None
    assert out[4].Rating_string == "A" and out[4].LoadBearing is None
    assert out[9].unsettled == ["Rating"]
    assert pivot(statements(rows.where("false"), CATALOG), CATALOG).count() == 0
    assert pivot(statements(rows, []), []).columns == ["entity_id", "unsettled"]


def test_groups_across_batches(spark):
    """Entities that straddle Arrow batches come out as one row."""
    _, wide = columns_of(CATALOG)
    n = 3000
    stated = spark.range(n * len(wide)).selectExpr(f"id div {len(wide)} as entity_id", f"cast(id % {len(wide)} as int) as col", "id % 7 = 0 as bad", "case when id % 7 <> 0 then '1' end as canon", "'1' as shown")
    kinds = {i: k for i, (_, _, k) in enumerate(wide)}
    stated = stated.selectExpr("entity_id", "col", "bad", f"case when canon is not null then element_at(map({', '.join(f'{i}, {chr(39)}' + {'boolean': 'true', 'date': '2020-01-01'}.get(k, '1') + chr(39) for i, k in kinds.items())}), col) end as canon", "shown")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
    try:
        out = pivot(stated, CATALOG).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == n == len({r.entity_id for r in out})
    bad = {(i // len(wide), wide[i % len(wide)][1]) for i in range(n * len(wide)) if i % 7 == 0}
    assert {(r.entity_id, a) for r in out for a in r.unsettled} == bad
