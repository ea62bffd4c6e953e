"""One query for each output operation, run through the binding, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.model import FieldKind, FieldRef, Op
from trellisq.operators import candidates as K
from trellisq.operators import profile as P
from trellisq.operators import spatial as S
from trellisq.operators.unit_rules import FieldUnits
from trellisq.plans import binding as B
from trellisq.plans.structure import _ALL_FIELDS, _SUMMARY, _all_fields, _hops
from trellisq.sources import table

MODEL = 17
NAME = FieldRef(FieldKind.ATTRIBUTE, "name")
STOREY = FieldRef(FieldKind.ATTRIBUTE, "storey_name")
WIDTH = FieldRef(FieldKind.QUANTITY, "Width", "Qto_WallBaseQuantities")
WIDTHS = "case when regexp_full_match(json_extract_string(canonical_json, '$.quantity_sets.Qto_WallBaseQuantities.Width.value'), '-?\\d+(\\.\\d+)?') then json_extract_string(canonical_json, '$.quantity_sets.Qto_WallBaseQuantities.Width.value')::double end"
WALLS = f"from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcWall'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLES[name] = sql


def _run(s: SparkSession, d: str, operation: B.Operation, *conditions: B.BoundCondition, classes=("IfcWall",), **more) -> tuple[B.Result, B.Context]:
    tables = {n: table(s, d, f"{t}") for n, t in (("entities", "ifc_entities"), ("relationships", "ifc_relationships"), ("members", "relationship_members"))}
    ctx = B.Context(MODEL, units={WIDTH: FieldUnits("uniform", "mm")}, **tables)
    return B.execute(B.Part("p1", operation, classes, conditions, **more), ctx), ctx


def _state(s: SparkSession, r: B.Result) -> DataFrame:
    return s.createDataFrame([(r.status.value, r.total, r.value, r.coverage)], "status string, total long, value double, coverage long")


def _cond(op: Op, value=None, field: FieldRef = NAME, **more) -> B.BoundCondition:
    return B.BoundCondition("c1", field, op, value, source="question", **more)


_add("answer_count", lambda s, d: _state(s, _run(s, d, B.Operation.COUNT)[0]).select("status", "total"), f"select case when count(*) = 0 then 'zero' else 'exact' end as status, count(*) as total {WALLS}")
_add("answer_existence", lambda s, d: _state(s, _run(s, d, B.Operation.EXISTENCE, _cond(Op.EXACT, "no such wall"))[0]).select("status", "total"), f"select 'zero' as status, count(*) as total {WALLS} and json_extract_string(canonical_json, '$.identity.name') = 'no such wall'")
_add("answer_absent_kind", lambda s, d: _state(s, _run(s, d, B.Operation.COUNT, classes=())[0]).select("status", "total"), "select 'zero' as status, 0 as total")
_add(
    "answer_list",
    lambda s, d: _run(s, d, B.Operation.LIST, _cond(Op.IS_PRESENT), limit=40)[0].rows.select("id", "global_id", "name"),
    f"select id, global_id, json_extract_string(canonical_json, '$.identity.name') as name {WALLS} and json_extract_string(canonical_json, '$.identity.name') <> '' order by id limit 40",
)
_add("answer_sample", lambda s, d: _run(s, d, B.Operation.SAMPLE)[0].rows.select("id", "global_id"), f"select id, global_id {WALLS} order by id limit 1")
_add(
    "answer_groups",
    lambda s, d: _run(s, d, B.Operation.GROUPS, field=STOREY, limit=30)[0].rows,
    f"select json_extract_string(canonical_json, '$.storey.name') as key, count(*) as n {WALLS} group by 1 order by n desc, key nulls last limit 30",
)
_add(
    "answer_aggregate",
    lambda s, d: _state(s, _run(s, d, B.Operation.AGGREGATE, field=WIDTH, function="sum")[0]).withColumn("value", F.round("value", 3)),
    f"select case when count(*) = 0 then 'zero' when count({WIDTHS}) = 0 then 'unavailable' when count({WIDTHS}) < count(*) then 'partial' else 'exact' end as status, count(*) as total, round(sum({WIDTHS}), 3) as value, count({WIDTHS}) as coverage {WALLS}",
)
_add(
    "answer_extremum",
    lambda s, d: _state(s, _run(s, d, B.Operation.EXTREMUM, field=WIDTH)[0]).select("total", "value", "coverage"),
    f"select count(*) as total, max({WIDTHS}) as value, count({WIDTHS}) as coverage {WALLS}",
)
_add(
    "answer_unit_guard",
    lambda s, d: _state(s, _run(s, d, B.Operation.COUNT, _cond(Op.GT, 1, WIDTH, unit="m"))[0]).select("status", "total"),
    "select 'unavailable' as status, cast(null as bigint) as total",
)
_add(
    "answer_negated_range",
    lambda s, d: _state(s, _run(s, d, B.Operation.COUNT, _cond(Op.BETWEEN, (200, 300), WIDTH, unit="mm", negated=True))[0]).select("total"),
    f"select count(*) as total {WALLS} and ({WIDTHS} < 200 or {WIDTHS} > 300)",
)
_add(
    "answer_description",
    lambda s, d: _run(s, d, B.Operation.DESCRIPTION)[0].rows.select("id", "ifc_class"),
    f"select id, ifc_class {WALLS} order by id limit 3",
)
_add(
    "answer_relationship",
    lambda s, d: _run(s, d, B.Operation.RELATIONSHIP, classes=("IfcBuildingStorey",), endpoint_classes=("IfcWall", "IfcDoor"), depth=1)[0].rows.select("id", "ifc_class", "depth"),
    _hops(1) + " select e.id, e.ifc_class, min(h.depth) as depth from hops h join ifc_entities e on e.id = h.to_id where e.id not in (select id from seeds) and e.ifc_class in ('IfcWall', 'IfcDoor') group by 1, 2 order by depth, e.id limit 200",
)
_add("answer_viewer", lambda s, d: B.viewer(B.Part("p1", B.Operation.COUNT, ("IfcWall",)), _run(s, d, B.Operation.COUNT)[1]).select("id", "global_id", "exact_total"), f"select id, global_id, (select count(*) {WALLS}) as exact_total {WALLS} order by id limit 2000")


def _follow_up(s: SparkSession, d: str) -> DataFrame:
    r, ctx = _run(s, d, B.Operation.COUNT, _cond(Op.IS_PRESENT))
    before = B.PreviousScope(B.Part("p1", B.Operation.COUNT, ("IfcWall",), (_cond(Op.IS_PRESENT),)))
    narrowed = before.narrowed((B.BoundCondition("c2", STOREY, Op.IS_PRESENT, source="question"),), "p2", B.Operation.COUNT)
    return s.createDataFrame([(r.total, B.execute(narrowed, ctx).total)], "before long, after long")


_add("answer_follow_up", _follow_up, f"select count(*) as before, count(*) filter (where json_extract_string(canonical_json, '$.storey.name') <> '') as after {WALLS} and json_extract_string(canonical_json, '$.identity.name') <> ''")
_add(
    "answer_floors",
    lambda s, d: B.floors(B.Context(MODEL, table(s, d, "ifc_entities"))).select("band", "low", "label"),
    _SUMMARY + f" select band, low, case when band >= reference then 'Floor ' || (band - reference + 1) else 'Lower level ' || (reference - band) end as label from z where source_model_id = {MODEL}",
)
_ITEMS = (("L1", "walls"), ("L2", "fire rating"), ("L3", "floor 2"), ("L4", "is external"))


def _slate(s: SparkSession, d: str) -> DataFrame:
    own = lambda t: table(s, d, t).where(f"source_model_id = {MODEL}")
    fields = _all_fields(s, d).where(f"source_model_id = {MODEL}")
    found = K.slate_concepts(own("ifc_entities"), fields, P.value_facts(fields), S.band_summary(S.bands(S.storeys(own("ifc_entities")))), own("ifc_relationships"))
    return K.slate(s.createDataFrame(list(_ITEMS), "item_id string, text string"), found)


QUERIES["slate"] = _slate
