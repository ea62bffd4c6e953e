"""Queries of the typed operations over the whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.model import AggregatePlan, Condition, FieldKind, FieldRef, Group, ListPlan, Op, Scope, SortKey
from trellisq.operators import catalog as C
from trellisq.operators import entities as E
from trellisq.operators import fields as FL
from trellisq.operators.predicate import compile_tree, matching
from trellisq.sources import table

MODEL = 17
NAME = FieldRef(FieldKind.ATTRIBUTE, "name")
TAG = FieldRef(FieldKind.ATTRIBUTE, "tag")
PTYPE = FieldRef(FieldKind.ATTRIBUTE, "predefined_type")
STOREY = FieldRef(FieldKind.ATTRIBUTE, "storey_name")
CLASS = FieldRef(FieldKind.ATTRIBUTE, "ifc_class")
STEP = FieldRef(FieldKind.ATTRIBUTE, "step_id")
TYPE = FieldRef(FieldKind.TYPE_FACT, "type_name")
FIRE = FieldRef(FieldKind.PROPERTY, "FireRating", "Pset_WallCommon")
LOAD = FieldRef(FieldKind.PROPERTY, "LoadBearing", "Pset_WallCommon")
THERMAL = FieldRef(FieldKind.PROPERTY, "ThermalTransmittance", "Pset_WallCommon")
WIDTH = FieldRef(FieldKind.QUANTITY, "Width", "Qto_WallBaseQuantities")
HEIGHT = FieldRef(FieldKind.MEASUREMENT, "Height")

_TEXT = "json_extract_string(canonical_json, '$.{}')"
_SQL = {
    NAME: _TEXT.format("identity.name"),
    TAG: _TEXT.format("identity.tag"),
    PTYPE: _TEXT.format("meta.predefined_type"),
    STOREY: _TEXT.format("storey.name"),
    TYPE: _TEXT.format("type.name"),
    FIRE: _TEXT.format("property_sets.Pset_WallCommon.FireRating.value"),
    LOAD: _TEXT.format("property_sets.Pset_WallCommon.LoadBearing.value"),
    THERMAL: _TEXT.format("property_sets.Pset_WallCommon.ThermalTransmittance.value"),
    WIDTH: _TEXT.format("quantity_sets.Qto_WallBaseQuantities.Width.value"),
    HEIGHT: _TEXT.format("measurements.Height.value"),
    CLASS: "ifc_class",
    STEP: "cast(step_id as varchar)",
}


def _num(ref: FieldRef) -> str:
    t = _SQL[ref]
    return f"(case when regexp_full_match({t}, '-?\\d+(\\.\\d+)?') then try_cast({t} as double) end)"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _ents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ifc_entities")


def _cat(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(table(spark, d, "ifc_source_models"), table(spark, d, "source_model_catalog_entries"), table(spark, d, "model_families"))


# --- counts, scopes and groups of conditions
_add("count_entities_by_class", lambda s, d: E.count_by_class(_ents(s, d)), "select ifc_class, count(*) as n from ifc_entities group by 1")
_add("count_entities", lambda s, d: E.count_entities(_ents(s, d), Scope(MODEL, ("IfcWall", "IfcDoor"))), f"select count(*) as n from ifc_entities where source_model_id = {MODEL} and ifc_class in ('IfcWall', 'IfcDoor')")
_add(
    "count_filtered_and_or",
    lambda s, d: E.count_entities(_ents(s, d), Scope(MODEL), Group("and", (Condition(STOREY, Op.IS_PRESENT), Group("or", (Condition(NAME, Op.CONTAINS, "wing"), Condition(TAG, Op.GTE, "7")))))),
    f"select count(*) as n from ifc_entities where source_model_id = {MODEL} and coalesce({_SQL[STOREY]} <> '', false) and (strpos(lower({_SQL[NAME]}), 'wing') > 0 or {_SQL[TAG]} >= '7')",
)

# --- every operator, over the whole table
_OPS = {
    "op_eq": (Condition(STOREY, Op.EQ, "Level 1"), f"{_SQL[STOREY]} = 'Level 1'"),
    "op_ne": (Condition(STOREY, Op.NE, "Level 1"), f"{_SQL[STOREY]} <> 'Level 1'"),
    "op_eq_number": (Condition(STEP, Op.EQ, 224), f"{_num(STEP)} = 224"),
    "op_gt": (Condition(THERMAL, Op.GT, 10), f"{_num(THERMAL)} > 10"),
    "op_gte": (Condition(TAG, Op.GTE, 500000), f"{_num(TAG)} >= 500000"),
    "op_lt": (Condition(THERMAL, Op.LT, 1.5), f"{_num(THERMAL)} < 1.5"),
    "op_lte_text": (Condition(NAME, Op.LTE, "Door"), f"{_SQL[NAME]} <= 'Door'"),
    "op_between": (Condition(WIDTH, Op.BETWEEN, (0.2, 0.5)), f"{_num(WIDTH)} between 0.2 and 0.5"),
    "op_in": (Condition(STOREY, Op.IN, ("Level 1", "Storey +1")), f"{_SQL[STOREY]} in ('Level 1', 'Storey +1')"),
    "op_in_number": (Condition(STEP, Op.IN, (224, 284, 384, 10207)), f"{_num(STEP)} in (224, 284, 384, 10207)"),
    "op_not_in": (Condition(STOREY, Op.NOT_IN, ("Level 1", "Storey +1")), f"{_SQL[STOREY]} is not null and {_SQL[STOREY]} not in ('Level 1', 'Storey +1')"),
    "op_exact": (Condition(FIRE, Op.EXACT, "REI 90"), f"{_SQL[FIRE]} = 'REI 90'"),
    "op_ci_exact": (Condition(FIRE, Op.CI_EXACT, "rei 90"), f"lower({_SQL[FIRE]}) = 'rei 90'"),
    "op_contains": (Condition(NAME, Op.CONTAINS, "Set 1"), f"strpos(lower({_SQL[NAME]}), 'set 1') > 0"),
    "op_contains_literal": (Condition(NAME, Op.CONTAINS, "l_ l%"), f"strpos(lower({_SQL[NAME]}), 'l_ l%') > 0"),
    "op_starts_with": (Condition(NAME, Op.STARTS_WITH, "wall"), f"strpos(lower({_SQL[NAME]}), 'wall') = 1"),
    "op_is_present": (Condition(PTYPE, Op.IS_PRESENT), f"coalesce({_SQL[PTYPE]} <> '', false)"),
    "op_is_missing": (Condition(PTYPE, Op.IS_MISSING), f"not coalesce({_SQL[PTYPE]} <> '', false)"),
    "op_measurement": (Condition(HEIGHT, Op.GT, 1), f"{_num(HEIGHT)} > 1"),
}
for _name, (_cond, _where) in _OPS.items():
    _add(_name, lambda s, d, c=_cond: _ents(s, d).where(compile_tree(c)).groupBy("source_model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")), f"select source_model_id, count(*) as n, cast(sum(id) as bigint) as id_sum from ifc_entities where {_where} group by 1")

_add(
    "numeric_guard",
    lambda s, d: _ents(s, d).agg(F.count(FL.as_text(WIDTH)).alias("texts"), F.count(FL.as_number(WIDTH)).alias("numbers"), F.round(F.sum(FL.as_number(WIDTH)), 3).alias("total")),
    f"select count({_SQL[WIDTH]}) as texts, count({_num(WIDTH)}) as numbers, round(sum({_num(WIDTH)}), 3) as total from ifc_entities",
)

# --- lists, points, identities
_HYDRATED = f"id, global_id, ifc_class, {_SQL[NAME]} as name, {_SQL[STOREY]} as storey_name, nullif(concat_ws(' ', nullif({_SQL[NAME]}, ''), 'on ' || nullif({_SQL[STOREY]}, '')), '') as summary"
_add(
    "list_sorted_limit_offset",
    lambda s, d: E.list_entities(_ents(s, d), ListPlan(Scope(MODEL, ("IfcWall",)), sort=(SortKey(NAME, descending=True),), limit=20, offset=5)),
    f"select {_HYDRATED}, (select count(*) from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcWall') as exact_total from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcWall' order by {_SQL[NAME]} desc nulls last, id limit 20 offset 5",
)
_add(
    "list_sorted_numeric",
    lambda s, d: E.list_entities(_ents(s, d), ListPlan(Scope(MODEL), Condition(STEP, Op.GT, 0), (SortKey(STEP, numeric=True),), 30)),
    f"select {_HYDRATED}, (select count(*) from ifc_entities where source_model_id = {MODEL} and step_id > 0) as exact_total from ifc_entities where source_model_id = {MODEL} and step_id > 0 order by step_id, id limit 30",
)
_add("get_entity_by_id", lambda s, d: E.get_entity(_ents(s, d), MODEL, entity_id=1016).select("id", "global_id", "ifc_class"), f"select id, global_id, ifc_class from ifc_entities where source_model_id = {MODEL} and id = 1016")
_add(
    "get_selected_entities",
    lambda s, d: E.select_by_ids(_ents(s, d), MODEL, s.createDataFrame([(i,) for i in (1001, 1002, 1016, 999999999)], "id long")).select("id", "global_id"),
    f"select id, global_id from ifc_entities where source_model_id = {MODEL} and id in (1001, 1002, 1016, 999999999)",
)
_add(
    "identities_with_total",
    lambda s, d: E.identities(matching(_ents(s, d), Scope(MODEL), Condition(STOREY, Op.IS_PRESENT))),
    f"select id, global_id, ifc_class, t.exact_total, t.exact_total > 2000 as truncated from (select * from ifc_entities where source_model_id = {MODEL} and coalesce({_SQL[STOREY]} <> '', false) order by id limit 2000) e cross join (select count(*) as exact_total from ifc_entities where source_model_id = {MODEL} and coalesce({_SQL[STOREY]} <> '', false)) t",
)
_add("highlight_type_name", lambda s, d: E.same_type(_ents(s, d), Scope(MODEL), type_name=" t-002 ").select("id"), f"select id from ifc_entities where source_model_id = {MODEL} and lower(trim({_SQL[TYPE]})) = 't-002'")
_add("highlight_property", lambda s, d: E.same_property(_ents(s, d), Scope(MODEL), FIRE, "rei 90 ").select("id"), f"select id from ifc_entities where source_model_id = {MODEL} and lower(trim({_SQL[FIRE]})) = 'rei 90'")
_SELECT = ["2H_lRmEQgaUOJXBRoQsBHR", " 3ZQeSlLFq$ndRw9viSyhIs ", None, "", "2H_lRmEQgaUOJXBRoQsBHR", "01cv2tV8OaZknX$NWfdmqc", "missing"]
_add(
    "resolve_selection_order",
    lambda s, d: E.resolve_selection(_ents(s, d), MODEL, _SELECT),
    f"select pos, global_id, min(id) as id, arg_min(ifc_class, id) as ifc_class from ifc_entities join (values (0::int, '2H_lRmEQgaUOJXBRoQsBHR'), (1, '3ZQeSlLFq$ndRw9viSyhIs'), (2, '01cv2tV8OaZknX$NWfdmqc')) v(pos, global_id) using (global_id) where source_model_id = {MODEL} group by 1, 2",
)

# --- aggregates, groups, missing values
for _f in ("sum", "min", "max", "average"):
    _add(
        f"agg_{_f}_with_coverage",
        lambda s, d, f=_f: E.aggregate_entities(_ents(s, d), AggregatePlan(Scope(MODEL, ("IfcWall",)), f, WIDTH)).withColumn("value", F.round("value", 4)),
        f"select round({'avg' if _f == 'average' else _f}({_num(WIDTH)}), 4) as value, count(*) as matched, count({_num(WIDTH)}) as coverage from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcWall'",
    )
_add(
    "group_count_topn",
    lambda s, d: E.group_entities(_ents(s, d), AggregatePlan(Scope(MODEL), "count", group_by=STOREY, limit=10)),
    f"select {_SQL[STOREY]} as key, count(*) as n from ifc_entities where source_model_id = {MODEL} group by 1 order by n desc, key nulls last limit 10",
)
_add(
    "group_avg_topn",
    lambda s, d: E.group_entities(_ents(s, d), AggregatePlan(Scope(MODEL), "average", THERMAL, group_by=STOREY, limit=10)).withColumn("value", F.round("value", 4)),
    f"select {_SQL[STOREY]} as key, count(*) as n, round(avg({_num(THERMAL)}), 4) as value, count({_num(THERMAL)}) as coverage from ifc_entities where source_model_id = {MODEL} group by 1 order by n desc, key nulls last limit 10",
)
_STATE = "case when {t} is not null and {t} <> '' then 'present' when {t} is not null then 'present_empty' when json_exists(canonical_json, '{p}') then 'present_null' else 'absent' end"
_PSTATE = _STATE.format(t=_SQL[PTYPE], p="$.meta.predefined_type")
_LSTATE = _STATE.format(t=_SQL[LOAD], p="$.property_sets.Pset_WallCommon.LoadBearing.value")
_add("missing_states", lambda s, d: E.missing_values(_ents(s, d), Scope(MODEL), PTYPE), f"select {_PSTATE} as state, count(*) as n from ifc_entities where source_model_id = {MODEL} group by 1")
_add("missing_states_property", lambda s, d: E.missing_values(_ents(s, d), Scope(MODEL, ("IfcWall",)), LOAD), f"select {_LSTATE} as state, count(*) as n from ifc_entities where source_model_id = {MODEL} and ifc_class = 'IfcWall' group by 1")
_add(
    "missing_examples_topk",
    lambda s, d: E.missing_examples(_ents(s, d), Scope(MODEL), PTYPE).select("state", "id"),
    f"select state, id from (select {_PSTATE} as state, id, row_number() over (partition by {_PSTATE} order by id) as nth from ifc_entities where source_model_id = {MODEL}) where state <> 'present' and nth <= 3",
)

# --- catalog
_CAT = """
select m.id as source_model_id, m.file_name, m.ifc_schema, f.family_key, e.version_label, e.version_order, e.is_current, e.status,
  coalesce(e.display_name, 'Model ' || m.id) as display_name
from ifc_source_models m left join source_model_catalog_entries e on e.source_model_id = m.id left join model_families f on f.id = e.model_family_id
"""
_CCOLS = ["source_model_id", "file_name", "ifc_schema", "family_key", "version_label", "version_order", "is_current", "status", "display_name"]
_add("catalog_list", lambda s, d: C.list_models(_cat(s, d)).select(*_CCOLS), f"select * from ({_CAT}) order by source_model_id limit 50")
_add(
    "catalog_filter",
    lambda s, d: C.filter_models(_cat(s, d), "and", [("status", Op.EQ, "available"), ("display_name", Op.CONTAINS, "e")]).select(*_CCOLS),
    f"select * from ({_CAT}) where status = 'available' and strpos(lower(display_name), 'e') > 0",
)
_FAMILY = "select min(family_key) from model_families where id in (select model_family_id from source_model_catalog_entries)"


def _versions(s: SparkSession, d: str) -> DataFrame:
    used = table(s, d, "source_model_catalog_entries").select(F.col("model_family_id").alias("id")).distinct()
    key = table(s, d, "model_families").join(used, "id", "left_semi").agg(F.min("family_key")).first()[0]
    return C.list_versions(_cat(s, d), key).select(*_CCOLS)


_add("catalog_versions", _versions, f"select * from ({_CAT}) where family_key = ({_FAMILY}) order by version_order nulls last")
_add(
    "rank_models_by_count",
    lambda s, d: C.rank_by_entities(_cat(s, d), _ents(s, d)).select("source_model_id", "display_name", "n_entities"),
    f"select source_model_id, display_name, n_entities from ({_CAT}) join (select source_model_id, count(*) as n_entities from ifc_entities group by 1) using (source_model_id) order by n_entities desc, source_model_id limit 50",
)
_add("get_model_metadata", lambda s, d: C.metadata(_cat(s, d), MODEL).select(*_CCOLS), f"select * from ({_CAT}) where source_model_id = {MODEL}")
_add(
    "catalog_describe",
    lambda s, d: C.describe(_cat(s, d)),
    f"select source_model_id, concat_ws(' — ', display_name || ' (id ' || source_model_id || ')', nullif(version_label, ''), case when is_current then 'current version' end, status, ifc_schema) as line from ({_CAT})",
)
_add("catalog_current_conflicts", lambda s, d: C.current_conflicts(_cat(s, d)), f"select family_key, count(*) as n_current from ({_CAT}) where is_current and family_key is not null group by 1 having count(*) > 1")
