import pytest
from pyspark.sql import functions as F

from trellisq.model import AggregatePlan, AmbiguousField, Condition, FieldKind, FieldRef, Group, ListPlan, Op, PlanError, Scope, SortKey
from trellisq.operators import entities as E
from trellisq.operators import fields as FL
from trellisq.operators.predicate import compile_catalog, compile_tree, matching

NAME = FieldRef(FieldKind.ATTRIBUTE, "name")
TAG = FieldRef(FieldKind.ATTRIBUTE, "tag")
WIDTH = FieldRef(FieldKind.QUANTITY, "Width", "Q")


def named(*names):
    return [(i + 1, "IfcWall", {"identity": {"name": n}}) for i, n in enumerate(names)]


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    "op,value,want",
    [
        (Op.CONTAINS, "%", [1]), (Op.CONTAINS, "_", [2]), (Op.CONTAINS, "'", [3]), (Op.CONTAINS, "ÉT", [4]), (Op.CONTAINS, "", [1, 2, 3, 4, 5]), (Op.STARTS_WITH, "ab", [1, 2]),
        (Op.CI_EXACT, "AB_C", [2]), (Op.EXACT, "AB_C", []), (Op.NE, "ab_c", [1, 3, 4, 5]), (Op.NOT_IN, ("ab_c", "x"), [1, 3, 4, 5]), (Op.IS_MISSING, None, [5, 6]), (Op.IS_PRESENT, None, [1, 2, 3, 4]),
    ],
)
def test_text_operators(entities, op, value, want):
    rows = entities(named("ab%c", "ab_c", "o'x", "étage", "", None))
    assert ids(rows.where(compile_tree(Condition(NAME, op, value)))) == want


def test_numbers_are_guarded(entities):
    texts = ["12", "-3.5", "1e5", ".5", " 7", "1,5", "EI30", "nan", "", None, "12\n"]
    rows = entities([(i, "IfcWall", {"identity": {"tag": t}}) for i, t in enumerate(texts)])
    got = {r.id: r.x for r in rows.select("id", FL.as_number(TAG).alias("x")).collect()}
    assert got[0] == 12 and got[1] == -3.5 and all(got[i] is None for i in range(2, 11))


def test_states_add_up(entities):
    rows = entities([(1, "IfcWall", {"identity": {}}), (2, "IfcWall", {"identity": {"name": None}}), (3, "IfcWall", {"identity": {"name": ""}}), (4, "IfcWall", {"identity": {"name": "x"}}), (5, "IfcWall", {}), (6, "IfcWall", None), (7, "IfcWall", "not json")])
    got = {r.state: r.n for r in E.missing_values(rows, Scope(1), NAME).collect()}
    assert got == {"absent": 4, "present_null": 1, "present_empty": 1, "present": 1}
    assert E.missing_examples(rows, Scope(1), NAME, 2).where("state = 'absent'").count() == 2
    present = matching(rows, Scope(1), Condition(NAME, Op.IS_PRESENT)).count()
    assert present + matching(rows, Scope(1), Condition(NAME, Op.IS_MISSING)).count() == 7


def test_scope_ids_and_groups(entities):
    rows = entities(named("a", "b", "c"))
    assert matching(rows, Scope(1, ids=())).count() == 0
    assert matching(rows, Scope(1, ids=(1, 9))).count() == 1
    assert matching(rows, Scope(2)).count() == 0
    assert ids(matching(rows, Scope(1), Group("or", (Condition(NAME, Op.EQ, "a"), Condition(NAME, Op.EQ, "c"))))) == [1, 3]


def test_aggregates_tell_coverage(entities):
    rows = entities([(1, "IfcWall", {"quantity_sets": {"Q": {"Width": {"value": 2.0}}}}), (2, "IfcWall", {"quantity_sets": {"Q": {"Width": {"value": "3"}}}}), (3, "IfcWall", {}), (4, "IfcDoor", {})])
    r = E.aggregate_entities(rows, AggregatePlan(Scope(1, ("IfcWall",)), "sum", WIDTH)).first()
    assert (r.value, r.matched, r.coverage) == (5.0, 3, 2)
    r = E.aggregate_entities(rows, AggregatePlan(Scope(1, ("IfcDoor",)), "sum", WIDTH)).first()
    assert (r.value, r.matched, r.coverage) == (None, 1, 0)
    g = E.group_entities(rows, AggregatePlan(Scope(1), "average", WIDTH, group_by=FieldRef(FieldKind.ATTRIBUTE, "ifc_class"))).collect()
    assert [(x.key, x.n, x.value) for x in g] == [("IfcWall", 3, 2.5), ("IfcDoor", 1, None)]


def test_list_keeps_the_exact_total(entities):
    rows = entities(named("b", "a", None, "c"))
    page = E.list_entities(rows, ListPlan(Scope(1), sort=(SortKey(NAME),), limit=2, offset=1)).collect()
    assert [r.name for r in page] == ["b", "c"] and page[0].exact_total == 4
    assert E.identities(rows, 2).where("truncated").count() == 2


def test_points_selection_and_types(entities):
    rows = entities([(1, "IfcWall", {"type": {"name": " T-1 "}}), (2, "IfcWall", {"type": {"name": "t-1"}}), (3, "IfcWall", {"type": None})])
    with pytest.raises(PlanError):
        E.get_entity(rows, 1)
    assert ids(E.same_type(rows, Scope(1), type_name="T-1")) == [1, 2]
    picked = E.resolve_selection(rows, 1, [" g3", None, "g1", "g3", "nope", " "]).collect()
    assert [(r.pos, r.id) for r in picked] == [(0, 3), (1, 1)]


def test_long_fields_keep_nulls_and_skip_texts(entities):
    rows = entities([(1, "IfcWall", {"property_sets": {"A": {"x": {"value": None}, "y": {"value": 1}}, "B": "unreadable"}, "quantity_sets": {"Q": {"Width": {"value": 1}}, "R": {"Width": {"value": 2}}}, "measurements": {"H": {"value": 2.5}}}), (2, "IfcWall", None)])
    f = FL.entity_fields(rows)
    assert {(r.section, r.set_name, r.field_name, r.value) for r in f.collect()} == {("property_sets", "A", "x", None), ("property_sets", "A", "y", "1"), ("quantity_sets", "Q", "Width", "1"), ("quantity_sets", "R", "Width", "2"), ("measurements", None, "H", "2.5")}
    summary = FL.field_summary(f)
    with pytest.raises(AmbiguousField) as e:
        FL.resolve_dimension(summary, 1, "Width")
    assert e.value.candidates == ["Q", "R"]
    with pytest.raises(PlanError):
        FL.resolve_dimension(summary, 1, "Depth")


def test_catalog_filter_is_restricted():
    with pytest.raises(PlanError):
        compile_catalog("and", [("file_name", Op.EQ, "x")])
    with pytest.raises(PlanError):
        compile_catalog("and", [("status", Op.GT, "x")])


def test_injection_is_text(entities):
    rows = entities(named("a"))
    assert rows.where(compile_tree(Condition(NAME, Op.EQ, "' or 1=1 --"))).count() == 0
    assert rows.where(compile_tree(Condition(NAME, Op.IN, ("x') or ('1'='1",)))).agg(F.count("*")).first()[0] == 0


def test_large_scopes_are_joined(spark, entities):
    from trellisq.operators.predicate import in_scope

    rows = entities([(i, "IfcWall", {}) for i in range(5)])
    big = in_scope(rows, Scope(1, ids=tuple(range(3, 3000))))
    assert {r.id for r in big.collect()} == {3, 4} and big.columns == rows.columns
    assert {r.id for r in in_scope(rows, Scope(1, ids=(2,))).collect()} == {2}
