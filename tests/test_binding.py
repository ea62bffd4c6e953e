import pytest

from trellisq.model import FieldKind, FieldRef, Op
from trellisq.operators.unit_rules import FieldUnits
from trellisq.plans import binding as B
from trellisq.plans import spans as S

NAME = FieldRef(FieldKind.ATTRIBUTE, "name")
TAG = FieldRef(FieldKind.ATTRIBUTE, "tag")
MM = FieldUnits("uniform", "mm")


def kinds(text):
    return [(s.kind.value, s.text) for s in S.detect(text)]


def test_spans():
    assert kinds("doors wider than 900 mm on the 2nd floor?") == [("comparison", "wider than"), ("numeric_bound", "900"), ("unit", "mm"), ("floor_reference", "2nd floor")]
    assert kinds("which of those are 'EI 60'") == [("previous_result_reference", "of those"), ("quoted_value", "'EI 60'")]
    assert kinds("walls without a name in this building") == [("negation", "without"), ("scope_reference", "this building")]
    assert kinds("the selected objects") == [("selection_reference", "selected")] and kinds("") == [] and kinds(None) == []
    assert len(S.detect("1 2 3 4 5 " * 20)) == 24
    assert not next(s for s in S.detect("this model")).material


def test_ledger_and_account():
    items = S.ledger("How many doors are wider than 900 mm?", ("storey is L1",))
    assert [(i.item_id, i.role.value, i.text) for i in items] == [("L1", "subject", "doors"), ("L2", "condition", "wider than"), ("L3", "condition", "900"), ("S1", "condition", "storey is L1")]
    full = {"L1": "bound_subject", "L2": "bound_condition", "L3": "redundant_with", "S1": "bound_condition"}
    assert S.uncovered(items, full) == []
    assert len(S.uncovered(items, {**full, "L2": "bound_output"})) == 1 and len(S.uncovered(items, {"L1": "bound_subject"})) == 3 and len(S.uncovered(items, {**full, "X": "bound_scope"})) == 1


def cond(i, op, value=None, field=NAME, **more):
    return B.BoundCondition(f"c{i}", field, op, value, source="x", **more)


def part(op=B.Operation.COUNT, *conditions, classes=("IfcWall",), **more):
    return B.Part("p1", op, classes, conditions, **more)


@pytest.fixture
def ctx(entities):
    rows = [(1, "IfcWall", {"identity": {"name": "a", "tag": "10"}}), (2, "IfcWall", {"identity": {"name": "b", "tag": "20"}}), (3, "IfcWall", {"identity": {"name": "c"}}), (4, "IfcDoor", {"identity": {"name": "a"}})]
    return B.Context(1, entities(rows), units={TAG: MM}, values={NAME: ["a", "b", "c"]})


def test_gate():
    p = part()
    items = S.ledger("doors over 5 m")
    ok = {i.item_id: "bound_condition" if i.role is S.Role.CONDITION else "bound_subject" for i in items}
    assert B.gate([p], items, ok)[0] is B.Gate.READY
    assert B.gate([p], items, {})[0] is B.Gate.RECOVERABLE
    assert B.gate([p], items, {**ok, "L1": "ambiguous"})[0] is B.Gate.CLARIFY
    assert B.gate([p], items, ok, has_profile=False)[0] is B.Gate.NO_DATA
    invented = B.Part("p1", B.Operation.COUNT, ("IfcWall",), (B.BoundCondition("c1", NAME, Op.EQ, "a"),))
    assert B.gate([invented], items, ok)[0] is B.Gate.INVALID
    assert B.validate([p, p]) and B.validate([]) and B.validate([part(B.Operation.AGGREGATE)])


def test_counts_share_one_predicate(ctx):
    r = B.execute(part(B.Operation.COUNT, classes=("IfcWall", "IfcDoor")), ctx)
    assert (r.status, r.total, r.breakdown, r.rows.count()) == (B.Status.EXACT, 4, {"IfcWall": 3, "IfcDoor": 1}, 3)
    p = part(B.Operation.LIST, cond(1, Op.NE, "a"))
    r = B.execute(p, ctx)
    assert r.total == 2 and {x.id for x in r.rows.collect()} == {2, 3}
    assert {x.id for x in B.viewer(p, ctx).collect()} == {2, 3} and B.presentation(r, 2) == "table"


@pytest.mark.parametrize(
    "c,ids",
    [(cond(1, Op.EQ, "a", negated=True), {2, 3}), (cond(1, Op.IN, ("a", "b"), negated=True), {3}), (cond(1, Op.GT, 15, TAG, negated=True), {1}), (cond(1, Op.BETWEEN, (5, 15), TAG, negated=True), {2}), (cond(1, Op.IS_PRESENT, None, TAG, negated=True), {3})],
)
def test_negation_holds_everywhere(ctx, c, ids):
    assert {x.id for x in B.execute(part(B.Operation.LIST, c), ctx).rows.collect()} == ids


def test_or_groups(ctx):
    r = B.execute(part(B.Operation.LIST, cond(1, Op.EQ, "a", group="g"), cond(2, Op.EQ, "b", group="g"), cond(3, Op.LT, 15, TAG)), ctx)
    assert {x.id for x in r.rows.collect()} == {1}


def test_statuses(ctx):
    status = lambda *c, **m: B.execute(part(B.Operation.COUNT, *c, **m), ctx)
    assert status(cond(1, Op.EQ, "nope")).status is B.Status.UNAVAILABLE and status(cond(1, Op.EQ, "nope")).total is None
    assert status(cond(1, Op.EQ, "nope"), classes=()).status is B.Status.UNAVAILABLE
    assert (status(classes=()).status, status(classes=()).reason) == (B.Status.ZERO, B.ABSENT)
    assert status(scope_ids=()).reason == B.EMPTY_SCOPE
    assert status(cond(1, Op.GT, 500, TAG)).reason == B.NO_MATCH
    assert status(cond(1, Op.GT, 5, TAG, unit="m")).status is B.Status.UNAVAILABLE and status(cond(1, Op.GT, 5, TAG, unit="millimetres")).notes
    assert B.classify(0, no_values=True)[0] is B.Status.UNAVAILABLE


def test_measures(ctx):
    r = B.execute(part(B.Operation.AGGREGATE, field=TAG), ctx)
    assert (r.status, r.value, r.coverage, r.unit) == (B.Status.PARTIAL, 30.0, 2, "mm")
    assert B.execute(part(B.Operation.EXTREMUM, field=TAG, function="min"), ctx).value == 10.0
    assert B.execute(part(B.Operation.AGGREGATE, field=TAG, classes=("IfcDoor",)), ctx).status is B.Status.UNAVAILABLE
    g = B.execute(part(B.Operation.GROUPS, field=NAME, classes=("IfcWall", "IfcDoor")), ctx)
    assert [(x.key, x.n) for x in g.rows.collect()] == [("a", 2), ("b", 1), ("c", 1)] and B.presentation(g, 4) == "bar"
    assert B.presentation(r, 3) is None


def test_follow_up(ctx):
    first = part(B.Operation.LIST, cond(1, Op.NE, "c"))
    prev = B.PreviousScope(first)
    assert {r.id for r in prev.rows(ctx).collect()} == {1, 2}
    r = B.execute(prev.narrowed((cond(1, Op.EQ, "b"),), "p2", B.Operation.COUNT), ctx)
    assert r.total == 1
    store = B.SessionStore(2)
    for i in range(3):
        store.accept("s", first, f"m{i}")
    assert store.get("s")["messages"] == ["m1", "m2"] and store.get("s")["previous"] == prev
    store.reset("s")
    assert store.get("s")["previous"] is None


def test_answers(ctx):
    calls = []

    def bind(question, items, problems):
        calls.append(problems)
        full = {i.item_id: "bound_subject" if i.role is S.Role.SUBJECT else "bound_condition" for i in items}
        return [part(B.Operation.COUNT, cond(1, Op.EQ, "A"))], full if problems else {}

    state, results, text = B.answer("walls called 'A'", ctx, bind, lambda q, f: ("There are 9.", [("p1.1", 9)]))
    assert state is B.Gate.READY and len(calls) == 2 and results[0].total == 1 and "total 1" in text
    _, _, text = B.answer("walls called 'A'", ctx, bind, lambda q, f: ("There is one.", [("p1.1", 1)]))
    assert text == "There is one."
    facts = B.packet([B.Result("p1", B.Operation.AGGREGATE, B.Status.PARTIAL, "2 of 3", 3, value=1.5, coverage=2)])
    assert B.check_answer(facts, "In total 1.5", []) and B.check_answer(facts, "about 1.5", [("p1.2", 1.5000001)]) == [] and B.check_answer(facts, "x", [("p9.1", 1)])
    assert B.cost({"in": 1_000_000, "out": None}, {"in": 1.0, "out": 2.0}) is None and B.cost({"in": 500_000}, {"in": 2.0}) == 1.0
