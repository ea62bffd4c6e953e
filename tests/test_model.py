import pytest

from trellisq.model import AggregatePlan, Condition, FieldKind, FieldRef, Group, ListPlan, Op, PlanError, Scope

NAME = FieldRef(FieldKind.ATTRIBUTE, "name")


@pytest.mark.parametrize("op,value", [(Op.BETWEEN, (2, 1)), (Op.BETWEEN, ("a", "b")), (Op.IN, ()), (Op.IN, tuple(range(51))), (Op.IS_PRESENT, 1), (Op.CONTAINS, 5), (Op.EQ, None), (Op.GT, True)])
def test_values_of_operators(op, value):
    with pytest.raises(PlanError):
        Condition(NAME, op, value)


def test_tree_bounds():
    c = Condition(NAME, Op.EQ, "x")
    Group("and", (c,) * 20)
    with pytest.raises(PlanError):
        Group("and", (c,) * 21)
    deep = Group("or", (Group("and", (Group("or", (c,)),)),))
    with pytest.raises(PlanError):
        Group("and", (deep,))
    with pytest.raises(PlanError):
        Group("xor", (c,))


def test_fields_and_plans():
    with pytest.raises(PlanError):
        FieldRef(FieldKind.PROPERTY, "x")
    with pytest.raises(PlanError):
        FieldRef(FieldKind.ATTRIBUTE, "x", "set")
    with pytest.raises(PlanError):
        ListPlan(Scope(1), limit=501)
    with pytest.raises(PlanError):
        AggregatePlan(Scope(1), "sum")
    with pytest.raises(PlanError):
        AggregatePlan(Scope(1), "median", NAME)
