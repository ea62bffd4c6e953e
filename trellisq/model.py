"""Plan objects: field references, filter trees, typed operation plans and their bounds."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

MAX_CONDITIONS = 20
MAX_DEPTH = 3
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
MAX_IN = 50
MAX_SORT_KEYS = 5
MAX_TEXT = 500
DEFAULT_HOPS, MAX_HOPS = 1, 3
MAX_SELECTED = 50


class PlanError(ValueError):
    """A plan that may not be run."""


class FieldKind(str, Enum):
    ATTRIBUTE = "attribute"
    TYPE_FACT = "type_fact"
    PROPERTY = "property"
    QUANTITY = "quantity"
    MEASUREMENT = "measurement"
    DIMENSION = "dimension"


class Op(str, Enum):
    EQ = "eq"
    NE = "ne"
    GT = "gt"
    GTE = "gte"
    LT = "lt"
    LTE = "lte"
    BETWEEN = "between"
    IN = "in"
    NOT_IN = "not_in"
    EXACT = "exact"
    CI_EXACT = "case_insensitive_exact"
    CONTAINS = "contains"
    STARTS_WITH = "starts_with"
    IS_PRESENT = "is_present"
    IS_MISSING = "is_missing"


TEXT_OPS = {Op.EXACT, Op.CI_EXACT, Op.CONTAINS, Op.STARTS_WITH}
UNARY_OPS = {Op.IS_PRESENT, Op.IS_MISSING}
SET_OPS = {Op.IN, Op.NOT_IN}


class AmbiguousField(PlanError):
    def __init__(self, name: str, candidates: list[str]):
        super().__init__(f"{name} is in several sets: {', '.join(candidates)}")
        self.candidates = candidates


@dataclass(frozen=True)
class FieldRef:
    """The only way to name a field: kind, set (where the kind has sets) and name."""

    kind: FieldKind
    name: str
    set_name: str | None = None

    def __post_init__(self) -> None:
        needs_set = self.kind in (FieldKind.PROPERTY, FieldKind.QUANTITY)
        if needs_set and not self.set_name:
            raise PlanError(f"{self.kind.value} needs a set name")
        if not needs_set and self.set_name:
            raise PlanError(f"{self.kind.value} takes no set name")
        if not self.name:
            raise PlanError("a field needs a name")


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Condition:
    field: FieldRef
    op: Op
    value: object = None

    def __post_init__(self) -> None:
        v = self.value
        if self.op in UNARY_OPS:
            ok = v is None
        elif self.op in SET_OPS:
            ok = isinstance(v, (list, tuple)) and 1 <= len(v) <= MAX_IN and all(isinstance(x, str) or _is_number(x) for x in v)
        elif self.op is Op.BETWEEN:
            ok = isinstance(v, (list, tuple)) and len(v) == 2 and all(_is_number(x) for x in v) and v[0] <= v[1]
        elif self.op in TEXT_OPS:
            ok = isinstance(v, str)
        else:
            ok = isinstance(v, str) or _is_number(v)
        if not ok:
            raise PlanError(f"{self.op.value} can't take {v!r}")


@dataclass(frozen=True)
class Group:
    """AND or OR over conditions and groups; at most 20 conditions and 3 levels."""

    op: str
    items: tuple

    def __post_init__(self) -> None:
        if self.op not in ("and", "or") or not self.items:
            raise PlanError("a group is 'and' or 'or' over at least one item")
        n, depth = _measure(self)
        if n > MAX_CONDITIONS or depth > MAX_DEPTH:
            raise PlanError(f"{n} conditions on {depth} levels; at most {MAX_CONDITIONS} and {MAX_DEPTH}")


def _measure(node: Condition | Group) -> tuple[int, int]:
    if isinstance(node, Condition):
        return 1, 0
    parts = [_measure(x) for x in node.items]
    return sum(p[0] for p in parts), 1 + max(p[1] for p in parts)


@dataclass(frozen=True)
class Scope:
    """Base scope of every query: one model and its classes (none given: all of them).

    ids restrict further: None leaves the scope as it is, an empty tuple leaves nothing.
    """

    model: int
    classes: tuple[str, ...] = ()
    ids: tuple[int, ...] | None = None


@dataclass(frozen=True)
class SortKey:
    field: FieldRef
    descending: bool = False
    numeric: bool = False


@dataclass(frozen=True)
class ListPlan:
    scope: Scope
    where: Condition | Group | None = None
    sort: tuple[SortKey, ...] = ()
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAX_LIMIT or self.offset < 0 or len(self.sort) > MAX_SORT_KEYS:
            raise PlanError("limit 1 to 500, offset from 0, at most 5 sort keys")


@dataclass(frozen=True)
class AggregatePlan:
    scope: Scope
    function: str
    field: FieldRef | None = None
    where: Condition | Group | None = None
    group_by: FieldRef | None = None
    limit: int = DEFAULT_LIMIT

    def __post_init__(self) -> None:
        if self.function not in ("count", "sum", "min", "max", "average"):
            raise PlanError(f"no aggregate {self.function}")
        if (self.function == "count") != (self.field is None):
            raise PlanError("count takes no field, every other aggregate needs one")
