"""The expression compiler: filter trees to Columns. One predicate serves counts, breakdowns, examples and scopes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.model import MAX_TEXT, Condition, FieldKind, Group, Op, PlanError, Scope
from trellisq.operators import fields


def compile_tree(node: Condition | Group | None) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, Group):
        parts = [compile_tree(x) for x in node.items]
        return functools.reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)
    return compile_condition(node, fields.as_text(node.field), fields.usable(node.field))


def compile_condition(c: Condition, text: Column, usable: Column) -> Column:
    """A condition over a text column. Text operands compare as text, numbers as guarded numbers; null never matches ne."""
    cut = lambda v: v[:MAX_TEXT] if isinstance(v, str) else v
    v = [cut(x) for x in c.value] if isinstance(c.value, (list, tuple)) else cut(c.value)
    if c.op is Op.IS_PRESENT:
        return usable
    if c.op is Op.IS_MISSING:
        return ~usable
    if c.op is Op.EXACT:
        return text == F.lit(v)
    if c.op is Op.CI_EXACT:
        return F.lower(text) == F.lower(F.lit(v))
    if c.op in (Op.CONTAINS, Op.STARTS_WITH):
        at = F.instr(F.lower(text), F.lower(F.lit(v)))
        return at > 0 if c.op is Op.CONTAINS else at == 1
    number = fields.guarded_number(text)
    if c.op is Op.BETWEEN:
        return number.between(float(v[0]), float(v[1]))
    if c.op in (Op.IN, Op.NOT_IN):
        strings = [isinstance(x, str) for x in v]
        if any(strings) and not all(strings):
            raise PlanError("a list is of texts or of numbers")
        left = text if all(strings) else number
        inside = left.isin(v if all(strings) else [float(x) for x in v])
        return inside if c.op is Op.IN else left.isNotNull() & ~inside
    left = text if isinstance(v, str) else number
    right = F.lit(v if isinstance(v, str) else float(v))
    return {Op.EQ: left == right, Op.NE: left != right, Op.GT: left > right, Op.GTE: left >= right, Op.LT: left < right, Op.LTE: left <= right}[c.op]


def in_scope(rows: DataFrame, scope: Scope) -> DataFrame:
    """Rows of the scope. The model comes first so that partitions are pruned by it."""
    out = rows.where(F.col("source_model_id") == scope.model)
    if scope.classes:
        out = out.where(F.col("ifc_class").isin(list(scope.classes)))
    if scope.ids is not None:
        if not scope.ids:
            return out.where(F.lit(False))
        if len(scope.ids) <= MAX_LITERALS:
            return out.where(F.col("id").isin(list(scope.ids)))
        ids = rows.sparkSession.createDataFrame([(i,) for i in set(scope.ids)], "id long")
        out = out.join(ids, "id", "left_semi").select(rows.columns)
    return out


def matching(rows: DataFrame, scope: Scope, where: Condition | Group | None = None, within: DataFrame | None = None) -> DataFrame:
    """The one filtered frame that everything about an answer is taken from."""
    out = in_scope(rows, scope).where(compile_tree(where))
    return out if within is None else out.join(within.select("id").distinct(), "id", "left_semi")


#: Ids of a scope that are written into the predicate; more of them are joined.
MAX_LITERALS = 1000
CATALOG_COLUMNS = ("display_name", "version_label", "project_type", "discipline", "status", "family_key", "ifc_schema")
CATALOG_OPS = {Op.EQ, Op.EXACT, Op.NE, Op.CI_EXACT, Op.CONTAINS, Op.IN, Op.NOT_IN}


def compile_catalog(op: str, conditions: list[tuple[str, Op, object]]) -> Column:
    """A flat AND or OR over the allowed catalog columns."""
    parts = []
    for name, kind, value in conditions:
        if name not in CATALOG_COLUMNS or kind not in CATALOG_OPS:
            raise PlanError(f"the catalog can't be filtered by {name} {kind.value}")
        stand_in = Condition(fields.FieldRef(FieldKind.ATTRIBUTE, "name"), kind, value)
        parts.append(compile_condition(stand_in, F.col(name), F.lit(True)))
    if op not in ("and", "or") or not parts:
        raise PlanError("a flat 'and' or 'or' over at least one condition")
    return functools.reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
