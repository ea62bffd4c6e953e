"""Answer parts: from a bound request to one authoritative predicate and everything derived from it.

The provider calls (bind, answer) are callables that are passed in; all that is here is deterministic. A count,
its breakdown, its examples, a scope for vector search, graph seeds and viewer identities come from one
filtered frame, so they can't contradict each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.functions.lexical import resolve_value
from trellisq.model import MAX_LIMIT, Condition, FieldKind, FieldRef, Group, Op, PlanError, Scope
from trellisq.operators import entities as E
from trellisq.operators import fields as FL
from trellisq.operators import graph as G
from trellisq.operators import spatial as S
from trellisq.operators import vectors as V
from trellisq.operators.predicate import matching
from trellisq.operators.unit_rules import FieldUnits, decide
from trellisq.plans.spans import Item, uncovered

MAX_PARTS, MAX_PART_CONDITIONS, MAX_GROUPS = 8, 20, 8
EXAMPLES = 3
ABSENT = "this model has no objects of that kind; that says nothing of the real building"
EMPTY_SCOPE = "the scope holds no objects, so nothing can match"
NO_MATCH = "the whole model was searched and nothing matches"
NO_VALUES = "this model records no values of that field"


class Operation(str, Enum):
    COUNT = "count"
    EXISTENCE = "existence"
    LIST = "list"
    SAMPLE = "sample_detail"
    GROUPS = "group_distribution"
    AGGREGATE = "aggregate"
    EXTREMUM = "extremum"
    DESCRIPTION = "description"
    COMPARISON = "comparison"
    RELATIONSHIP = "relationship"


class Status(str, Enum):
    EXACT = "exact"
    ZERO = "zero"
    UNAVAILABLE = "unavailable"
    PARTIAL = "partial"
    AMBIGUOUS = "ambiguous"


class Gate(str, Enum):
    READY = "ready"
    RECOVERABLE = "recoverable_binding_gap"
    CLARIFY = "needs_clarification"
    NO_DATA = "model_data_unavailable"
    INVALID = "invalid"


MODES = {Operation.DESCRIPTION: ("sql", "scoped_rag"), Operation.COMPARISON: ("sql", "scoped_rag"), Operation.RELATIONSHIP: ("sql", "graph")}


@dataclass(frozen=True)
class BoundCondition:
    """A condition as bound: where it comes from must be named, or it is invented."""

    condition_id: str
    field: FieldRef
    op: Op
    value: object = None
    unit: str | None = None
    negated: bool = False
    group: str | None = None
    source: str | None = None
    inherited: bool = False


@dataclass(frozen=True)
class Part:
    part_id: str
    operation: Operation
    classes: tuple[str, ...]
    conditions: tuple[BoundCondition, ...] = ()
    field: FieldRef | None = None
    function: str | None = None
    scope_ids: tuple[int, ...] | None = None
    question: str = ""
    relationship_classes: tuple[str, ...] | None = None
    endpoint_classes: tuple[str, ...] = ()
    depth: int = 1
    limit: int = 50


@dataclass(frozen=True)
class Predicate:
    """The compiled request: scope and tree, or the reasons why it can't be run."""

    scope: Scope
    tree: Condition | Group | None
    unresolved: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    floor: tuple[str, int | None] | None = None


@dataclass
class Result:
    part_id: str
    operation: Operation
    status: Status
    reason: str | None = None
    total: int | None = None
    rows: DataFrame | None = None
    breakdown: dict[str, int] = field(default_factory=dict)
    value: float | None = None
    unit: str | None = None
    coverage: int | None = None
    notes: tuple[str, ...] = ()
    modes: tuple[str, ...] = ("sql",)
    graph: tuple[DataFrame, DataFrame] | None = None


@dataclass(frozen=True)
class Context:
    """The tables of one model and what profiles know of its fields."""

    model: int
    entities: DataFrame
    relationships: DataFrame | None = None
    members: DataFrame | None = None
    documents: DataFrame | None = None
    units: dict[FieldRef, FieldUnits] = field(default_factory=dict)
    values: dict[FieldRef, list[str]] = field(default_factory=dict)
    query_vector: list[float] | None = None


def validate(parts: list[Part]) -> list[str]:
    """Structural problems of a binding."""
    out = []
    if not 1 <= len(parts) <= MAX_PARTS:
        out.append(f"1 to {MAX_PARTS} parts")
    if len({p.part_id for p in parts}) != len(parts):
        out.append("part ids repeat")
    for p in parts:
        if len(p.conditions) > MAX_PART_CONDITIONS or len({c.group for c in p.conditions if c.group}) > MAX_GROUPS:
            out.append(f"{p.part_id}: too many conditions")
        if len({c.condition_id for c in p.conditions}) != len(p.conditions):
            out.append(f"{p.part_id}: condition ids repeat")
        out += [f"{p.part_id}: condition {c.condition_id} is invented" for c in p.conditions if not c.source and not c.inherited]
        if p.operation in (Operation.GROUPS, Operation.AGGREGATE, Operation.EXTREMUM) and p.operation is not Operation.GROUPS and p.field is None:
            out.append(f"{p.part_id}: {p.operation.value} needs a field")
        if p.function and p.function not in ("sum", "min", "max", "average"):
            out.append(f"{p.part_id}: no aggregate {p.function}")
        if not 0 <= p.depth <= 3 or not 1 <= p.limit <= MAX_LIMIT:
            out.append(f"{p.part_id}: depth 0 to 3, limit 1 to {MAX_LIMIT}")
    return out


def gate(parts: list[Part], items: list[Item], dispositions: dict[str, str], has_profile: bool = True) -> tuple[Gate, list[str]]:
    """Whether a binding may run, may be corrected once, needs a question back or is wrong."""
    if not has_profile:
        return Gate.NO_DATA, ["the model has no profile"]
    if problems := validate(parts):
        return Gate.INVALID, problems
    if problems := uncovered(items, dispositions):
        return Gate.RECOVERABLE, problems
    unclear = [i.text for i in items if dispositions.get(i.item_id) == "ambiguous"]
    return (Gate.CLARIFY, unclear) if unclear else (Gate.READY, [])


NUMERIC_OPS = {Op.GT, Op.GTE, Op.LT, Op.LTE, Op.BETWEEN}
INVERSE = {Op.EQ: Op.NE, Op.NE: Op.EQ, Op.IN: Op.NOT_IN, Op.NOT_IN: Op.IN, Op.IS_PRESENT: Op.IS_MISSING, Op.IS_MISSING: Op.IS_PRESENT, Op.GT: Op.LTE, Op.LTE: Op.GT, Op.LT: Op.GTE, Op.GTE: Op.LT}


def compile_part(part: Part, ctx: Context) -> Predicate:
    """One predicate for a part. What can't be resolved is named, never dropped; negation holds for every operator."""
    plain: list[Condition | Group] = []
    groups: dict[str, list] = {}
    unresolved: list[str] = []
    notes: list[str] = []
    for c in part.conditions:
        try:
            made = _compile(c, ctx, notes)
        except PlanError as e:
            unresolved.append(str(e))
            continue
        (groups.setdefault(c.group, []) if c.group else plain).append(made)
    plain += [g[0] if len(g) == 1 else Group("or", tuple(g)) for g in groups.values()]
    tree = None if not plain else plain[0] if len(plain) == 1 else Group("and", tuple(plain))
    return Predicate(Scope(ctx.model, part.classes, part.scope_ids), tree, tuple(unresolved), tuple(notes))


def _compile(c: BoundCondition, ctx: Context, notes: list[str]) -> Condition | Group:
    value, op = c.value, c.op
    number = op in NUMERIC_OPS or (isinstance(value, (int, float)) and not isinstance(value, bool))
    if number:
        decision = decide(c.field.name, ctx.units.get(c.field, FieldUnits()), c.unit)
        if not decision.ok:
            raise PlanError(decision.note)
        if decision.note:
            notes.append(decision.note)
    elif isinstance(value, str) and op in (Op.EQ, Op.NE, Op.EXACT, Op.CI_EXACT):
        if c.field in ctx.values:
            got = resolve_value(value, ctx.values[c.field], exact=op is Op.EXACT)
            if got is None:
                raise PlanError(f"{value!r} is none of the recorded values of {c.field.name}")
            if got[0] != value:
                notes.append(f"{value!r} is read as {got[0]!r}")
            value = got[0]
    if not c.negated:
        return Condition(c.field, op, value)
    if op in INVERSE:
        inverse = Condition(c.field, INVERSE[op], value)
        return inverse
    if op is Op.BETWEEN:
        return Group("or", (Condition(c.field, Op.LT, value[0]), Condition(c.field, Op.GT, value[1])))
    if op is Op.EXACT:
        return Condition(c.field, Op.NE, value)
    raise PlanError(f"{op.value} can't be negated on {c.field.name}")


def classify(matched: int, unresolved: tuple[str, ...] = (), absent: bool = False, no_values: bool = False) -> tuple[Status, str | None]:
    """An unresolved condition outranks all; no values is not zero; an absent kind is zero; else the count is exact."""
    if unresolved:
        return Status.UNAVAILABLE, unresolved[0]
    if no_values:
        return Status.UNAVAILABLE, NO_VALUES
    if absent:
        return Status.ZERO, ABSENT
    return (Status.EXACT, None) if matched else (Status.ZERO, NO_MATCH)


def preflight(pred: Predicate) -> tuple[Status, str] | None:
    """What is settled before any query runs."""
    if pred.unresolved:
        return Status.UNAVAILABLE, pred.unresolved[0]
    if not pred.scope.classes:
        return Status.ZERO, ABSENT
    if pred.scope.ids == ():
        return Status.ZERO, EMPTY_SCOPE
    return None


def execute(part: Part, ctx: Context) -> Result:
    """Runs one part; counts and breakdown are one job over the filtered frame."""
    pred = compile_part(part, ctx)
    modes = MODES.get(part.operation, ("sql",))
    if blocked := preflight(pred):
        return Result(part.part_id, part.operation, blocked[0], blocked[1], 0 if blocked[0] is Status.ZERO else None, notes=pred.notes, modes=())
    # Only what the parts of an answer read is held, not whole rows.
    rows = matching(ctx.entities, pred.scope, pred.tree).select("id", "source_model_id", "global_id", "ifc_class", "step_id", "canonical_json").persist()
    try:
        breakdown = {r.ifc_class: r.n for r in E.count_by_class(rows).collect()}  # one row a class
        total = sum(breakdown.values())
        status, reason = classify(total)
        out = Result(part.part_id, part.operation, status, reason, total, breakdown=breakdown if len(breakdown) > 1 else {}, notes=pred.notes, modes=modes)
        if part.operation in (Operation.AGGREGATE, Operation.EXTREMUM):
            _measure(part, ctx, rows, out)
        elif part.operation is Operation.GROUPS:
            key = FL.as_text(part.field) if part.field else F.col("ifc_class")
            out.rows = _local(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("key").asc_nulls_last()).limit(part.limit))
        elif part.operation is Operation.RELATIONSHIP and total:
            _relate(part, ctx, rows, out)
        elif part.operation in (Operation.DESCRIPTION, Operation.COMPARISON) and total:
            _describe(part, ctx, rows, out)
        else:
            n = {Operation.LIST: part.limit, Operation.SAMPLE: 1}.get(part.operation, EXAMPLES)
            out.rows = _local(E.hydrate(rows).orderBy("id").limit(n))
        return out
    finally:
        rows.unpersist()


def _local(df: DataFrame) -> DataFrame:
    """A bounded result, held apart from the frame that it was taken from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _measure(part: Part, ctx: Context, rows: DataFrame, out: Result) -> None:
    units = ctx.units.get(part.field, FieldUnits())
    decision = decide(part.field.name, units, None)
    if not decision.ok:
        out.status, out.reason = Status.UNAVAILABLE, decision.note
        return
    function = part.function or ("sum" if part.operation is Operation.AGGREGATE else "max")
    number = FL.as_number(part.field)
    got = rows.agg(E._aggregate(function, number).alias("value"), F.count(number).alias("coverage")).first()
    out.value, out.coverage, out.unit = got.value, got.coverage, units.symbol
    if out.total and not got.coverage:
        out.status, out.reason = Status.UNAVAILABLE, NO_VALUES
    elif out.total and got.coverage < out.total:
        out.status, out.reason = Status.PARTIAL, f"{got.coverage} of {out.total} objects record a value"


def _relate(part: Part, ctx: Context, rows: DataFrame, out: Result) -> None:
    seeds = G.seeds_of(rows)
    hops, warnings = G.traverse(seeds, ctx.members, ctx.relationships, ctx.model, part.depth, part.relationship_classes)
    ends = G.endpoints(hops, seeds, ctx.entities, part.endpoint_classes)
    out.rows = _local(ends.orderBy("depth", "id").limit(200))
    out.notes += tuple(warnings)
    n_hops = hops.count()
    out.coverage = n_hops
    if not out.rows.take(1):
        out.status, out.reason = Status.ZERO, NO_MATCH
    elif n_hops <= G.MAX_TOPOLOGY_HOPS:
        nodes, edges = G.topology(hops, seeds, ctx.entities)
        out.graph = (_local(nodes), _local(edges))


def _describe(part: Part, ctx: Context, rows: DataFrame, out: Result) -> None:
    if ctx.documents is None or ctx.query_vector is None:
        out.rows = _local(E.hydrate(rows).orderBy("id").limit(EXAMPLES))
        return
    docs = ctx.documents.where(F.col("entity_id").isNotNull()).join(rows.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    found = V.search(docs, ctx.query_vector, k=EXAMPLES)
    ranked = found.join(ctx.documents.select("id", "entity_id", F.substring("document_text", 1, V.EXCERPT).alias("excerpt")), "id")
    out.rows = _local(ranked.orderBy("rank"))


def floors(ctx: Context, concept: tuple[str, int | None] | None = None) -> DataFrame:
    """Bands of the model with their storeys, or the band that a phrase means."""
    summary = S.band_summary(S.bands(S.storeys(ctx.entities.where(F.col("source_model_id") == ctx.model))))
    return S.floor_bands(summary, concept) if concept else summary


@dataclass(frozen=True)
class PreviousScope:
    """What a follow-up refers to: the predicate, run anew, not its ids."""

    part: Part

    def rows(self, ctx: Context) -> DataFrame:
        pred = compile_part(self.part, ctx)
        if preflight(pred):
            return ctx.entities.where(F.lit(False))
        return matching(ctx.entities, pred.scope, pred.tree)

    def narrowed(self, conditions: tuple[BoundCondition, ...], part_id: str, operation: Operation) -> Part:
        inherited = tuple(replace(c, condition_id=f"p-{c.condition_id}", inherited=True) for c in self.part.conditions)
        return replace(self.part, part_id=part_id, operation=operation, conditions=inherited + conditions)


def viewer(part: Part, ctx: Context) -> DataFrame:
    """Identities for highlighting, from the same predicate as the answer."""
    return E.identities(PreviousScope(part).rows(ctx))


def presentation(result: Result, identities: int) -> str | None:
    """table, bar, group, graph, comparison or nothing, from the operation and what there is to show."""
    if result.status not in (Status.EXACT, Status.PARTIAL) or not identities:
        return None
    if result.operation in (Operation.COUNT, Operation.LIST):
        return "table"
    if result.operation is Operation.GROUPS:
        n = result.rows.count() if result.rows is not None else 0
        return "bar" if n > 1 else "group" if n else None
    if result.operation is Operation.COMPARISON:
        return "comparison"
    if result.operation is Operation.RELATIONSHIP:
        if result.graph is None:
            return "table"
        return G.presentable(result.graph[0].count(), result.graph[1].count(), result.coverage or 0)
    return None


def packet(results: list[Result]) -> list[dict]:
    """Facts with ids, all that an answer may state."""
    out = []
    for r in results:
        base = {"part_id": r.part_id, "operation": r.operation.value, "status": r.status.value, "reason": r.reason}
        facts = [("total", r.total), ("value", r.value), ("coverage", r.coverage)]
        facts += [(f"class {k}", n) for k, n in r.breakdown.items()]
        if r.operation is Operation.GROUPS and r.rows is not None:
            facts += [(f"group {x.key}", x.n) for x in r.rows.collect()]
        base["facts"] = [{"fact_id": f"{r.part_id}.{i + 1}", "name": n, "value": v, "unit": r.unit if n == "value" else None} for i, (n, v) in enumerate(f for f in facts if f[1] is not None)]
        out.append(base)
    return out


_SAYS_MISSING = re.compile(r"\b(unavailable|not available|cannot|can't|could not|no values|unknown|not recorded|unable)\b", re.I)
_SAYS_ALL = re.compile(r"\b(all|every|complete(?:ly)?|in total)\b", re.I)


def check_answer(facts: list[dict], text: str, claims: list[tuple[str, float]]) -> list[str]:
    """Problems of a worded answer: claims that are no facts or of another number, lost statuses, unfounded completeness."""
    known = {f["fact_id"]: f for p in facts for f in p["facts"]}
    out = []
    for fact_id, value in claims:
        f = known.get(fact_id)
        if f is None:
            out.append(f"{fact_id} is no fact")
        elif abs(float(f["value"]) - float(value)) > 1e-6 * max(1.0, abs(float(f["value"]))):
            out.append(f"{fact_id} is {f['value']}, not {value}")
    if any(p["status"] == "unavailable" for p in facts) and not _SAYS_MISSING.search(text):
        out.append("what is unavailable is not said to be")
    if any(p["status"] == "partial" for p in facts) and _SAYS_ALL.search(text):
        out.append("a partial result is called complete")
    return out


def fallback_answer(facts: list[dict]) -> str:
    """A plain answer from the facts alone."""
    lines = []
    for p in facts:
        if p["status"] in ("unavailable", "ambiguous"):
            lines.append(f"{p['part_id']}: not available ({p['reason']}).")
            continue
        said = "; ".join(f"{f['name']} {f['value']:g}{' ' + f['unit'] if f['unit'] else ''}" for f in p["facts"]) or "nothing"
        lines.append(f"{p['part_id']}: {said}" + (f" ({p['reason']})." if p["reason"] else "."))
    return "\n".join(lines)


def cost(tokens: dict[str, int | None], rates: dict[str, float]) -> float | None:
    """Tokens of each bucket by its rate per million; unknown usage makes the whole cost unknown."""
    if any(v is None or k not in rates for k, v in tokens.items()):
        return None
    return sum(v / 1e6 * rates[k] for k, v in tokens.items())


def answer(question: str, ctx: Context, bind, word=None, items: list[Item] | None = None) -> tuple[Gate, list[Result], str]:
    """The whole way: ledger, binding, gate with one correction, execution, facts, wording with fallback."""
    from trellisq.plans.spans import ledger

    items = ledger(question) if items is None else items
    parts, dispositions = bind(question, items, [])
    state, problems = gate(parts, items, dispositions)
    if state is Gate.RECOVERABLE:
        parts, dispositions = bind(question, items, problems)
        state, problems = gate(parts, items, dispositions)
    if state is not Gate.READY:
        return state, [], "; ".join(problems)
    results = [execute(p, ctx) for p in parts]
    facts = packet(results)
    if word is not None:
        text, claims = word(question, facts)
        if not check_answer(facts, text, claims):
            return state, results, text
    return state, results, fallback_answer(facts)


class SessionStore:
    """Per-session state: the last accepted part and the messages."""

    def __init__(self, keep: int = 20):
        import threading

        self._lock, self._held, self.keep = threading.Lock(), {}, keep

    def get(self, session: str) -> dict:
        with self._lock:
            return self._held.setdefault(session, {"previous": None, "messages": []})

    def accept(self, session: str, part: Part, message: str) -> None:
        state = self.get(session)
        with self._lock:
            state["previous"] = PreviousScope(part)
            state["messages"] = [*state["messages"], message][-self.keep :]

    def reset(self, session: str) -> None:
        with self._lock:
            self._held.pop(session, None)
