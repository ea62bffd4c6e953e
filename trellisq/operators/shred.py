"""Deeply nested records to related flat tables by shared inlining (problem 3).

Two passes over the records. The first gathers the schema graph: which element type occurs under which,
singly or repeated. An element type gets a table of its own if it is repeated (in an array), shared (found
under several parent types) or recursive (its own ancestor); every other object is inlined into the row of
its nearest ancestor with a table, as columns with dotted names. The second pass writes one row per element
with a table: its node id (the JSON path), the node id of its parent row (the foreign key), its place in the
array and its scalar columns. Objects whose keys are data (``MAPS``) repeat their entries as arrays do: the entries
of all of them have one table, named after the object with ``{}``, and the key is a column.

Defined results: a null or unreadable text has no rows, nor has a record without id; a string that holds a JSON array or object, at any
depth, stands for its content; null elements count for indexes; empty objects in arrays give rows without
columns; a scalar in an array gives a row whose column is ``value``. Repeated keys: the last one counts. Records may
be nested to any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "$"
#: Objects whose keys are data. Fixed values of the record format.
MAPS = frozenset({"property_sets", "property_sets{}", "quantity_sets", "quantity_sets{}", "measurements", "scalars", "endpoints"})
_TOKEN = re.compile(r'\s*([{}\[\],:"]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)')
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _loads(text: str):
    """json.loads for texts of any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """Reads a JSON text without recursion."""
    stack: list = []
    key, at, want, out = None, 0, "value", None
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            if want == "end" and not text[at:].strip():
                return out
            raise ValueError("no JSON")
        t, at = m[1], m.end()
        if want in ("key", "first key") and t == '"':
            key, at = scanstring(text, at)
            m = _TOKEN.match(text, at)
            if m is None or m[1] != ":":
                raise ValueError("no JSON")
            at, want = m.end(), "value"
            continue
        if (t == "}" and want in ("first key", "next") and type(stack[-1]) is dict) or (t == "]" and want in ("first value", "next") and type(stack[-1]) is list):
            stack.pop()
            want = "next" if stack else "end"
            continue
        if t == "," and want == "next":
            want = "key" if type(stack[-1]) is dict else "value"
            continue
        if want not in ("value", "first value") or t in "}],:":
            raise ValueError("no JSON")
        if t == '"':
            v, at = scanstring(text, at)
        elif t in "{[":
            v = {} if t == "{" else []
        else:
            v = _WORDS[t] if t in _WORDS else float(t) if any(c in ".eE" for c in t) else int(t)
        if not stack:
            out = v
        elif type(stack[-1]) is dict:
            stack[-1][key] = v
        else:
            stack[-1].append(v)
        if t in "{[":
            stack.append(v)
            want = "first key" if t == "{" else "first value"
        else:
            want = "next" if stack else "end"


def _load(text: str | None):
    """The value of a JSON text; None when it is null or unreadable."""
    if text is None:
        return None
    try:
        value = _loads(text)
    except ValueError:
        return None
    return _inner(value) if type(value) is str else value


def _inner(text: str):
    """A string that holds a JSON array or object stands for its content; others for themselves."""
    head = text[:1]
    if head not in "[{" and not head.isspace():
        return text
    if text.lstrip()[:1] not in ("[", "{"):
        return text
    try:
        value = _loads(text)
    except ValueError:
        return text
    return value if type(value) in (dict, list) else text


def schema_edges(value, edges: set[tuple[str, str, bool]]) -> None:
    """Adds (parent type, child type, repeated) for each object and array element below value."""
    stack = [(ROOT, ROOT, value)]
    while stack:
        owner, name, v = stack.pop()
        kind = type(v)
        if kind is str:
            if v[:1] in ("[", "{") or v[:1].isspace():
                v = _inner(v)
                kind = type(v)
        if kind is dict:
            entries = name in MAPS
            for k, x in v.items():
                t = type(x)
                if entries:
                    k = name + "{}"
                if t is dict:
                    edges.add((name, k, entries))
                    stack.append((name, k, x))
                elif t is list or (t is str and (x[:1] in ("[", "{") or x[:1].isspace())):
                    stack.append((name, k, x))
        elif kind is list:
            for x in v:
                t = type(x)
                if t is dict or t is list:
                    edges.add((owner, name, True))
                    stack.append((owner, name, x))
                elif t is str and (x[:1] in ("[", "{") or x[:1].isspace()):
                    stack.append((owner, name, x))


class Inlining:
    """The tables that the schema graph calls for."""

    def __init__(self, edges: set[tuple[str, str, bool]], everything: bool = False):
        """``everything`` gives each object a table of its own, whatever the graph calls for."""
        parents: dict[str, set[str]] = {}
        children: dict[str, set[str]] = {}
        self.own: set[str] = set()
        self.everything = everything
        for owner, name, repeated in edges:
            parents.setdefault(name, set()).add(owner)
            children.setdefault(owner, set()).add(name)
            if repeated:
                self.own.add(name)
        self.own |= {n for n, p in parents.items() if len(p) > 1}
        self.own |= self._recursive(children)

    @staticmethod
    def _recursive(children: dict[str, set[str]]) -> set[str]:
        """Types on a cycle (or between two): what is left after types without children or parents are peeled."""
        left = {n: set(c) for n, c in children.items()}
        while True:
            below = set().union(*left.values()) if left else set()
            keep = {n: {x for x in c if x in left} for n, c in left.items() if n in below}
            keep = {n: c for n, c in keep.items() if c}
            if keep == left:
                return set(left)
            left = keep

    def has_table(self, name: str) -> bool:
        return self.everything or name in self.own


def shred(value, plan: Inlining, columns: bool) -> list[tuple]:
    """(table, node, parent node, ordinal, in_array, is_object, columns) of one record."""
    out: list[tuple] = []
    if type(value) not in (dict, list):
        return out
    row: dict | None = {} if columns else None
    if type(value) is dict:
        out.append((ROOT, "", None, None, False, True, row))
    # (value, path, name, row that takes its scalars, that row's node, prefix of its columns)
    stack: list[tuple] = [(value, "", ROOT, row, "", "")]
    while stack:
        v, path, name, cols, node, prefix = stack.pop()
        if type(v) is dict:
            entries = name in MAPS
            for k, x in v.items():
                t = type(x)
                if t is str and (x[:1] in ("[", "{") or x[:1].isspace()):
                    x = _inner(x)
                    t = type(x)
                at = f"{path}.{k}" if path else k
                kind = name + "{}" if entries else k
                if t is dict:
                    if entries or plan.has_table(kind):
                        own = ({"key": k} if entries else {}) if columns else None
                        out.append((kind, at, node, None, False, True, own))
                        stack.append((x, at, kind, own, at, ""))
                    else:
                        stack.append((x, at, kind, cols, node, f"{prefix}{k}."))
                elif t is list:
                    stack.append((x, at, kind, cols, node, prefix))
                elif columns and x is not None:
                    if entries:
                        out.append((kind, at, node, None, False, False, {"key": k, "value": x if t is str else json.dumps(x)}))
                    else:
                        cols[prefix + k] = x if t is str else json.dumps(x)
        else:
            for i, x in enumerate(v):
                t = type(x)
                if t is str and (x[:1] in ("[", "{") or x[:1].isspace()):
                    x = _inner(x)
                    t = type(x)
                at = f"{path}[{i}]"
                if t is dict:
                    own = {} if columns else None
                    out.append((name, at, node, i, True, True, own))
                    stack.append((x, at, name, own, at, ""))
                elif t is list:
                    out.append((name, at, node, i, True, False, {} if columns else None))
                    stack.append((x, at, name, None, at, ""))
                elif columns and x is not None:
                    out.append((name, at, node, i, True, False, {"value": x if t is str else json.dumps(x)}))
    return out


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: set[tuple[str, str, bool]] = set()
    for b in batches:
        for text in b.column(0).to_pylist():
            value = _load(text)
            if type(value) in (dict, list):
                schema_edges(value, edges)
    rows = sorted(edges)
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())],
        names=["owner", "name", "repeated"],
    )


def schema_graph(records: DataFrame, json_col: str = "canonical_json") -> Inlining:
    """The inlining plan of a table's JSON column; what comes to the driver is the distinct names of its schema, not rows or keys that are data."""
    edges = records.select(F.col(json_col).alias("j")).mapInArrow(_edges_of, "owner string, name string, repeated boolean").distinct().collect()
    return Inlining({(e.owner, e.name, e.repeated) for e in edges})


def shred_table(records: DataFrame, source_table: str, id_col: str = "id", json_col: str = "canonical_json", columns: bool = True) -> DataFrame:
    """All rows of all tables of a JSON column, in long form.

    source_table, record_id, table_name, node_id, parent_node_id, ordinal, in_array, is_object and, if asked
    for, columns (name to text). (record_id, node_id) is the key; (record_id, parent_node_id) the foreign key.
    """
    plan = schema_graph(records, json_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for start in range(0, len(ids), 2000):
                out: list[list] = [[] for _ in range(8)]
                for rid, text in zip(ids[start : start + 2000], texts[start : start + 2000]):
                    got = shred(_load(text), plan, columns)
                    if got:
                        out[0].extend([rid] * len(got))
                        for k, c in enumerate(zip(*got)):
                            out[k + 1].extend(c)
                arrays = [pa.array(out[0], pa.int64()), *(pa.array(out[k], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.int32()), (5, pa.bool_()), (6, pa.bool_())))]
                names = ["record_id", "table_name", "node_id", "parent_node_id", "ordinal", "in_array", "is_object"]
                if columns:
                    arrays.append(pa.array([list(c.items()) for c in out[7]], pa.map_(pa.string(), pa.string())))
                    names.append("columns")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "record_id long, table_name string, node_id string, parent_node_id string, ordinal int, in_array boolean, is_object boolean"
    if columns:
        schema += ", columns map<string,string>"
    return records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), F.col(json_col).alias("j")).mapInArrow(rows, schema).withColumn("source_table", F.lit(source_table))


def flat_table(shredded: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """One of the tables with typed columns; a text that can't be cast gives null."""
    picked = [F.expr(f"try_cast(columns[{json.dumps(c)}] as {t})").alias(c) for c, t in columns.items()]
    return shredded.where(F.col("table_name") == name).select("record_id", "node_id", "parent_node_id", "ordinal", *picked)
