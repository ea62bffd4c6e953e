"""Attribute-value rows to wide typed tables (problem 5).

Statements are read as the type that the catalog wants, once, where they are found. Equal readings of one
entity and attribute are merged in a partial aggregate before anything is shuffled, so an entity or attribute
that holds a third of all statements reaches the builder as one row. The builder streams rows sorted by
entity, with attributes encoded as column indices, into typed column buffers with validity masks.

Defined results: null, blank and unreadable JSON state nothing; an entity of a class outside the catalog, or
a null class, has no attributes and no row; an attribute with an unreadable statement, or with readable ones
that differ, is ``unsettled`` and null in the wide row; repeated equal statements are one. A date that starts
with its year has the month next, one with dots its day first; an impossible day or month is not read by
exchanging the two.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.operators.shred import _inner, _load

NUMBER = re.compile(r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?", re.ASCII)
TIME = r"(?:[T\s]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
YEAR_FIRST = re.compile(rf"(\d{{4}})\s?[-/. ]\s?(\d{{1,2}})\s?[-/. ]\s?(\d{{1,2}}){TIME}", re.ASCII)
YEAR_LAST = re.compile(rf"(\d{{1,2}})\s?([-/. ])\s?(\d{{1,2}})\s?[-/. ]\s?(\d{{4}}){TIME}", re.ASCII)
COMPACT = re.compile(rf"(\d{{8}}){TIME}", re.ASCII)
DAY_NAME_YEAR = re.compile(rf"(\d{{1,2}})\.?\s*(?:de\s+)?([^\W\d]{{3,12}})\.?,?\s*(?:de\s+)?(\d{{4}}){TIME}")
NAME_DAY_YEAR = re.compile(rf"([^\W\d]{{3,12}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){TIME}")
TRUE = {"true", "t", ".t.", ".true.", "yes", "y", "1", "ja", "j", "wahr", "oui", "o", "vrai"}
FALSE = {"false", "f", ".f.", ".false.", "no", "n", "0", "nein", "falsch", "non", "faux"}
#: Month names by their first letters, English, German and French.
MONTHS = {
    "jan": 1, "jän": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6,
    "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12, "déc": 12,
}
TYPES = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int64(), "double": pa.float64(), "date": pa.date32()}
SPARK_TYPES = {"string": "string", "boolean": "boolean", "int": "long", "double": "double", "date": "date"}


def fold(name: str) -> str:
    """Names match when letter case, spaces and underscores are ignored."""
    return re.sub(r"[\s_]", "", name).casefold()


def _date(year: int, month: int, day: int) -> str | None:
    try:
        return datetime.date(year, month, day).isoformat()
    except ValueError:
        return None


def read_date(text: str) -> str | None:
    """The day a text names; the year first means month before day, dots mean the day first, slashes whichever order exists alone."""
    if m := YEAR_FIRST.fullmatch(text):
        y, a, b = (int(x) for x in m.groups())
        return _date(y, a, b)
    if m := YEAR_LAST.fullmatch(text):
        a, sign, b, y = int(m[1]), m[2], int(m[3]), int(m[4])
        if sign == ".":
            return _date(y, b, a)
        readings = {x for x in (_date(y, b, a), _date(y, a, b)) if x}
        return readings.pop() if len(readings) == 1 else None
    if m := COMPACT.fullmatch(text):
        s = m[1]
        if first := _date(int(s[:4]), int(s[4:6]), int(s[6:])):
            return first
        readings = {x for x in (_date(int(s[4:]), int(s[2:4]), int(s[:2])), _date(int(s[4:]), int(s[:2]), int(s[2:4]))) if x}
        return readings.pop() if len(readings) == 1 else None
    for form, day, name in ((DAY_NAME_YEAR, 1, 2), (NAME_DAY_YEAR, 2, 1)):
        if m := form.fullmatch(text):
            word = m[name].casefold()
            month = MONTHS.get(word[:4]) or MONTHS.get(word[:3])
            return _date(int(m[3]), month, int(m[day])) if month else None
    return None


def read(value, data_type: str) -> str | None:
    """The canonical text of a statement read as data_type; None when it can't be read so."""
    if data_type == "string":
        if type(value) is str:
            return value.strip().casefold()
        try:
            return json.dumps(value, ensure_ascii=False).casefold()
        except RecursionError:
            return None
    if data_type == "boolean":
        if type(value) is bool:
            return "true" if value else "false"
        if type(value) is float and value in (0.0, 1.0):
            value = int(value)
        word = str(value).strip().casefold()
        return "true" if word in TRUE else "false" if word in FALSE else None
    if type(value) is bool or type(value) in (list, dict):
        return None
    text = str(value).strip()
    if data_type == "date":
        return read_date(text)
    if not NUMBER.fullmatch(text):
        return None
    text = text.replace(",", ".")
    if data_type == "double":
        number = float(text)
        return repr(number + 0.0) if math.isfinite(number) else None
    exact = Decimal(text)
    if exact and not -20 <= exact.adjusted() <= 18 or exact != exact.to_integral_value():
        return None
    whole = int(exact)
    return str(whole) if -(2**63) <= whole < 2**63 else None


def columns_of(catalog: list[tuple[str, str, str]]) -> tuple[dict[str, dict[str, int]], list[tuple[str, str, str]]]:
    """By folded class: column index by folded attribute; and (column, attribute, type) in order of index.

    An attribute that has one type in all classes gives the column its name; else the type is added to it.
    """
    rows = sorted({(c.strip().casefold(), a, t) for c, a, t in catalog if c and a and t in TYPES})
    types: dict[str, set[str]] = {}
    for _, a, t in rows:
        types.setdefault(a, set()).add(t)
    wide = sorted({(a if len(types[a]) == 1 else f"{a}_{t}", a, t) for _, a, t in rows})
    at = {(a, t): i for i, (_, a, t) in enumerate(wide)}
    classes: dict[str, dict[str, int]] = {}
    for c, a, t in rows:
        classes.setdefault(c, {}).setdefault(fold(a), at[a, t])
    return classes, wide


def statements(entities: DataFrame, catalog: list[tuple[str, str, str]]) -> DataFrame:
    """Entity-attribute-value rows of the property sets: entity_id, col, bad, canon, shown."""
    classes, wide = columns_of(catalog)
    kinds = [t for _, _, t in wide]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[str, str] = {}
        memo: dict = {}
        for b in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for eid, cls, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                wanted = classes.get(cls.strip().casefold()) if cls else None
                if not wanted:
                    continue
                record = _load(text)
                sets = record.get("property_sets") if type(record) is dict else None
                if type(sets) is str:
                    sets = _inner(sets)
                if type(sets) is not dict:
                    continue
                seen = set()
                for fields in sets.values():
                    if type(fields) is str:
                        fields = _inner(fields)
                    if type(fields) is not dict:
                        continue
                    for name, st in fields.items():
                        key = folded.get(name)
                        if key is None:
                            key = folded[name] = fold(name)
                        col = wanted.get(key)
                        if col is None or type(st) is not dict:
                            continue
                        value = st.get("value")
                        if value is None or (type(value) is str and not value.strip()):
                            continue
                        if type(value) in (list, dict):
                            canon = read(value, kinds[col])
                        else:
                            k = (col, type(value), value)
                            if k not in memo:
                                if len(memo) > 200_000:
                                    memo.clear()
                                memo[k] = read(value, kinds[col])
                            canon = memo[k]
                        if (col, canon) not in seen:
                            seen.add((col, canon))
                            for o, x in zip(out, (eid, col, canon is None, canon, value.strip() if type(value) is str else json.dumps(value) if canon is not None else None)):
                                o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string()))], names=["entity_id", "col", "bad", "canon", "shown"])

    return entities.select(F.col("id").cast("long").alias("entity_id"), "ifc_class", "canonical_json").where("id is not null").mapInArrow(
        rows, "entity_id long, col int, bad boolean, canon string, shown string"
    )


def _buffer(kind: str, canon: list, shown: list, at: np.ndarray, n: int) -> pa.Array:
    """A column of n rows with the given readings at the given places and nulls elsewhere."""
    valid = np.zeros(n, bool)
    valid[at] = True
    if kind == "string":
        values = np.full(n, None, object)
        values[at] = shown
        return pa.array(values, pa.string())
    if kind == "date":
        values = np.zeros(n, "datetime64[D]")
        values[at] = np.array(canon, "datetime64[D]")
        return pa.array(values, mask=~valid).cast(pa.date32())
    if kind == "boolean":
        values = np.zeros(n, bool)
        values[at] = [c == "true" for c in canon]
    elif kind == "int":
        values = np.zeros(n, np.int64)
        values[at] = [int(c) for c in canon]
    else:
        values = np.zeros(n, np.float64)
        values[at] = [float(c) for c in canon]
    return pa.array(values, TYPES[kind], mask=~valid)


def pivot(stated: DataFrame, catalog: list[tuple[str, str, str]]) -> DataFrame:
    """entity_id, unsettled (attributes without a single typed value) and one typed column per attribute."""
    _, wide = columns_of(catalog)
    merged = stated.groupBy("entity_id", "col").agg(
        (F.max("bad") | (F.coalesce(F.min("canon") != F.max("canon"), F.lit(False)))).alias("unsettled"), F.min("canon").alias("canon"), F.min("shown").alias("shown")
    )
    rows_sorted = merged.repartition("entity_id").sortWithinPartitions("entity_id")

    def build(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("entity_id").to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        row = np.cumsum(np.r_[False, ids[1:] != ids[:-1]])
        n = len(starts)
        cols = t.column("col").to_numpy()
        unsettled = t.column("unsettled").to_numpy(zero_copy_only=False)
        arrays = [pa.array(ids[starts], pa.int64())]
        bad = np.flatnonzero(unsettled)
        names: list[list[str]] = [[] for _ in range(n)]
        for i in bad:
            names[row[i]].append(wide[cols[i]][1])
        arrays.append(pa.array([sorted(x) for x in names], pa.list_(pa.string())))
        canon, shown = t.column("canon"), t.column("shown")
        for c, (_, _, kind) in enumerate(wide):
            here = np.flatnonzero((cols == c) & ~unsettled)
            arrays.append(_buffer(kind, canon.take(here).to_pylist(), shown.take(here).to_pylist(), row[here], n))
        return pa.RecordBatch.from_arrays(arrays, names=["entity_id", "unsettled", *(w[0] for w in wide)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            ids = t.column("entity_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], "left"))
            held = t.slice(cut)
            if cut:
                yield build(t.slice(0, cut).combine_chunks())
        if held is not None and held.num_rows:
            yield build(held.combine_chunks())

    fields = ", ".join(f"`{name}` {SPARK_TYPES[kind]}" for name, _, kind in wide)
    return rows_sorted.mapInArrow(stream, f"entity_id long, unsettled array<string>{', ' + fields if fields else ''}")


def catalog_rows(catalog: DataFrame) -> list[tuple[str, str, str]]:
    """The catalog is a table of wanted columns; its size is that of a schema, not of the data."""
    return [tuple(r) for r in catalog.select("ifc_class", "attribute", "data_type").collect()]
