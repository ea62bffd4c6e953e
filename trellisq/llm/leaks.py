"""Evaluation texts leaking into training text (problem 9).

Each passage gives the patterns of all its runs of ``min_words`` words, in a form without case, punctuation,
white space and look-alike differences. The corpus is searched for all of them at once by the Wu-Manber
method: a table over hashed blocks says how far the window may be shifted, windows with shift 0 select
patterns by their suffix block, and direct comparison confirms an occurrence.

Defined results: null or empty texts and passages with fewer words than ``min_words`` never match; an item
whose passage occurs several times in a document gives one row; equal passages are reported for each item;
texts of any length are searched whole. The patterns of a search are held by every task: the evaluation set is
read in blocks of ``BLOCK_BYTES`` of passages, one search each, so that neither the driver nor a task ever holds
more than one block and one passage. A set of up to that size, some 10,000 passages, costs one pass.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.llm.lookalike import SAME_SHAPE, SIZE, consistent_forms

MIN_WORDS = 12
#: Bytes of passages whose patterns are searched for at once: what is broadcast is about twelve times as much.
BLOCK_BYTES = 8_000_000
BLOCK = 8
TABLE_BITS = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordForm:
    """Code points to words: letters that share case or shape become one, all other signs a space."""

    _one: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls._one is None:
            to = np.full(SIZE, 0x20, np.int32)
            for cp in range(SIZE):
                if unicodedata.category(chr(cp))[0] in "LN":
                    to[cp] = cp
            group: dict[int, int] = {}

            def top(c: int) -> int:
                while group.get(c, c) != c:
                    c = group[c]
                return c

            def tie(a: int, b: int) -> None:
                a, b = top(a), top(b)
                if a != b:
                    group[max(a, b)] = min(a, b)

            shapes = [(ord(a), ord(b)) for a, b in SAME_SHAPE.items()]
            for a, b in shapes:
                tie(a, b)
            for a in {x for p in shapes for x in p}:
                for other in (chr(a).lower(), chr(a).upper()):
                    if len(other) == 1:
                        tie(a, ord(other))
            for c in list(group):
                to[c] = top(c)
            to[0] = 0
            cls._one = to
        return cls._one


def word_forms(texts: pa.Array) -> list[bytes]:
    """Each text as its words, each followed by one space, with a space before the first."""
    forms = consistent_forms(texts).fill_null("")
    to = WordForm.table()
    out: list[bytes] = []
    rows = forms.to_pylist()
    start, size = 0, 0
    for i, row in enumerate(rows):
        size += len(row)
        if size > 1 << 19 or i == len(rows) - 1:
            whole = "\0".join(rows[start : i + 1]).casefold()
            cps = to[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
            gap = cps == 0x20
            cps = cps[~(gap & np.r_[False, gap[:-1]])]
            text = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            out += [f" {x.strip()} ".encode("utf-8", "surrogatepass") for x in text.split("\0")]
            start, size = i + 1, 0
    return out


class WuManber:
    """Multi-pattern search over bytes; values are what to report for each pattern."""

    _held: tuple[str, WuManber] | None = None

    @classmethod
    def get(cls, name: str, patterns) -> WuManber:
        """The machine of a broadcast set of patterns, built once in each process."""
        if cls._held is None or cls._held[0] != name:
            cls._held = (name, cls(patterns.value))
        return cls._held[1]

    def __init__(self, patterns: dict[bytes, tuple[int, ...]]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.b = min(BLOCK, self.m)
        self.full = self.m - self.b + 1
        self.shift = np.full(1 << TABLE_BITS, min(self.full, 255), np.uint8)
        self.buckets: dict[bytes, list[bytes]] = {}
        heads = sorted({p[: self.m] for p in patterns})
        block = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), self.m)
        for j in range(self.full):
            h = self._hash(np.ascontiguousarray(block[:, j : j + self.b]).reshape(-1))[:: self.b]
            np.minimum.at(self.shift, h, min(self.m - self.b - j, 255))
        for p in patterns:
            self.buckets.setdefault(p[self.m - self.b : self.m], []).append(p)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        """The table index of the block that starts at each position; the last b - 1 have none."""
        n = len(data) - self.b + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        word = np.zeros(n, np.uint64)
        for k in range(self.b):
            word |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        with np.errstate(over="ignore"):
            return ((word * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: bytes) -> set[int]:
        found: set[int] = set()
        if len(text) < self.m:
            return found
        shifts = self.shift[self._hash(np.frombuffer(text, np.uint8))].tobytes()
        lead = self.m - self.b
        i, end = lead, len(shifts)
        b, buckets = self.b, self.buckets
        while i < end:
            s = shifts[i]
            if s:
                i += s
                continue
            for p in buckets.get(text[i : i + b], ()):
                if text.startswith(p, i - lead):
                    found.update(self.patterns[p])
            i += 1
        return found


def passage_patterns(items: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> dict[bytes, tuple[int, ...]]:
    patterns: dict[bytes, set[int]] = {}
    forms = word_forms(pa.array([p for _, p in items], pa.string())) if items else []
    for (item, _), form in zip(items, forms):
        words = form.split()
        for k in range(len(words) - min_words + 1):
            patterns.setdefault(b" " + b" ".join(words[k : k + min_words]) + b" ", set()).add(item)
    return {p: tuple(sorted(x)) for p, x in patterns.items()}


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of about size bytes, read one partition at a time."""
    block: list[tuple[int, str]] = []
    used = 0
    for r in items.select("item_id", "passage").where("item_id is not null and passage is not null").toLocalIterator():
        block.append((r.item_id, r.passage))
        used += len(r.passage)
        if used >= size:
            yield block
            block, used = [], 0
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id) of each document that holds min_words consecutive words of the item's passage."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")
    result = spark.createDataFrame([], "doc_id long, item_id long")
    for block in _blocks(items, block_bytes):
        patterns = passage_patterns(block, min_words)
        if not patterns:
            continue
        held, name = spark.sparkContext.broadcast(patterns), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            machine = WuManber.get(name, held)
            for b in batches:
                ids, found = [], []
                for doc, text in zip(b.column(0).to_pylist(), word_forms(b.column(1))):
                    for item in sorted(machine.search(text)):
                        ids.append(doc)
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

        result = result.unionByName(texts.mapInArrow(search, "doc_id long, item_id long"))
    return result.distinct()
