"""Encoding of a corpus with a public byte-level vocabulary (problem 8).

A text is split by the vocabulary's pattern. In each piece an automaton of all vocabulary strings reports, at
every position, the tokens that end there. For every prefix exactly one of them is the last token of the
prefix's encoding: the one that fits the last token of what stands before it, two tokens being compatible if
the merges would leave their concatenation as these two. These last tokens are stored for every prefix, and
the back-pointers followed from the end give the ids, exactly as the merges would.

Defined results: null and empty texts give an empty list; the strings of special tokens are ordinary text;
pieces and texts of any length are encoded whole, in time linear in their length; repeated rows each give a
row.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie by default; every function takes another place.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The vocabulary's own pattern. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file that is broadcast has this size at most.
VOCABULARY_BYTES = 64_000_000
MEMO = 400_000
MEMO_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixEncoder:
    """A vocabulary with its automaton and merges; one per process and file."""

    _held: dict[str, PrefixEncoder] = {}

    @classmethod
    def get(cls, held) -> PrefixEncoder:
        """The encoder of a broadcast vocabulary file (digest, bytes), built once in each process."""
        name, data = held.value
        if name not in cls._held:
            cls._held[name] = cls(data)
        return cls._held[name]

    def __init__(self, source: str | bytes):
        """From a vocabulary file or its bytes."""
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = f.read()
        model = json.loads(source)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        # A string of latin letters stands for bytes, as the automaton works on strings.
        self.text = {i: "".join(chr(letters[c]) for c in t) for t, i in vocab.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            if ab not in self.parts:
                self.parts[ab], self.rank[ab] = (a, b), r
            self.joined[a, b] = ab
        self.automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens side by side as they are.

        The merges that made the tokens are undone, latest first. At each stage the pieces that touch must
        not have had a merge of their own that would have come before the one just undone.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts, joined = self.rank, self.parts, self.joined
        a, b, before = left, right, 1 << 60
        while True:
            ab = joined.get((a, b))
            if ab is not None and rank[ab] < before:
                fits = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                fits = True
                break
            # Of equal merges the left one is made first, so the right one is undone first. While the right
            # token was still in parts, an equal merge across the border would have come before it.
            if ra > rb:
                a, before = parts[a][1], ra
            else:
                b, before = parts[b][0], rb + 1
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self.memo.get(piece)
        if got is None:
            got = self._piece(piece.encode("utf-8", "replace").decode("latin-1"))
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                self.memo[piece] = got
        return got

    def _piece(self, s: str) -> tuple[int, ...]:
        last = [-1] * len(s)
        size = [0] * len(s)
        compatible = self.compatible
        for end, (token, n) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - n
            if before < 0 or compatible(last[before], token):
                last[end], size[end] = token, n
        ids = []
        at = len(s) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            memo = self.memo
            for piece in self.split(text):
                ids += memo.get(piece) or self.piece(piece)
        return ids


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document. The driver reads the vocabulary (a few MB) and broadcasts it, so executors need no file."""
    if os.path.getsize(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_BYTES} bytes")
    with open(vocabulary, "rb") as f:
        data = f.read()
    held = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PrefixEncoder.get(held)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "doc_id long, ids array<int>")
