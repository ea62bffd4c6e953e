"""Splitting oversized texts at natural boundaries (problem 4).

Runs of white space count as one character (a line end if there is one among them, else a space). A text over
the limit is cut by lexical cohesion: the words on both sides of every joint between sentences or lines are
compared in sliding blocks, and of the joints within reach of the limit the one at the deepest valley of
similarity is taken. Where there is none in the second half of the reach, the last one before it is taken;
without any joint the cut falls between words, and in a text without any at the limit itself, never between a
sign and its combining marks unless nothing else is left. Each piece after the first starts with the last
``overlap`` characters of the one before, or up to ``slack`` fewer so as to start at a word.

Defined results: null, empty and short texts have no pieces; text_truncated and original_token_count are not
read; repeated texts each have their own pieces; the length of a text is not bounded.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 150
SLACK = 50
#: Sentences or lines in the block on each side of a joint.
BLOCK_UNITS = 4

_RUN = re.compile(r"[ \t\r\n]+")
_JOINT = re.compile(r"\n|(?<=[.!?…;])[\"'»”’)\]]*[ ]|(?<=[。！？])")
_MINOR = re.compile(r"(?<=[,:;、，|])[ ]?|[ ](?=[-–—(])")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def squeeze(text: str) -> str:
    return _RUN.sub(lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", text).strip(" \n")


def _units(text: str, long_unit: int) -> list[int]:
    """Ends of the sentences or lines of a text; the last one is its length. Longer units are parted at commas too."""
    ends: list[int] = []
    start = 0
    for m in [*_JOINT.finditer(text), None]:
        end = m.end() if m else len(text)
        if end <= start:
            continue
        if end - start > long_unit:
            ends += [x.end() for x in _MINOR.finditer(text, start, end) if start < x.end() < end]
        ends.append(end)
        start = end
    return ends


#: Endings that a word loses, longest first, so that its forms count as one term. Fixed values, of the corpus' languages.
ENDINGS = (
    "ements", "ations", "ungen", "ement", "ation", "mente", "iones", "ments", "heit", "keit", "lich", "ment", "ción", "ings", "ung", "ing", "ent", "ons", "ers", "ern", "est", "eur",
    "és", "ée", "es", "en", "er", "em", "ed", "ly", "os", "as", "ar", "ir", "re", "e", "s", "n", "a", "o", "i",
)


@functools.lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The word without its longest known ending, but with three letters at least."""
    for end in ENDINGS:
        if len(word) >= len(end) + 3 and word.endswith(end):
            return word[: -len(end)]
    return word


def _terms(part: str) -> Counter:
    """Stems of the words of a unit; letters two by two where words are not set apart."""
    out: Counter = Counter()
    for w in _WORD.findall(part):
        if w[0] >= "぀" and not w.isdigit():
            out.update(w[i : i + 2] for i in range(max(1, len(w) - 1)))
        elif w.isalpha():
            out[stem(w.casefold())] += 1
    return out


def cohesion(parts: list[Counter], width: int = BLOCK_UNITS) -> list[float]:
    """Cosine similarity of the blocks on both sides of each joint between neighbouring units."""
    n = len(parts)
    left: Counter = Counter()
    right: Counter = Counter()
    dot = 0
    ll = rr = 0
    out: list[float] = []

    def add(side: Counter, other: Counter, terms: Counter, sign: int, square: int) -> tuple[int, int]:
        change = 0
        for t, c in terms.items():
            old = side[t]
            new = old + sign * c
            square += new * new - old * old
            change += sign * c * other[t]
            if new:
                side[t] = new
            else:
                del side[t]
        return square, change

    for k in range(min(width, n)):
        rr, d = add(right, left, parts[k], 1, rr)
        dot += d
    for joint in range(n - 1):
        rr, d = add(right, left, parts[joint], -1, rr)
        dot += d
        ll, d = add(left, right, parts[joint], 1, ll)
        dot += d
        if joint >= width:
            ll, d = add(left, right, parts[joint - width], -1, ll)
            dot += d
        if joint + width < n:
            rr, d = add(right, left, parts[joint + width], 1, rr)
            dot += d
        out.append(dot / sqrt(ll * rr) if ll and rr else 0.0)
    return out


def valley_depths(scores: list[float]) -> list[float]:
    """How far each score lies below the nearest peaks to its left and right."""
    n = len(scores)
    peak_left, peak_right = scores[:], scores[:]
    for i in range(1, n):
        peak_left[i] = max(scores[i], peak_left[i - 1]) if scores[i - 1] >= scores[i] else scores[i]
    for i in range(n - 2, -1, -1):
        peak_right[i] = max(scores[i], peak_right[i + 1]) if scores[i + 1] >= scores[i] else scores[i]
    return [l + r - 2 * s for l, r, s in zip(peak_left, peak_right, scores)]


def _at_word(text: str, low: int, high: int) -> int | None:
    """The last place in (low, high] where a word begins after a blank."""
    for i in range(high, low, -1):
        if text[i - 1] in " \n":
            return i
    return None


def _parted(text: str, i: int) -> bool:
    """Whether a cut at i parts a sign from its marks."""
    return i < len(text) and (unicodedata.category(text[i])[0] == "M" or text[i] == "\u200d" or text[i - 1] == "\u200d")


def _loose(text: str, low: int, high: int) -> int:
    """The last place in (low, high] that doesn't part a sign from its marks; high if there is none."""
    return next((i for i in range(high, low, -1) if not _parted(text, i)), high)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a squeezed text; none if it is within the limit."""
    if len(text) <= limit:
        return []
    if not 0 <= slack <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit and slack at most the overlap")
    # A unit must leave room for a joint in the second half of a window.
    ends = _units(text, limit // 2)
    starts = [0, *ends[:-1]]
    depth = valley_depths(cohesion([_terms(text[a:b]) for a, b in zip(starts, ends)])) if len(ends) > 1 else []
    out: list[tuple[int, int]] = []
    start, k = 0, 0
    while len(text) - start > limit:
        low, high = start + limit // 2, start + limit
        best, best_depth = None, -1.0
        while k < len(depth) and ends[k] < low:
            k += 1
        j = k
        while j < len(depth) and ends[j] <= high:
            if depth[j] >= best_depth:
                best, best_depth = ends[j], depth[j]
            j += 1
        if best is None and k and ends[k - 1] > start + 2 * overlap:
            best = ends[k - 1]
        end = best or _at_word(text, low, high) or _loose(text, low, high)
        out.append((start, end))
        start = _resume(text, end, overlap, slack)
    out.append((start, len(text)))
    return out


def _resume(text: str, end: int, overlap: int, slack: int) -> int:
    """Where the next piece starts: overlap characters before end, or at the first word within slack after that, else at the first sign that is no mark."""
    first = end - overlap
    last = min(first + slack, end)
    for i in range(first, last + 1):
        if text[i - 1] in " \n":
            return i
    return next((i for i in range(first, last + 1) if not _parted(text, i)), first)


def split_texts(docs: DataFrame, id_col: str = "id", text_col: str = "document_text", limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """(id, piece_no, n_pieces, start, overlap, piece) of each text over the limit, in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "n_pieces", "start", "overlap", "piece"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out: list[list] = [[] for _ in names]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = squeeze(text)
                    cuts = pieces(text, limit, overlap, slack)
                    for no, (a, z) in enumerate(cuts):
                        for o, x in zip(out, (key, no, len(cuts), a, cuts[no - 1][1] - a if no else 0, text[a:z])):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=names)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).where(f"id is not null and char_length(t) > {int(limit)}").mapInArrow(
        rows, "id long, piece_no int, n_pieces int, start long, overlap int, piece string"
    )
