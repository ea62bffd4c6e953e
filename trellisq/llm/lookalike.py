"""One consistent form for text that looks the same (problem 10).

Arrow text is copied to numpy code-point arrays; invisible signs, spaces, hyphens and wide forms go through
one lookup table, canonical decompositions through offsets into a table of expansions, letters of other
scripts through a second lookup, and marks are ordered and composed on whole arrays. No string is handled
row by row.

What does not change the look: invisible characters (format characters, variation selectors, control codes
but for tabs and line ends), any one-for-one kind of space or hyphen, wide forms, accents written apart, and
letters of other scripts of the same shape. Letter case, digits, missing accents, raised figures, fractions,
dashes and all other visible signs do.

Defined results: null gives null, empty text empty text; a text of any length is handled in slices of whole
rows; repeated rows each give a row. For p10 pairs, null, empty and blank texts are no case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisq.runtime import Scratch

#: Letters of other scripts and the Latin letters of the same shape. Fixed values.
SAME_SHAPE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C",
    "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "Տ": "S", "Լ": "L", "ց": "g", "զ": "q", "µ": "μ",
}
HYPHENS = "‐‑﹣"
#: Format characters that are seen, before the figures they enclose. Fixed values.
SEEN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
SIZE = 0x110000
DROP = 0x1FFFFF
SLICE = 1 << 19


class Tables:
    """The lookup tables, made from the character database once in each process."""

    _one: Tables | None = None

    @classmethod
    def get(cls) -> Tables:
        if cls._one is None:
            cls._one = cls()
        return cls._one

    def __init__(self) -> None:
        first = np.arange(SIZE, dtype=np.int32)
        second = np.arange(SIZE, dtype=np.int32)
        ccc = np.zeros(SIZE, np.uint8)
        mark = np.zeros(SIZE, bool)
        expand_at = np.full(SIZE, -1, np.int32)
        expansions: list[str] = []
        pairs: dict[int, int] = {}
        for cp in range(SIZE):
            if 0xD800 <= cp < 0xE000 or 0x30000 <= cp < 0xE0000:
                continue
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat == "Cn":
                continue
            if (cat == "Cf" and cp not in SEEN_FORMATS) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x17B4, 0x17B5) or 0x180B <= cp <= 0x180F:
                first[cp] = DROP
            elif cat == "Cc" and cp not in (0, 9, 10, 11, 12, 13, 0x85):
                first[cp] = DROP
            elif cat == "Zs":
                first[cp] = 0x20
            elif cat in ("Zl", "Zp"):
                first[cp] = 0x0A
            if cat[0] == "M":
                mark[cp] = True
                ccc[cp] = unicodedata.combining(c)
            d = unicodedata.decomposition(c)
            if not d:
                continue
            if d.startswith("<wide>"):
                first[cp] = int(d.split()[1], 16)
            elif d[0] != "<":
                expand_at[cp] = len(expansions)
                expansions.append(unicodedata.normalize("NFD", c))
                parts = [int(x, 16) for x in d.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
                    pairs[parts[0] << 21 | parts[1]] = cp
        for i in range(11172):  # Hangul syllables from their letters
            lead, rest = divmod(i, 588)
            vowel, tail = divmod(rest, 28)
            pairs[(0x1100 + lead) << 21 | (0x1161 + vowel) if not tail else (0xAC00 + i - tail) << 21 | (0x11A7 + tail)] = 0xAC00 + i
        for cp in HYPHENS:
            first[ord(cp)] = 0x2D
        first[0xFF0D] = 0x2D
        for a, b in SAME_SHAPE.items():
            second[ord(a)] = ord(b)
        # A composed letter and its parts must give one form: pairs whose base has a look-alike start from that.
        self.first, self.second, self.ccc, self.mark, self.expand_at = first, second, ccc, mark, expand_at
        self.exp_len = np.array([len(e) for e in expansions], np.int64)
        self.exp_start = np.r_[0, np.cumsum(self.exp_len)][:-1]
        self.exp_text = np.frombuffer("".join(expansions).encode("utf-32-le"), np.uint32).astype(np.int32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        seconds = np.zeros(SIZE, bool)
        seconds[(keys & 0x1FFFFF)] = True
        self.seconds = seconds


def _expand(cps: np.ndarray, t: Tables) -> np.ndarray:
    at = t.expand_at[cps]
    hit = at >= 0
    if not hit.any():
        return cps
    length = np.ones(len(cps), np.int64)
    length[hit] = t.exp_len[at[hit]]
    start = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.int32)
    out[start[~hit]] = cps[~hit]
    n = length[hit]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(start[hit], n) + within] = t.exp_text[np.repeat(t.exp_start[at[hit]], n) + within]
    return out


def _order(cps: np.ndarray, t: Tables) -> np.ndarray:
    """Marks on one base in canonical order: neighbours are exchanged until none stands before a lower class."""
    while True:
        c = t.ccc[cps]
        bad = np.flatnonzero((c[:-1] > c[1:]) & (c[1:] > 0))
        if not len(bad):
            return cps
        chosen = bad[np.r_[True, np.diff(bad) > 1]]
        cps = cps.copy()
        cps[chosen], cps[chosen + 1] = cps[chosen + 1], cps[chosen]


def _compose(cps: np.ndarray, t: Tables) -> np.ndarray:
    while True:
        can = np.flatnonzero(t.seconds[cps])
        can = can[can > 0]
        if not len(can):
            return cps
        c = t.ccc[cps]
        base = np.maximum.accumulate(np.where(c == 0, np.arange(len(cps)), -1))
        b = np.where(c[can] == 0, can - 1, base[can])
        # Blocked: a mark of the same or a higher class, or another base, stands between.
        free = (b >= 0) & ((b == can - 1) | ((c[can - 1] > 0) & (c[can - 1] < c[can])))
        can, b = can[free], b[free]
        key = cps[b].astype(np.int64) << 21 | cps[can]
        k = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        ok = t.pair_keys[k] == key
        can, b, k = can[ok], b[ok], k[ok]
        if not len(can):
            return cps
        # One step per base, and no position is both base and mark within a step.
        one = np.r_[True, b[1:] != b[:-1]]
        can, b, k = can[one], b[one], k[one]
        used = np.isin(b, can)
        can, b, k = can[~used], b[~used], k[~used]
        cps = cps.copy()
        cps[b] = t.pair_to[k]
        keep = np.ones(len(cps), bool)
        keep[can] = False
        cps = cps[keep]


def form_points(cps: np.ndarray) -> np.ndarray:
    """The consistent form of an array of code points; zeros part its rows and stay."""
    t = Tables.get()
    cps = t.first[cps]
    cps = cps[cps != DROP]
    cps = _expand(cps, t)
    cps = t.second[cps]
    if t.mark[cps].any() or t.seconds[cps].any():
        cps = _compose(_order(cps, t), t)
    return cps


def consistent_forms(texts: pa.Array) -> pa.Array:
    """The forms of an Arrow array of texts; null stays null."""
    texts = texts.cast(pa.large_string())
    filled = pc.fill_null(texts, "")
    sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out: list[str] = []
    start = 0
    while start < len(filled):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        part = filled.slice(start, stop - start)
        rows = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.concat_arrays([part]).cast(pa.string()))
        whole = pc.binary_join(rows, "\0")[0].as_py()
        if whole.count("\0") != len(part) - 1:
            whole = "\0".join(x.replace("\0", "") for x in part.to_pylist())
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        out += form_points(points).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").split("\0")
        start = stop
    forms = pa.array(out, pa.string())
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), forms) if texts.null_count else forms


def with_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and form of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), consistent_forms(b.column(1))], names=["doc_id", "text", "form"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "doc_id long, text string, form string")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id with the digests of form (look) and text (spelling) of each document that is not blank."""
    forms = with_form(docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")), id_col, text_col)
    return forms.where("doc_id is not null and form rlike '\\\\S'").select("doc_id", F.unhex(F.md5("form")).alias("look"), F.unhex(F.md5("text")).alias("spelling"))


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that look the same but differ in at least one code point.

    Only digests are shuffled. Looks with one spelling are left out by a partial aggregate. The spellings of a look
    meet first, one row each, and only then the documents that have them, so copies of one text never meet each other.
    """
    s = Scratch(docs.sparkSession, "lookalike")
    digests = s.cut(_digests(docs, id_col, text_col))
    several = digests.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("look")
    kept = s.cut(digests.join(several, "look", "left_semi"))
    one = kept.select("look", "spelling").distinct()
    x, y = one.select("look", F.col("spelling").alias("x")), one.select("look", F.col("spelling").alias("y"))
    both = x.join(y, "look").where("x < y").drop("look")
    left, right = kept.select(F.col("spelling").alias("x"), F.col("doc_id").alias("a")), kept.select(F.col("spelling").alias("y"), F.col("doc_id").alias("b"))
    pairs = both.join(left, "x").join(right, "y")
    return s.finish(pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct())


def lookalike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, look_id, spelling_id, n_spellings, n_documents) of every document that is not blank.

    look_id is the smallest document that looks the same, spelling_id the smallest with the same text: classes with
    membership, in which copies, however many, cost a row each.
    """
    s = Scratch(docs.sparkSession, "looks")
    digests = s.cut(_digests(docs, id_col, text_col))
    spelled = digests.groupBy("look", "spelling").agg(F.min("doc_id").alias("spelling_id"), F.count(F.lit(1)).alias("n"))
    looks = spelled.groupBy("look").agg(F.min("spelling_id").alias("look_id"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_documents"))
    known = spelled.join(looks, "look").select("look", "spelling", "look_id", "spelling_id", "n_spellings", "n_documents")
    return s.finish(digests.join(known, ["look", "spelling"]).select("doc_id", "look_id", "spelling_id", "n_spellings", "n_documents"))
