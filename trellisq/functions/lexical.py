"""Text normalisation and matching of words against stored values and names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_IRREGULAR = {"people": "person", "children": "child", "feet": "foot", "shelves": "shelf", "leaves": "leaf"}
TRUE, FALSE = {"true", "yes", "y", "1", "t", ".t."}, {"false", "no", "n", "0", "f", ".f."}


def normalize(text: str | None) -> str:
    """Without accents, case and punctuation, words one blank apart."""
    if not text:
        return ""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[\W_]+", " ", plain).strip()


def split_identifier(name: str | None) -> list[str]:
    """Words of a camel-case or underscored name, without a leading Ifc."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+", name or "")
    words = [normalize(w) for w in words]
    return [w for i, w in enumerate(words) if w and not (i == 0 and w == "ifc" and len(words) > 1)]


def singular(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and re.search(r"(ss|x|z|ch|sh)es$", word):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    return word


def stems(text: str | None) -> list[str]:
    return [singular(w) for w in normalize(text).split()]


def overlap(a: list[str], b: list[str]) -> float:
    """Share of the words of the first that the second has."""
    return len(set(a) & set(b)) / len(set(a)) if a else 0.0


def parse_boolean(text: str) -> bool | None:
    word = text.strip().casefold()
    return True if word in TRUE else False if word in FALSE else None


def parse_number(text: str) -> float | None:
    m = re.search(r"-?\d+(?:[.,]\d+)?", text)
    return float(m[0].replace(",", ".")) if m else None


def resolve_value(asked: str | None, observed: list[str], exact: bool = False, contains: bool = False) -> tuple[str, str] | None:
    """(stored value, rung) that the asked value means: exact, normalized, singular, boolean or, if allowed, contains."""
    if not asked or not observed:
        return None
    observed = sorted(observed)
    if asked in observed:
        return asked, "exact"
    key = normalize(asked)
    if exact or not key:
        return None
    flag = parse_boolean(asked)
    rungs = [("normalized", lambda v: normalize(v) == key), ("singular", lambda v: stems(v) == stems(asked))]
    if flag is not None:
        rungs.append(("boolean", lambda v: parse_boolean(v) is flag))
    if contains:
        rungs.append(("contains", lambda v: key in normalize(v)))
    for rung, fits in rungs:
        for v in observed:
            if fits(v):
                return v, rung
    return None


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.casefold()


def normalized(text: Column) -> Column:
    """The column form of normalize: canonical decomposition needs an Arrow UDF, the rest is built in; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(_folded(text), r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " "))


def identifier_words(name: Column) -> Column:
    """Lower-case words of a camel-case name, without a leading ifc."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.when((F.size(words) > 1) & (F.element_at(words, 1) == "ifc"), F.slice(words, F.lit(2), F.size(words))).otherwise(words)


def natural_key(text: Column) -> Column:
    """A sort key that orders the figures in a text by value, of whatever length; null for null, so that callers put nulls last.

    Each run of digits is written without leading zeros, after its length.
    """
    bits = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(bit: Column) -> Column:
        digits = F.ltrim(bit, F.lit("0"))
        return F.when(bit.rlike("^[0-9]"), F.concat(F.lpad(F.char_length(digits).cast("string"), 9, "0"), digits)).otherwise(F.lower(bit))

    return F.when(text.isNotNull(), F.concat_ws("", F.transform(bits, key)))
