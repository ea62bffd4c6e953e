"""Whether a numeric condition may be put to a field: spellings are folded, nothing is ever converted."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from trellisq.functions.measures import ALIASES


def normalize_unit(token: str | None) -> str | None:
    """One spelling per unit; unknown ones stay comparable."""
    if token is None:
        return None
    text = re.sub(r"[.\s]+$", "", re.sub(r"\s+", " ", token).strip()).casefold()
    text = text.replace("^2", "²").replace("^3", "³")
    known = ALIASES.get(text) or ALIASES.get(re.sub(r"(?<=[a-z])([23])$", lambda m: "²³"[int(m[1]) - 2], text))
    if known is None:
        text = unicodedata.normalize("NFKC", text)
        known = ALIASES.get(text)
    return f"{known[0]}:{known[1]:.9g}" if known else text or None


def equivalent(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and normalize_unit(a) == normalize_unit(b)


@dataclass(frozen=True)
class FieldUnits:
    """What a profile knows of a field's unit: state uniform, mixed, unknown or none (no dimension)."""

    state: str = "none"
    symbol: str | None = None
    limitation: str | None = None


@dataclass(frozen=True)
class UnitDecision:
    ok: bool
    note: str | None = None


def decide(field: str, units: FieldUnits, asked: str | None) -> UnitDecision:
    if units.state == "none":
        if asked is None:
            return UnitDecision(True)
        return UnitDecision(False, f"{field} has no unit, so a value in {asked} can't be compared with it")
    if units.state != "uniform":
        return UnitDecision(False, units.limitation or f"the values of {field} are not on one scale")
    if asked is None:
        return UnitDecision(True, f"read in {units.symbol}, the unit of {field}")
    if equivalent(asked, units.symbol):
        return UnitDecision(True, None if asked == units.symbol else f"{asked} is read as {units.symbol}")
    return UnitDecision(False, f"{field} is recorded in {units.symbol}; values are not converted to {asked}")
