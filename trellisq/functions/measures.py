"""Lengths, areas and volumes: unit words, written quantities and the units that a model declares."""

from __future__ import annotations

import json
import re

#: Metres of each length and its spellings in lower case. Fixed values.
LENGTHS = {
    "mm": (0.001, "mm millimeter millimeters millimetre millimetres millimètre millimètres"),
    "cm": (0.01, "cm centimeter centimeters centimetre centimetres zentimeter centimètre centimètres"),
    "dm": (0.1, "dm decimeter decimeters decimetre decimetres dezimeter"),
    "m": (1.0, "m meter meters metre metres mètre mètres"),
    "km": (1000.0, "km kilometer kilometers kilometre kilometres"),
    "inch": (0.0254, "in inch inches zoll"),
    "foot": (0.3048, "ft foot feet"),
    "yard": (0.9144, "yd yard yards"),
}
PREFIXES = {"MILLI": 0.001, "CENTI": 0.01, "DECI": 0.1, "KILO": 1000.0, "DECA": 10.0, "HECTO": 100.0, "MICRO": 1e-6}
POWERS = {"METRE": 1, "SQUARE_METRE": 2, "CUBIC_METRE": 3}
DIMENSIONS = {1: "length", 2: "area", 3: "volume"}


def _aliases() -> dict[str, tuple[str, float]]:
    out: dict[str, tuple[str, float]] = {}
    for size, words in LENGTHS.values():
        for w in words.split():
            out[w] = ("length", size)
            for power, dim, marks, before in ((2, "area", ("²", "2", "^2"), ("sq", "sq.", "square")), (3, "volume", ("³", "3", "^3"), ("cu", "cu.", "cubic"))):
                value = (dim, size**power)
                for mark in marks:
                    out[w + mark] = value
                for b in before:
                    out[f"{b} {w}"] = value
                    if b in ("sq", "cu"):
                        out[b + w] = value
    out |= {"sf": ("area", 0.3048**2), "qm": ("area", 1.0), "cf": ("volume", 0.3048**3), "cbm": ("volume", 1.0), "ccm": ("volume", 1e-6)}
    for w in ("l", "litre", "litres", "liter", "liters"):
        out[w] = ("volume", 0.001)
    for w in ("ml", "millilitre", "millilitres", "milliliter", "milliliters"):
        out[w] = ("volume", 1e-6)
    out |= {"'": ("length", 0.3048), "′": ("length", 0.3048), '"': ("length", 0.0254), "″": ("length", 0.0254), "''": ("length", 0.0254)}
    return out


ALIASES = _aliases()
_SPACE = r"[ \t   ]"
_NUM = rf"[+-]?(?:\d+(?:{_SPACE}\d{{3}})+(?!\d)|\d+)(?:[.,]\d+)?(?:[eE][+-]?\d+)?"
_PLAIN = re.compile(rf"{_SPACE}*({_NUM}){_SPACE}*")
_LEAD = r"(?:(?:ca|approx|approximately|nom|nominal|about|circa|etwa|rund|env|environ)\b\.?|[~≈±])?"
_UNIT = "|".join(re.escape(a).replace(r"\ ", rf"{_SPACE}?") for a in sorted(ALIASES, key=len, reverse=True))
_WITH_UNIT = re.compile(rf"\s*{_LEAD}\s*(?P<n>{_NUM})\s*(?P<u>{_UNIT})\.?(?![\w²³^/])(?P<rest>.*)", re.I | re.S)
_INCHES = rf"(?P<i>\d+(?:[.,]\d+)?)?(?:(?<=\d)(?:{_SPACE}+|-)|(?<!\d))?(?P<f>\d+/[1-9]\d*)?"
_IMPERIAL = re.compile(
    rf"\s*{_LEAD}\s*(?:(?P<ft>{_NUM})\s*(?:'(?!')|′|ft\b|feet\b|foot\b)\.?\s*-?\s*)?(?:{_INCHES}\s*(?:\"|″|''|in(?:ch(?:es)?)?\b)\.?)(?P<rest>.*)", re.I | re.S
)


def number(text: str) -> float:
    return float(re.sub(_SPACE, "", text).replace(",", "."))


def plain_number(text: str) -> float | None:
    """The value of a text that is a number and nothing else."""
    m = _PLAIN.fullmatch(text.strip())
    return number(m[1]) if m else None


def _rest_ok(rest: str) -> bool:
    """What follows a quantity may be a word of comment, but no further figure."""
    return not any(c.isdigit() for c in rest)


def written_quantity(text: str) -> tuple[str, float] | None:
    """(dimension, value in m, m² or m³) of a text that carries its own unit; None without one."""
    m = _IMPERIAL.fullmatch(text)
    if m and (m["i"] or m["f"]) and _rest_ok(m["rest"]):
        inches = float(m["i"].replace(",", ".")) if m["i"] else 0.0
        if m["f"]:
            a, b = m["f"].split("/")
            inches += int(a) / int(b)
        return "length", (number(m["ft"]) * 12 if m["ft"] else 0.0) * 0.0254 + inches * 0.0254
    m = _WITH_UNIT.fullmatch(text)
    if m and _rest_ok(m["rest"]):
        unit = unit_of(m["u"])
        if unit:
            return unit[0], number(m["n"]) * unit[1]
    return None


def unit_of(name: str | None) -> tuple[str, float] | None:
    """(dimension, factor to m, m² or m³) of a unit that is only named."""
    if not isinstance(name, str):
        return None
    word = re.sub(r"\s+", " ", name.strip().casefold()).replace("ˆ", "^")
    return ALIASES.get(word) or ALIASES.get(word.rstrip(".")) or ALIASES.get(word.replace(" ", ""))


def unit_of_key(key: str) -> tuple[str, float] | None:
    """The customary unit that a key such as ``lengthunit:foot#2`` names."""
    return unit_of(key.partition(":")[2].partition("#")[0]) if ":" in key else unit_of(key)


def _positive(value: object) -> float | None:
    """A positive number, also one written as text."""
    if isinstance(value, str):
        value = plain_number(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if 0 < value < float("inf") else None


def unit_of_definition(d: dict) -> tuple[str, float] | None:
    """The unit that a definition gives; none if it is marked as not resolved."""
    if not isinstance(d, dict) or d.get("resolved") is False:
        return None
    si = POWERS.get(str(d.get("si_name") or "").upper())
    if si:
        prefix = str(d.get("prefix") or "").upper()
        if not prefix or prefix in PREFIXES:
            return DIMENSIONS[si], PREFIXES.get(prefix, 1.0) ** si
    conv = d.get("conversion")
    if isinstance(conv, dict):
        size, base = _positive(conv.get("value")), unit_of(conv.get("unit_symbol"))
        if base and size:
            return base[0], base[1] * size
    return unit_of(d.get("symbol")) or unit_of(d.get("name"))


_NOTE_UNIT = re.compile(rf"(?<![\w'])(?:{'|'.join(re.escape(a).replace(chr(92) + ' ', ' ?') for a in sorted(ALIASES, key=len, reverse=True) if a[0].isalpha() and a not in ('in', 'cu', 'l'))}|l(?!['’]))(?![\w²³^'’])", re.I)


def note_units(note: str) -> dict[str, tuple[str, float]]:
    """Default units that a remark in words declares: the first unit of each dimension in it."""
    out: dict[str, tuple[str, float]] = {}
    for m in _NOTE_UNIT.finditer(note):
        unit = unit_of(m[0])
        if unit:
            out.setdefault(unit[0], unit)
    return out


def model_units(metadata: str | None) -> tuple[dict[str, tuple[str, float] | None], dict[str, tuple[str, float] | None]]:
    """(unit by override key in lower case, default unit by measure type) of a model's extraction_metadata."""
    try:
        meta = json.loads(metadata) if metadata else None
    except ValueError:
        meta = None
    if not isinstance(meta, dict):
        return {}, {}
    units = meta.get("dimension_units")
    if isinstance(units, dict):
        defs = {str(k).casefold(): unit_of_definition(v) for k, v in (units.get("definitions") or {}).items()}
        defaults = {}
        for measure, key in (units.get("defaults") or {}).items():
            if key is not None:
                folded = str(key).casefold()
                defaults[str(measure).casefold()] = defs[folded] if folded in defs else unit_of_key(str(key))
        return defs, defaults
    found: dict[str, tuple[str, float] | None] = {}
    for name, note in meta.items():
        if isinstance(note, str) and name != "extraction_version":
            for dim, unit in note_units(note).items():
                found.setdefault(dim, unit)
    return {}, found
