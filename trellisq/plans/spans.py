"""What a question says besides its subject: modifier spans, and the ledger of all that must be accounted for."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from trellisq.functions.lexical import normalize
from trellisq.functions.measures import ALIASES
from trellisq.operators.spatial import BOTTOM, GROUND, ORDINALS, TOP

MAX_SPANS = 24


class Kind(str, Enum):
    QUOTED = "quoted_value"
    COMPARISON = "comparison"
    NUMBER = "numeric_bound"
    UNIT = "unit"
    FLOOR = "floor_reference"
    NEGATION = "negation"
    SCOPE = "scope_reference"
    PREVIOUS = "previous_result_reference"
    SELECTION = "selection_reference"


#: Kinds that narrow a result, so that they must be bound or reported.
MATERIAL = {Kind.QUOTED, Kind.COMPARISON, Kind.NUMBER, Kind.FLOOR, Kind.NEGATION, Kind.PREVIOUS, Kind.SELECTION}

_FLOOR = r"(?:floors?|levels?|storeys?|stor(?:y|ies))"
_PLACES = "|".join(sorted([*ORDINALS, *TOP, *BOTTOM, *GROUND], key=len, reverse=True))
_UNITS = "|".join(re.escape(u) for u in sorted((a for a in ALIASES if a[0].isalpha() and a != "in"), key=len, reverse=True))
_FORMS: tuple[tuple[Kind, str], ...] = (
    (Kind.QUOTED, r"'[^']{1,120}'|\"[^\"]{1,120}\"|‘[^’]{1,120}’|“[^”]{1,120}”"),
    (Kind.FLOOR, rf"\b(?:{_PLACES})\s+{_FLOOR}\b|\b{_FLOOR}\s*#?\s*\d{{1,2}}\b|\b\d{{1,2}}(?:st|nd|rd|th)\s+{_FLOOR}\b"),
    (Kind.COMPARISON, r"\b(?:[a-z]+er|more|less|fewer)\s+than(?:\s+or\s+equal\s+to)?\b|\bat\s+(?:least|most)\b|\bno\s+(?:more|less)\s+than\b|\b(?:over|under|above|below|exceeding|between)\b"),
    (Kind.PREVIOUS, r"\b(?:of\s+)?(?:those|these|them)\b(?!\s+objects)|\bthe\s+(?:previous|above|former)\b"),
    (Kind.SELECTION, r"\b(?:currently\s+)?(?:selected|highlighted)\b|\bthe\s+selection\b|\b(?:this|these)\s+objects?\b"),
    (Kind.NEGATION, r"\b(?:not|non|no|without|excluding|exclude|except|neither|nor)\b|\b\w+n't\b"),
    (Kind.SCOPE, r"\b(?:(?:the|this|that|our|whole|entire|active|current)\s+)*(?:building|model|project|structure|facility)\b"),
    (Kind.NUMBER, rf"(?<![\w.])-?\d+(?:[.,]\d+)?(?=\s*(?:(?:{_UNITS})\b)?(?![\w]))"),
    (Kind.UNIT, rf"(?<=\d)\s*(?:{_UNITS})(?!\w)"),
)


@dataclass(frozen=True)
class Span:
    kind: Kind
    text: str
    start: int
    end: int

    @property
    def material(self) -> bool:
        return self.kind in MATERIAL


def detect(question: str | None, limit: int = MAX_SPANS) -> list[Span]:
    """Spans in order; within a stretch of text the kind named first in the list above wins."""
    text = question or ""
    taken: list[Span] = []
    for kind, form in _FORMS:
        for m in re.finditer(form, text, re.I):
            if m[0].strip() and not any(s.start < m.end() and m.start() < s.end for s in taken):
                start = m.end() - len(m[0].lstrip())
                taken.append(Span(kind, m[0].strip(), start, m.end()))
    return sorted(taken, key=lambda s: s.start)[:limit]


class Role(str, Enum):
    SUBJECT = "subject"
    CONDITION = "condition"
    SCOPE = "scope"
    OUTPUT = "output"
    RELATIONSHIP = "relationship"


#: Dispositions that account for an item of each role. Fixed values.
ALLOWED = {
    Role.SUBJECT: {"bound_subject", "redundant_with", "ambiguous", "unavailable"},
    Role.CONDITION: {"bound_condition", "redundant_with", "ambiguous", "unavailable"},
    Role.SCOPE: {"bound_scope", "redundant_with", "ambiguous", "unavailable"},
    Role.OUTPUT: {"bound_output", "bound_condition", "bound_subject", "redundant_with", "ambiguous", "unavailable"},
    Role.RELATIONSHIP: {"bound_relationship", "bound_condition", "redundant_with", "ambiguous", "unavailable"},
}
_ROLE_OF = {Kind.PREVIOUS: Role.SCOPE, Kind.SELECTION: Role.SCOPE, Kind.SCOPE: Role.SCOPE}
#: English function words by kind, and the words that merely ask; they carry no item of their own.
_STOP = {
    word
    for kind in (
        "a an the",  # articles
        "any each every all many much some",  # quantities that are not figures
        "i me you your it they them their there there's which who what where when how that",  # pronouns and question words
        "am is are was were be been can could do does did has have had will would",  # auxiliaries
        "as at by for from in of on to with and or",  # prepositions and conjunctions
        "please show list give tell count number",  # requests
    )
    for word in kind.split()
}
_RELATION = {"connected", "contain", "contains", "contained", "bounded", "adjacent", "related", "linked", "inside"}


@dataclass(frozen=True)
class Item:
    item_id: str
    role: Role
    text: str
    material: bool


def ledger(question: str, inherited: tuple[str, ...] = ()) -> list[Item]:
    """All that an answer has to account for: spans, runs of content words between them and inherited conditions."""
    spans = detect(question)
    items: list[tuple[int, Role, str, bool]] = [(s.start, _ROLE_OF.get(s.kind, Role.CONDITION), s.text, s.material) for s in spans if s.kind is not Kind.UNIT]
    at, first = 0, True
    for stop in [*spans, None]:
        run: list[str] = []
        begin = at
        for m in re.finditer(r"[^\W_]+(?:['’][^\W_]+)?", question[at : stop.start if stop else len(question)]):
            if normalize(m[0]) in _STOP:
                if run:
                    items.append((begin, _role(run, first), " ".join(run), True))
                    run, first = [], False
                continue
            if not run:
                begin = at + m.start()
            run.append(m[0])
        if run:
            items.append((begin, _role(run, first), " ".join(run), True))
            first = False
        at = stop.end if stop else at
    items.sort(key=lambda x: x[0])
    out = [Item(f"L{i + 1}", role, text, material) for i, (_, role, text, material) in enumerate(items)]
    return out + [Item(f"S{i + 1}", Role.CONDITION, text, True) for i, text in enumerate(inherited)]


def _role(run: list[str], first: bool) -> Role:
    if any(normalize(w) in _RELATION for w in run):
        return Role.RELATIONSHIP
    return Role.SUBJECT if first else Role.OUTPUT


def uncovered(items: list[Item], dispositions: dict[str, str]) -> list[str]:
    """Problems of a binding's account: material items left out, dispositions a role doesn't allow, unknown items."""
    known = {i.item_id: i for i in items}
    out = [f"unknown item {k}" for k in dispositions if k not in known]
    for i in items:
        d = dispositions.get(i.item_id)
        if d is None:
            if i.material:
                out.append(f"{i.item_id} ({i.text}) is not accounted for")
        elif d not in ALLOWED[i.role]:
            out.append(f"{i.item_id} ({i.text}) can't be {d}")
    return out
