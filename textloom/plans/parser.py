"""Query language: keywords, an exact phrase, or two quoted phrases around AND, OR, NOT."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..functions.stem import porter
from ..functions.stop_words import ALWAYS_KEPT, QUERY

_OPERATOR = re.compile(r"\b(AND|OR|NOT)\b", re.I)
BOTH_QUOTED = "Operators (AND, OR, NOT) require both terms to be enclosed in quotes."
FAILED = "An error occurred while processing your query."


@dataclass(frozen=True)
class ParsedQuery:
    """``kind``: keyword, phrase, boolean or error."""

    original: str
    kind: str
    operator: str | None = None
    phrases: tuple[str, ...] = ()
    terms: tuple[str, ...] = field(default=())
    error: str | None = None


def query_terms(text: str, stop: Sequence[str] = tuple(QUERY), stem: bool = True) -> tuple[str, ...]:
    """Words that count: not stop words (but for those always kept), stemmed if asked."""
    listed = set(stop)
    kept = [w for w in text.lower().split() if w in ALWAYS_KEPT or (w not in listed and w != "and")]
    return tuple(porter(w) if stem else w for w in kept)


def normalize_operators(query: str) -> str:
    return re.sub(r"\b(and|or|not)\b", lambda m: m[0].upper(), query, flags=re.I)


def parse_query(query: str, stop: Sequence[str] = tuple(QUERY), stem: bool = True) -> ParsedQuery:
    found = _OPERATOR.search(query)
    if found:
        sides = [p.strip() for p in re.split(r"\b(?:AND|OR|NOT)\b", query, flags=re.I)]
        while sides and not sides[-1]:
            sides.pop()
        if len(sides) == 2:
            if all(p.startswith('"') and p.endswith('"') for p in sides):
                phrases = tuple(p.strip() for p in re.findall(r'"([^"]*)"', query) if p.strip())
                return ParsedQuery(query, "boolean", found[1].upper(), phrases)
            return ParsedQuery(query, "error", error=BOTH_QUOTED)
    if query.startswith('"') and query.endswith('"'):
        if len(query) < 2:
            return ParsedQuery(query, "error", error=FAILED)
        return ParsedQuery(query, "phrase", phrases=(query[1:-1],))
    return ParsedQuery(query, "keyword", terms=query_terms(query, stop, stem))
