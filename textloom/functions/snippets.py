"""Snippets around query terms; vectorised Python, run on one page of results."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTHING = "No content available"


def _mark(text: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: f"<strong>{m[0]}</strong>", text, flags=re.I)


def term_snippet(text: str | None, terms: Sequence[str]) -> str:
    """The first sentence with the whole phrase, else with most terms, else a long one; terms marked."""
    if not text:
        return NOTHING
    sentences = text.split(". ")
    while sentences and not sentences[-1]:
        sentences.pop()
    if not sentences:
        return NOTHING
    phrase = " ".join(terms).lower()
    best, exact = "", False
    if len(terms) > 1:
        best = next((s for s in sentences if len(s) >= 20 and phrase in s.lower()), "")
        exact = bool(best)
    if not exact:
        most = 0
        for s in sentences:
            if len(s) >= 20:
                n = sum(bool(t) and t.lower() in s.lower() for t in terms)
                if n > most:
                    most, best = n, s
    best = best or next((s for s in sentences if len(s) >= 50), "") or sentences[0]
    if len(best) > 300:
        end = 297
        at = best.lower().find(phrase) if exact else -1
        if 0 < at < end < at + len(phrase):
            end = min(at + len(phrase) + 20, len(best))
        best = best[:end] + "..."
    if exact:
        return _mark(best, re.escape(phrase))
    for t in terms:
        if t:
            best = _mark(best, rf"\b{re.escape(t)}\b")
    return best


def phrase_snippet(text: str | None, phrase: str) -> str:
    """A hundred characters each side of the phrase, from a word's start to a sentence's end; phrase marked."""
    if not text or not phrase:
        return NOTHING
    at = text.lower().find(phrase.lower())
    if at < 0:
        return term_snippet(text, phrase.split())
    start, end = max(0, at - 100), min(len(text), at + len(phrase) + 100)
    if start > 0:
        while start > 0 and text[start].isalnum():
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
    if end < len(text) - 1:
        stop = text.find(". ", at + len(phrase))
        if 0 < stop < end:
            end = stop + 1
    out = ("..." if start > 0 else "") + text[start:end] + ("..." if end < len(text) else "")
    return _mark(out, re.escape(phrase))


def context_snippet(text: str | None, terms: Sequence[str], before: int = 100, after: int = 150) -> str:
    """A window around the first term found, moved to word ends; else the head of the text."""
    if not text:
        return NOTHING
    low = text.lower()
    at = min((p for t in terms if t and (p := low.find(t.lower())) >= 0), default=-1)
    if at < 0:
        return text[: before + after] + ("..." if len(text) > before + after else "")
    start, end = max(0, at - before), min(len(text), at + after)
    if start:
        start = text.find(" ", start, at) + 1 or start
    if end < len(text):
        last = text.rfind(" ", at, end)
        end = last if last > at else end
    return ("..." if start else "") + text[start:end].strip() + ("..." if end < len(text) else "")


def highlight(text: str, terms: Sequence[str]) -> str:
    """Tags dropped; terms marked unless the text is under 20 characters."""
    bare = re.sub("<[^>]+>", "", text)
    for t in terms if len(bare) >= 20 else ():
        if t:
            bare = _mark(bare, re.escape(t))
    return bare


def page_buttons(page: int, total: int, width: int = 5) -> list[int]:
    """Page numbers around the present one."""
    first = max(1, min(page - width // 2, total - width + 1))
    return list(range(first, min(total, first + width - 1) + 1))


def description(paragraphs: Sequence[str], body: str) -> str:
    """Paragraphs over 50 characters until there are 200, or the body's head; 300 at most."""
    text = ""
    for p in paragraphs:
        if len(p) > 50:
            text += p + " "
            if len(text) > 200:
                break
    text = body if len(text) < 100 else text.strip()
    return re.sub(r"\s+", " ", text[:300] + "..." if len(text) > 300 else text).strip()


def snippet_column(text: Column, terms: Sequence[str], phrase: str | None = None) -> Column:
    terms = list(terms)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: phrase_snippet(t, phrase) if phrase else term_snippet(t, terms))

    return run(text)


@F.pandas_udf(T.StringType())
def description_column(paragraphs: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([description([x for x in (p if p is not None else []) if x], b or "") for p, b in zip(paragraphs, body, strict=True)], dtype=object)
