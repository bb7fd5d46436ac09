"""Tokens and other text expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with inner dots, a dotted extension, or a path.
TOKEN = r"[a-z0-9_]+(?:\.[a-z0-9_]+)*|\.[a-z0-9_]+|/[a-z0-9_\-./]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null text: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def with_parts(words: Column) -> Column:
    """Add the parts of dotted tokens and paths after them.

    A part counts only where the sequence does not hold it before: sorted by term and
    place, the first of each term is known by its neighbour, so the cost is that of
    two sorts of a text's words.
    """
    dotted = lambda t: F.when(t.contains("."), F.split(t, r"\.")).otherwise(F.array().cast("array<string>"))
    slashed = lambda t: F.when(t.rlike(r"[+\-*/=]"), F.split(t, r"[+\-*/=]")).otherwise(F.array().cast("array<string>"))
    pair = lambda s, p: F.struct(s.alias("s"), F.lit(p).alias("p"))
    text = "array<string>"
    spread = F.flatten(F.transform(words, lambda t: F.concat(F.array(pair(t, False)), F.transform(F.filter(F.concat(dotted(t), slashed(t)), lambda x: x != ""), lambda x: pair(x, True)))))
    by_term = F.sort_array(F.transform(spread, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["p"].alias("p"))))
    before = F.concat(F.array(F.lit(None)).cast(text), F.transform(by_term, lambda x: x["s"]))
    marked = F.zip_with(by_term, F.slice(before, F.lit(1), F.size(by_term)), lambda x, y: F.struct(x["i"].alias("i"), x["s"].alias("s"), (~x["p"] | ~y.eqNullSafe(x["s"])).alias("keep")))
    in_order = F.filter(F.sort_array(marked), lambda x: x["keep"])
    return F.when(F.exists(words, lambda t: t.rlike(r"[.+\-*/=]")), F.transform(in_order, lambda x: x["s"])).otherwise(words)


def without_stop_words(words: Column, stop: Sequence[str], min_length: int = 2) -> Column:
    """Drop listed words and those shorter than ``min_length``."""
    listed = sorted(set(stop))
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.isin(*listed) if listed else F.length(w) >= min_length)


def clean_characters(text: Column) -> Column:
    """Everything outside plain ASCII text and punctuation to a space, then one space each."""
    kept = F.regexp_replace(text, r"[^a-zA-Z0-9\s.,;:!?'\"()\[\]{}<>/\\@#$%^&*+=_\-|~`]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words between white space, at least one, as splitting a trimmed text gives."""
    return F.size(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, overlaps not counted."""
    if not phrase:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def head(text: Column, limit: int | None = None) -> Column:
    """The first ``limit`` characters where a caller wants only those; the whole text by default."""
    return text if limit is None else F.substring(text, 1, limit)


def strip_tags(html: Column) -> Column:
    """Crude: every tag to a space."""
    return F.regexp_replace(html, "<[^>]+>", " ")


def tidy_description(text: Column, limit: int = 200) -> Column:
    """Drop data URIs, script and style remains; cut; collapse white space."""
    for pattern in (r"data:[^\s]*;base64,[^\s]*", r"var\s+[^=]+=\s*[^;]*;", r"\{--[^}]*\}"):
        text = F.regexp_replace(text, pattern, "")
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def tidy_snippet(text: Column, limit: int = 250, least: int = 150) -> Column:
    """As ``tidy_description``, but without literals and code, and cut at a sentence if one ends late enough."""
    for pattern, new in ((r"data:[^\s]*;base64,[^\s]*", ""), (r"var\s+[^=]+=\s*[^;]*;", ""), (r"\{--[^}]*\}", ""), (r"\{[\"'][^}]*\}", ""), (r"function\s*\([^)]*\)\s*\{[^}]*\}", "[CODE BLOCK]")):
        text = F.regexp_replace(text, pattern, new)
    head = F.substring(text, 1, limit + 2)
    last = F.length(head) - F.instr(F.reverse(head), " .")  # place of the last ". " counted from 1
    cut = F.when((F.instr(F.reverse(head), " .") > 0) & (last - 1 > least), F.substring(text, F.lit(1), last)).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))
    return F.trim(F.regexp_replace(F.when(F.length(text) > limit, cut).otherwise(text), r"\s+", " "))
