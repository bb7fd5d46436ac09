"""Phrases: by positions, by literal text, and combined by and, or, not."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences, word_count
from . import boolean


def positional(tokens: DataFrame, words: Sequence[str], strict: bool = False) -> DataFrame:
    """Documents where the words follow one another.

    Every token votes for the place its phrase would begin; a start with all
    votes is a hit.  By default the words must share an element; ``strict`` leaves
    that out.
    """
    places = [F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)]
    votes = tokens.where(F.col("term").isin(*words)).select("doc_id", "element_no", "position", F.explode(F.filter(F.array(*places), lambda p: p["w"] == F.col("term"))).alias("p"))
    keys = ["doc_id"] if strict else ["doc_id", "element_no"]
    starts = votes.groupBy(*keys, (F.col("position") - F.col("p.i")).alias("start")).agg(F.countDistinct("p.i").alias("n"))
    return starts.where(F.col("n") == len(words)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"))


def literal(docs: DataFrame, post: DataFrame, phrase: str, stop: Sequence[str], candidates: int | None = None, limit: int | None = None, form: Callable[[str], str] = str) -> DataFrame:
    """Documents with the phrase in title or text, found through the postings of its first meaningful word.

    ``form`` turns a word into the index's term (a stemmer for a stemmed index).
    ``candidates`` and ``limit`` cut, in order of id, only if given.
    """
    words = phrase.lower().split()
    probe = next((w for w in words if w not in set(stop)), words[0] if words else "")
    near = boolean.having_term(post, form(probe))
    near = near.orderBy("doc_id").limit(candidates) if candidates else near
    low = phrase.lower()
    found = docs.join(near, "doc_id", "left_semi").where(F.lower("text").contains(low) | F.lower("title").contains(low))
    return found.orderBy("doc_id").limit(limit) if limit else found


def literal_score(phrase: str, first_paragraph: Column | None = None) -> Column:
    """1; thrice with the title, (1 + ln n) for n > 1 hits, half more in the first paragraph, twice in the url."""
    low = phrase.lower()
    n = occurrences(F.lower("text"), low)
    score = F.lit(1.0) * F.when(F.lower("title").contains(low), 3.0).otherwise(1.0)
    score = score * F.when(n > 1, 1 + F.ln(n)).otherwise(1.0)
    if first_paragraph is not None:
        score = score * F.when(F.lower(first_paragraph).contains(low), 1.5).otherwise(1.0)
    return score * F.when(F.lower("url").contains(low.replace(" ", "-")), 2.0).otherwise(1.0)


def stripped(phrase: str, stop: Sequence[str]) -> list[str]:
    return [w for w in phrase.lower().split() if w not in set(stop)]


def combine(docs: DataFrame, post: DataFrame, phrases: Sequence[str], operator: str, stop: Sequence[str], form: Callable[[str], str] = str) -> DataFrame:
    """``doc_id`` of the phrases' documents under AND, OR or NOT (the first two phrases only)."""
    sides = []
    for p in phrases:
        words = stripped(p, stop)
        sides.append(literal(docs, post, " ".join(words), stop, form=form).select("doc_id") if words else docs.select("doc_id").limit(0))
    return boolean.combined(sides, operator)


def mixed(docs: DataFrame, post: DataFrame, parts: Sequence[tuple[str, bool]], operator: str, stop: Sequence[str], form: Callable[[str], str] = str) -> DataFrame:
    """As ``combine``, for parts that need not be quoted: (text, quoted).

    An unquoted part asks for all of its words; under NOT, documents whose title or
    text holds the second part literally go as well, whatever the index says.
    """
    sides = []
    for text, quoted in parts:
        words = stripped(text, stop)
        if quoted and words:
            sides.append(literal(docs, post, text, stop, form=form).select("doc_id"))
        elif words:
            counts = boolean.match_counts(post, [form(w) for w in words])
            sides.append(counts.where(F.col("n_matched") == len({form(w) for w in words})).select("doc_id"))
        else:
            sides.append(docs.select("doc_id").limit(0))
    out = boolean.combined(sides, operator)
    if operator == "NOT":
        low = parts[1][0].lower()
        out = boolean.first_only(out, docs.where(F.lower("text").contains(low) | F.lower("title").contains(low)).select("doc_id"))
    return out


def combined_score(matches: DataFrame, docs: DataFrame, post: DataFrame, stats: DataFrame, phrases: Sequence[str], stop: Sequence[str], form: Callable[[str], str] = str) -> DataFrame:
    """tf times plain idf word after word, four times if the title has it, doubled after each phrase found whole.

    A word that the index knows but the document lacks ends the sum where it is.
    """
    order = [(i, w) for i, p in enumerate(phrases) for w in [*stripped(p, stop), None]]
    words = sorted({form(w) for _, w in order if w})
    wanted = post.where(F.col("term").isin(*words)).join(F.broadcast(stats.where(F.col("term").isin(*words)).select("term", "idf_plain")), "term")
    known = stats.where(F.col("term").isin(*words)).agg(F.collect_set("term").alias("__known"))
    freq = wanted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("frequency", "idf_plain")))).alias("__f"))
    rows = docs.join(matches, "doc_id", "left_semi").join(freq, "doc_id", "left").join(F.broadcast(known))
    title, text = F.lower("title"), F.lower("text")
    length = word_count(text)
    steps = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(None if w is None else form(w)).cast("string").alias("t"), F.lit(i).alias("i")) for i, w in order))
    whole = F.array(*(title.contains(p.lower()) | text.contains(p.lower()) for p in phrases))
    state = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        own = F.element_at("__f", s["t"])
        gain = own["frequency"] / length * own["idf_plain"]
        known_word = F.array_contains("__known", s["t"])
        missing = known_word & own.isNull()
        new = (
            F.when(acc["done"], acc["score"])
            .when(s["w"].isNull(), F.when(F.element_at(whole, s["i"] + 1), acc["score"] * 2.0).otherwise(acc["score"]))
            .when(own.isNull(), acc["score"])
            .otherwise(acc["score"] + gain + F.when(title.contains(s["w"]), gain * 3.0).otherwise(0.0))
        )
        return F.struct(new.alias("score"), (acc["done"] | F.coalesce(missing, F.lit(False))).alias("done"))

    return rows.select("doc_id", F.aggregate(steps, state, step)["score"].alias("score"))
