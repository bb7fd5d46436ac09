"""Weak supervision of document quality.

Each rule looks at whole-text statistics and votes good (1), bad (-1) or
abstains (0).  The votes of a corpus are at most ``3 ** len(RULES)`` patterns;
their counts over all documents feed an expectation-maximisation that
estimates how each rule votes on good and on bad documents, and a document is
kept by the posterior of its pattern, not by passing every rule: one bad vote
of a rule that is often wrong is outweighed by the others, and a pattern without
any bad vote is dropped if good documents hardly ever abstain like that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, n_files
from .stats import BASE, MORE, document_stats


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions on the statistics; both or neither true: no vote."""

    name: str
    bad: str
    good: str = "false"

    def vote(self) -> Column:
        bad, good = F.expr(self.bad), F.expr(self.good)
        return F.when(bad & ~good, -1).when(good & ~bad, 1).otherwise(0)


#: Several rules see each kind of junk, or nothing but chance would tell it from rare good documents.
RULES: tuple[Rule, ...] = (
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 100 <= n_words"),
    Rule("punctuation", "n_punct * 10 > word_chars", "n_punct * 100 >= word_chars AND n_punct * 16 <= word_chars"),
    Rule("repeats", "n_repeat_words * 5 > n_words", "n_repeat_words * 50 <= n_words"),
    Rule("dup_lines", "n_dup_lines * 5 > n_lines AND n_lines > 4", "n_dup_lines * 20 <= n_lines AND n_lines > 2"),
    Rule("same_next", "n_same_next * 10 > n_words", "n_same_next * 50 <= n_words"),
    Rule("distinct", "n_distinct_words * 100 < 58 * n_words AND n_words <= 2000", "n_distinct_words * 100 >= 65 * n_words AND n_words >= 20"),
    Rule("upper", "n_upper * 3 > word_chars", "n_upper * 10 <= word_chars"),
    Rule("capitals", "n_capital_words * 2 > n_words", "n_capital_words * 5 <= n_words"),
    Rule("bangs", "n_bang * 10 > n_words", "n_bang * 100 <= n_words"),
    Rule("word_length", "word_chars * 2 > 13 * n_words OR word_chars < 3 * n_words", "word_chars * 2 >= 7 * n_words AND word_chars <= 6 * n_words"),
    Rule("few_words", "n_words < 10", "n_words >= 50"),
)


def _with_votes(stats: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``__pattern``: the votes as one base-3 number."""
    code = F.lit(0).cast("long")
    for r in rules:
        code = code * 3 + (r.vote() + 1)
    return stats.withColumn("__pattern", code)


def _votes(pattern: int, n: int) -> list[int]:
    out = []
    for _ in range(n):
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and for good and for bad ones each rule's P(vote) of -1, 0, 1."""

    share: float
    good: tuple[tuple[float, ...], ...]
    bad: tuple[tuple[float, ...], ...]

    def posterior(self, votes: Sequence[int]) -> float:
        z = math.log(1 - self.share) - math.log(self.share)
        for g, b, v in zip(self.good, self.bad, votes, strict=True):
            z += math.log(b[v + 1]) - math.log(g[v + 1])
        return 1 / (1 + math.exp(min(z, 700.0)))

    def accuracies(self) -> list[float]:
        """Estimated share of a rule's votes, abstentions aside, that are right."""
        s = self.share
        return [(s * g[2] + (1 - s) * b[0]) / (s * (g[0] + g[2]) + (1 - s) * (b[0] + b[2])) for g, b in zip(self.good, self.bad, strict=True)]


def first_guess(votes: np.ndarray) -> np.ndarray:
    """Where the estimation starts: 0.95 without a bad vote, 0.6 with some, 0.1 where most votes are bad."""
    bad, cast = (votes == -1).sum(axis=1), (votes != 0).sum(axis=1)
    return np.where(2 * bad > cast, 0.1, np.where(bad > 0, 0.6, 0.95))


def fit_votes(patterns: dict[int, int], n_rules: int, rounds: int = 500, smooth: float = 1.0) -> VoteModel:
    """Expectation-maximisation over counted patterns, until no posterior moves.

    Two classes, good and bad; how often each rule votes bad, abstains and votes
    good in each of them is estimated for every rule alike, none is given.
    ``smooth`` pseudo-votes of each kind, and one more of the right kind, keep
    probabilities off 0 and 1 and the classes by their names; an empty corpus
    gives the pseudo-votes alone.
    """
    votes = np.array([_votes(p, n_rules) for p in sorted(patterns)], np.int64).reshape(len(patterns), n_rules)
    count = np.array([patterns[p] for p in sorted(patterns)], np.float64)
    post = first_guess(votes)
    for _ in range(rounds):
        tables = []
        for mine, right in ((post * count, 1), (count - post * count, -1)):
            seen = np.stack([mine @ (votes == v) + smooth * (1 + (v == right)) for v in (-1, 0, 1)], axis=1)
            tables.append(seen / seen.sum(axis=1, keepdims=True))
        share = (float(post @ count) + 1) / (count.sum() + 2)
        rules = np.arange(n_rules)
        logs = [np.log(t)[rules, votes + 1].sum(axis=1) for t in tables]
        new = 1 / (1 + np.exp(np.minimum(math.log(1 - share) - math.log(share) + logs[1] - logs[0], 700.0)))
        moved = float(np.abs(new - post).max(initial=0.0))
        post = new
        if moved < 1e-9:
            break
    return VoteModel(share, *(tuple(map(tuple, t.tolist())) for t in tables))


def quality_votes(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, ``quality`` (posterior) and ``is_good`` of every row.

    The statistics, a few numbers a document, are computed once and checkpointed;
    the fit counts their patterns over all documents, at most ``3 ** len(rules)``
    rows whatever the corpus holds.  Null texts count as empty; null ids, repeated
    rows and empty tables pass through; other columns are ignored; a text of any
    length is looked at whole; at a posterior of just ``threshold`` a document is good.
    """
    stats = checkpointed(document_stats(docs, BASE + MORE, id_col, text_col), n_files(docs))
    voted = _with_votes(stats, rules)
    counts = {int(r[0]): int(r[1]) for r in voted.groupBy("__pattern").count().collect()}
    model = fit_votes(counts, len(rules))
    z = F.lit(math.log(1 - model.share) - math.log(model.share))
    for rule, g, b in zip(rules, model.good, model.bad, strict=True):
        z = z + F.element_at(F.array(*(F.lit(math.log(y) - math.log(x)) for x, y in zip(g, b, strict=True))), rule.vote() + 2)
    return voted.withColumn("quality", 1 / (1 + F.exp(F.least(z, F.lit(700.0))))).withColumn("is_good", F.col("quality") >= threshold).drop("__pattern")
