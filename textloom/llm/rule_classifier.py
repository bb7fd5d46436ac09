"""Quality classifier: a sparse ensemble of rules over document statistics.

Small boosted trees are grown on a bounded sample of labelled documents; every
path from a root to a node is a conjunction of thresholds, that is a rule; a
lasso logistic regression weighs the rules and drops most; what is left is
compiled to one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import aside, free_name, ship
from .stats import BASE, MORE, stats_struct

#: SQL over the statistics; every one is defined for an empty text.
FEATURES: dict[str, str] = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "punct": "n_punct / greatest(word_chars, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "same_next": "n_same_next / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "bangs": "n_bang / greatest(n_words, 1)",
    "capitals": "n_capital_words / greatest(n_words, 1)",
    "longest_word": "longest_word",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}
SAMPLE_ROWS = 20_000

Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """``bias`` and weighted conjunctions of (feature, above, threshold)."""

    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...] = field(default=())

    def matrix(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return np.array([_holds(c, x, n) for _, c in self.rules]).reshape(len(self.rules), n).T

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = self.bias + self.matrix(x) @ np.array([w for w, _ in self.rules])
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str) -> Column:
        """Probability of label 1 from the struct column ``stats``."""
        z = F.lit(self.bias)
        for weight, conditions in self.rules:
            test = F.lit(True)
            for name, above, limit in conditions:
                value = _feature(name, stats)
                test = test & ((value > limit) if above else (value <= limit))
            z = z + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _feature(name: str, stats: str) -> Column:
    sql = re.sub(r"\b(" + "|".join(BASE + MORE) + r")\b", lambda m: f"`{stats}`.{m[1]}", FEATURES[name])
    return F.expr(sql).cast("double")


def _holds(conditions: Sequence[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, above, limit in conditions:
        out &= (x[name] > limit) if above else (x[name] <= limit)
    return out


def _cuts(v: np.ndarray, bins: int = 24) -> np.ndarray:
    """Thresholds half way between neighbouring quantiles."""
    u = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))
    return (u[1:] + u[:-1]) / 2 if len(u) > 1 else np.zeros(0)


def _tree_rules(x: dict[str, np.ndarray], grad: np.ndarray, hess: np.ndarray, cuts: dict[str, np.ndarray], codes: dict[str, np.ndarray], depth: int, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths of a regression tree on second-order gains, and its step for every row."""
    step = np.zeros(len(grad))
    paths: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        step[rows] = -g / (h + 1.0)
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, "", 0)
        for name, edge in cuts.items():
            if not len(edge):
                continue
            c = codes[name][rows]
            gl = np.cumsum(np.bincount(c, grad[rows], len(edge) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, hess[rows], len(edge) + 1))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=len(edge) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), name, k)
        if not best[1]:
            return
        _, name, k = best
        left = codes[name][rows] <= k
        limit = float(cuts[name][k])
        grow(rows[left], (*path, (name, False, limit)))
        grow(rows[~left], (*path, (name, True, limit)))

    grow(np.arange(len(grad)), ())
    return paths, step


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1 logistic regression by accelerated proximal steps; the bias is free."""
    n, k = r.shape
    scale = 0.25 * (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2) / n
    w, b = np.zeros(k), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(r @ vw + vb, -30, 30)))
        e = (p - y) / n
        nw = vw - (r.T @ e) / scale
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / scale, 0)
        nb = vb - e.sum() / scale
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3) -> RuleModel:
    """Fit on arrays; with fewer than two classes the score is the smoothed share."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    if n < 20 or not 0 < y.sum() < n:
        return RuleModel(bias)
    cuts = {k: _cuts(v) for k, v in x.items()}
    codes = {k: np.searchsorted(cuts[k], v, "left") for k, v in x.items()}
    z, rules = np.full(n, bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, step = _tree_rules(x, p - y, p * (1 - p), cuts, codes, depth, max(5, n // 500))
        z = z + 0.5 * step
        rules.update(dict.fromkeys(paths))
    columns, kept = [], []
    seen = set()
    for path in sorted(rules, key=lambda c: (len(c), c)):
        hit = _holds(path, x, n)
        if 0 < hit.sum() < n and (key := hit.tobytes()) not in seen:
            seen.add(key)
            columns.append(hit)
            kept.append(path)
    if not kept:
        return RuleModel(bias)
    r = np.array(columns, np.float64).T
    b, w = _lasso(r, y.astype(np.float64), penalty)
    use = np.flatnonzero(np.abs(w) > 1e-6)
    if len(use):  # the weights again without shrinking, only a little, to undo the penalty's bias
        b, w2 = _lasso(r[:, use], y.astype(np.float64), penalty / 20)
        return RuleModel(b, tuple((float(v), kept[i]) for v, i in zip(w2, use, strict=True) if abs(v) > 1e-6))
    return RuleModel(b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample`` labelled documents, drawn by a hash of the id.

    Labels that are null or whose id is null are left out; of repeated labels the
    least counts, of rows that repeat an id the first text in order.  The sample is
    broadcast (its size is bounded); the statistics of its documents come back to the
    driver, ``sample`` rows of numbers.  Null and empty texts count with the
    statistics of an empty one, texts of any length whole; without labelled documents,
    or with labels of one kind, the score is one smoothed share for all.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    chosen = chosen.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id", "__y").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))  # one row for each label
    got = rows.select(stats_struct(F.col("__text")).alias("s"), "__y", "__id").select("__id", "__y", *(_feature(f, "s").alias(f) for f in FEATURES)).toPandas().sort_values("__id")
    return fit_rules({f: got[f].to_numpy(np.float64) for f in FEATURES}, got["__y"].to_numpy())


def with_score(docs: DataFrame, model: RuleModel, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` and the score of each row.

    A null text counts as empty; null ids, repeated rows and ties of the score are
    kept as they are; a column of the score's name is moved aside to
    ``<name>_input``; an empty table stays empty; a text of any length is scored whole.
    """
    ship(docs.sparkSession)
    docs = aside(docs, name)
    s = free_name(docs, "__textloom_stats")
    return docs.withColumn(s, stats_struct(F.col(text_col))).withColumn(name, model.column(s)).drop(s)
