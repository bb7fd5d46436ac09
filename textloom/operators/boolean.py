"""Sets of documents by terms: and, or, not, and relaxed matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having_term(post: DataFrame, term: str) -> DataFrame:
    return post.where(F.col("term") == term).select("doc_id").distinct()


def both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "doc_id", "left_semi").distinct()


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("doc_id").union(right.select("doc_id")).distinct()


def first_only(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "doc_id", "left_anti").distinct()


def combined(sides: Sequence[DataFrame], operator: str) -> DataFrame:
    """AND and OR over all sides, NOT as the first without the second."""
    if operator == "NOT":
        return first_only(sides[0], sides[1])
    return reduce(both if operator == "AND" else either, sides).distinct()


def match_counts(post: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``doc_id, n_matched``: distinct query terms in each document that has any."""
    return post.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n_matched"))


def all_terms(scored: DataFrame, terms: Sequence[str], score: str = "tf_idf") -> DataFrame:
    """Documents with every term, by the sum of a score."""
    hit = scored.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.countDistinct("term").alias("n_matched"), F.sum(score).alias("score"))
    return hit.where(F.col("n_matched") == len(set(terms))).select("doc_id", "score")


def relaxed(post: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents with all terms; if there are none, with half of them (rounded down, one at least).

    Should that leave nothing, the tenth or the best fifth by matches, whichever is more.
    """
    counts = match_counts(post, terms)
    k = len(set(terms))
    least = max(1, k // 2)
    # one row of counts comes first: then each case is a filter, and only the last one sorts
    full, half, some = counts.agg(F.count(F.when(F.col("n_matched") == k, 1)), F.count(F.when(F.col("n_matched") >= least, 1)), F.count(F.lit(1))).first()
    if full:
        return counts.where(F.col("n_matched") == k)
    if half:
        return counts.where(F.col("n_matched") >= least)
    return counts.orderBy(F.col("n_matched").desc(), "doc_id").limit(max(10, some // 5))
