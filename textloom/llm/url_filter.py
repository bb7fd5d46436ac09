"""URL filter over a path-template tree, in DataFrame operations only.

Stated host and path rules decide first and are the labels.  Paths of a host
form a tree of segments: lexical classes (numbers, hashes, dates) become
wildcards, and so does a level where most names are new; from the host down,
sibling branches whose labelled shares do not differ statistically are merged;
a template is rejected by its share of blocked labels, smoothed towards what its
parent's branches let expect.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for a host, its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; empty for a null or a text without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule; null if none fits.  Of equals the first wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = r.fits(host, path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _lexical(seg: Column) -> Column:
    """Classes of segments that vary by nature."""
    return (
        F.when(seg.rlike(r"^[0-9]+$"), "{n}")
        .when(seg.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(seg, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(seg.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(seg.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}")
        .when(seg.rlike(r"^[0-9a-fA-F]{12,}$"), "{hex}")
        .otherwise(seg)
    )


def judge(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = 4,
    min_fan: int = 8,
    new_share: float = 0.5,
    z_limit: float = 1.96,
    alpha: float = 4.0,
    reject_above: float = 0.8,
) -> DataFrame:
    """``id, host, path, rule, verdict, template, purity`` of every row.

    The tree has ``depth`` levels; all that lies deeper below a node is one branch,
    ``{...}``.  A level below a node is a wildcard if it has at least ``min_fan``
    names and they number more than ``new_share`` of the distinct paths there.
    At every level, a branch joins the merged branch ``{**}`` of its parent while
    the z statistic of its blocked share against its siblings' stays within
    ``z_limit``; the children of merged branches then count together.  Branches
    without a label are ``{unlabelled}`` and never join labelled ones.

    A node expects of a child the mean of its branches' blocked shares, where each
    unlabelled branch and ``alpha`` more count as what the node's own parent
    expects (the corpus' blocked share above the host).  Branches count once
    whatever their size, so a host whose one large branch is blocked is not
    blocked as a whole.  ``alpha`` pseudo-labels at that value smooth a template's
    purity; above ``reject_above`` it is blocked.

    Null ids, repeated rows and other columns are harmless; an empty table gives
    no rows; long paths are whole in ``path`` and end in ``{...}`` in ``template``.
    Counts are aggregated before every shuffle, so a host with a third of all
    pages is as many rows as it has distinct generalised paths.  Paths with more
    than a thousandth of all pages (fewer than a thousand of them by that) meet
    their verdict by broadcast, all others by a shuffled join.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(rules, F.col("host"), F.col("path"))
    base = base.withColumn("rule", text).withColumn("__given", verdict)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    base = base.withColumn("__segs", F.transform(segments, _lexical))
    base = base.withColumn("__shape", F.concat(F.lit("/"), F.array_join("__segs", "/")))

    shapes = base.groupBy("host", "__shape", "__segs").agg(
        F.count("__given").alias("labelled"), F.count(F.when(F.col("__given") == "block", 1)).alias("blocked"), F.count(F.lit(1)).alias("__pages")
    )
    # cut here and below so that the plan does not double at every level
    shapes = checkpointed(shapes)
    tree = checkpointed(_generalised(shapes, depth, min_fan, new_share))
    known = _purities(tree, depth, z_limit, alpha)

    often = F.broadcast(shapes.agg(F.sum("__pages").alias("__all")))
    known = checkpointed(known.join(often).withColumn("__hot", F.col("__pages") * 1000 > F.col("__all")))
    hot = known.where("__hot").select("host", "__shape", F.col("template").alias("__template"), F.col("purity").alias("__purity"))
    met = base.join(F.broadcast(hot), ["host", "__shape"], "left")
    # rows that have met theirs take keys that nothing has, so that they spread
    key = F.when(F.col("__template").isNull(), F.col("__shape")).otherwise(F.hex(F.monotonically_increasing_id()))
    judged = met.withColumn("__shape", key).join(known.where("not __hot").select("host", "__shape", "template", "purity"), ["host", "__shape"], "left")
    purity = F.coalesce("__purity", "purity")
    verdict = F.coalesce("__given", F.when(purity > reject_above, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("__template", "template").alias("template"), purity.alias("purity"))


def _generalised(shapes: DataFrame, depth: int, min_fan: int, new_share: float) -> DataFrame:
    """``host, __shape, labelled, blocked, __pages, __names``: top down, variable levels as wildcards."""
    tree = shapes.withColumn("__at", F.lit(""))
    for level in range(1, depth + 1):
        name = F.coalesce(F.get("__segs", F.lit(level - 1)), F.lit(""))
        tree = tree.withColumn("__name", name)
        per_name = tree.groupBy("host", "__at", "__name").agg(F.count(F.lit(1)).alias("__k"))
        fan = per_name.groupBy("host", "__at").agg(F.count(F.lit(1)).alias("__fan"), F.sum("__k").alias("__paths"))
        fan = fan.withColumn("__var", (F.col("__fan") >= min_fan) & (F.col("__fan") > new_share * F.col("__paths"))).select("host", "__at", "__var")
        tree = tree.join(fan.where("__var"), ["host", "__at"], "left")
        step = F.when(F.col("__var") & (F.col("__name") != "") & ~F.col("__name").startswith("{"), "{*}").otherwise(F.col("__name"))
        tree = tree.withColumn("__at", F.when(F.col("__name") == "", F.col("__at")).otherwise(F.concat("__at", F.lit("/"), step))).drop("__var", "__name")
    names = F.filter(F.split("__at", "/"), lambda x: x != "")
    names = F.when(F.size("__segs") > depth, F.concat(names, F.array(F.lit("{...}")))).otherwise(names)
    return tree.select("host", "__shape", "labelled", "blocked", "__pages", names.alias("__names"))


def _purities(tree: DataFrame, depth: int, z_limit: float, alpha: float) -> DataFrame:
    """``host, __shape, __pages, template, purity``: similar branches merged level by level, shares smoothed on the way."""
    prior = tree.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("__expect"))
    leaves = tree.groupBy("host", "__names").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    leaves = leaves.join(F.broadcast(prior)).withColumn("__at", F.lit(""))
    share = F.col("b") / F.greatest(F.col("n"), F.lit(1))
    for level in range(1, depth + 2):
        # a path that ended above has no name here; one that ends at this node is its child ""
        name = F.when(F.size("__names") >= level - 1, F.coalesce(F.get("__names", F.lit(level - 1)), F.lit("")))
        leaves = leaves.withColumn("__name", name)
        branch = leaves.where(F.col("__name").isNotNull()).groupBy("host", "__at", "__name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        node = branch.groupBy("host", "__at").agg(
            F.sum("n").alias("__n"), F.sum("b").alias("__b"), F.count(F.lit(1)).alias("__kids"),
            F.count(F.when(F.col("n") > 0, 1)).alias("__known"), F.sum(F.when(F.col("n") > 0, share).otherwise(0.0)).alias("__shares"),
        )
        branch = branch.join(node, ["host", "__at"])
        other_n, other_b = F.col("__n") - F.col("n"), F.col("__b") - F.col("b")
        pooled = F.col("__b") / F.greatest(F.col("__n"), F.lit(1))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("n"), F.lit(1)) + 1 / F.greatest(other_n, F.lit(1))))
        gap = F.abs(share - other_b / F.greatest(other_n, F.lit(1)))
        alike = (F.col("n") > 0) & (other_n > 0) & (gap <= z_limit * spread)
        step = F.when(F.col("__name") == "", "").when(F.col("n") == 0, "/{unlabelled}").when(alike, "/{**}").otherwise(F.concat(F.lit("/"), "__name"))
        branch = branch.select("host", "__at", "__name", step.alias("__step"), "__kids", "__known", "__shares")
        leaves = leaves.join(branch, ["host", "__at", "__name"], "left")
        expect = (F.col("__shares") + (alpha + F.col("__kids") - F.col("__known")) * F.col("__expect")) / (F.col("__kids") + alpha)
        at = F.concat("__at", F.coalesce("__step", F.lit("")))
        leaves = checkpointed(leaves.select("host", "__names", "n", "b", at.alias("__at"), F.coalesce(expect, "__expect").alias("__expect")))
    # paths of one template ended at one node, which expects one value
    merged = leaves.groupBy("host", "__at").agg(((F.sum("b") + alpha * F.max("__expect")) / (F.sum("n") + alpha)).alias("purity"))
    named = tree.join(leaves.select("host", "__names", "__at"), ["host", "__names"]).join(merged, ["host", "__at"])
    return named.select("host", "__shape", "__pages", F.when(F.col("__at") == "", "/").otherwise(F.col("__at")).alias("template"), "purity")
