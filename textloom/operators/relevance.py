"""Relevance of keyword queries: the short-circuit score, proximity, density, and the two blended rankers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..functions.url import domain
from .index import bm25_tf

# Words that mark a query as about products, and the urls it may then keep.
PRODUCT_WORDS = "buy price shop store product purchase".split()
PRODUCT_URLS = ("/product/", "/shop/product", "product-", "apple.com/shop")


def live(docs: DataFrame, post: DataFrame, stats: DataFrame, terms: Sequence[str], matches: DataFrame | None = None) -> DataFrame:
    """``doc_id, score``: ordered short cuts, then tf-idf.

    No terms: 0; under 50 words: 0.01; the query in the title: 1000; several
    terms all in the url: 500; all in the title: 300; else the sum of
    min(tf, 0.1) * idf with title and url boosts, a tenth if under half of the terms
    were found, thrice if the text holds the query.
    """
    terms = list(terms)
    base = docs if matches is None else docs.join(matches, "doc_id", "left_semi")
    if not terms:
        return base.select("doc_id", F.lit(0.0).alias("score"))
    title, url, text = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "url", "text"))
    words = word_count(text)
    query = " ".join(terms).lower()
    distinct = sorted(set(terms))
    hit = post.where(F.col("term").isin(*distinct)).join(F.broadcast(stats.where(F.col("term").isin(*distinct)).select("term", "idf_plain")), "term")
    if matches is not None:
        hit = hit.join(matches, "doc_id", "left_semi")
    own = hit.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("frequency", "idf_plain")))).alias("__f"))
    rows = base.join(own, "doc_id", "left")
    total, found = F.lit(0.0), F.lit(0)
    for t in terms:
        f = F.element_at("__f", F.lit(t))
        gain = F.least(f["frequency"] / F.greatest(F.lit(1), words), F.lit(0.1)) * f["idf_plain"]
        boost = 1.0 + F.when(title.contains(t.lower()), 3.0).otherwise(0.0) + F.when(url.contains(t.lower()), 2.0).otherwise(0.0)
        total = total + F.coalesce(gain * boost, F.lit(0.0))
        found = found + F.when(f.isNotNull(), 1).otherwise(0)
    total = total * F.when(found < len(terms) // 2, 0.1).otherwise(1.0)
    if len(terms) > 1:
        total = total * F.when(text.contains(query), 3.0).otherwise(1.0)
    every = lambda c: F.lit(True) if not terms else _all(c.contains(t.lower()) for t in terms)
    score = F.when(words < 50, 0.01).when(title.contains(query), 1000.0)
    if len(terms) > 1:
        score = score.when(every(url), 500.0)
    return rows.select("doc_id", score.when(every(title), 300.0).otherwise(total).alias("score"))


def _all(tests) -> Column:  # noqa: ANN001
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def proximity(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """``doc_id, bonus``: 2, 1 or 0.5 if two different terms come within 3, 10 or 50 words, else 0.

    A word counts for a term it contains.  Only hits are exploded; neighbours are
    compared by one ordered window over a document's hits.
    """
    from pyspark.sql import Window

    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")), " ")
    names = [t.lower() for t in dict.fromkeys(terms)]
    each = docs.select("doc_id", F.posexplode(words).alias("pos", "word"))
    hits = each.select("doc_id", "pos", F.explode(F.filter(F.array(*(F.lit(t) for t in names)), lambda t: F.col("word").contains(t))).alias("term"))
    # the nearest earlier hit of another term is the last hit of each other term
    w = Window.partitionBy("doc_id").orderBy("pos", "term")
    gaps = []
    for t in names:
        last = F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(w)
        gaps.append(F.when(F.col("term") != t, F.col("pos") - last))
    gap = F.least(*gaps) if len(gaps) > 1 else F.lit(None).cast("int")
    near = hits.select("doc_id", gap.alias("gap")).groupBy("doc_id").agg(F.min("gap").alias("gap"))
    bonus = F.when(F.col("gap") <= 3, 2.0).when(F.col("gap") <= 10, 1.0).when(F.col("gap") <= 50, 0.5).otherwise(0.0)
    return docs.select("doc_id").join(near, "doc_id", "left").select("doc_id", F.coalesce(bonus, F.lit(0.0)).alias("bonus"))


def drop_product_pages(results: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Shop pages go unless the query is about products; so do rows without url or title."""
    if any(t.lower() in PRODUCT_WORDS for t in terms):
        return results
    shop = F.lit(False)
    for part in PRODUCT_URLS:
        shop = shop | F.col("url").contains(part)
    return results.where(F.col("url").isNotNull() & F.col("title").isNotNull() & ~shop)


def density(post: DataFrame, lengths: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``doc_id, density``: 100 times the share of query terms, a fifth more above 0.05; 0 for an empty document."""
    hit = post.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.sum("frequency").alias("f"))
    d = 100.0 * F.coalesce("f", F.lit(0)) / F.col("n_terms")
    d = F.when(F.col("n_terms") > 0, d * F.when(d > 0.05, 1.2).otherwise(1.0)).otherwise(0.0)
    return lengths.join(hit, "doc_id", "left").select("doc_id", d.alias("density"))


def weighted_tfidf(post: DataFrame, stats: DataFrame, terms: Sequence[str], with_phrase: DataFrame | None = None, boost: float = 3.0) -> DataFrame:
    """tf * smooth idf * ln(1 + importance), term after term; a phrase document's running sum is boosted after each term it has."""
    hit = post.where(F.col("term").isin(*terms)).join(F.broadcast(stats.where(F.col("term").isin(*terms)).select("term", "idf_smooth")), "term")
    own = hit.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("tf") * F.col("idf_smooth") * F.ln(1 + F.col("importance"))).alias("g")))).alias("g"))
    own = own.withColumn("__p", F.lit(False)) if with_phrase is None else own.join(with_phrase.select("doc_id", F.lit(True).alias("__p")), "doc_id", "left")
    fold = F.aggregate(
        F.array(*(F.lit(t) for t in terms)), F.lit(0.0),
        lambda acc, t: F.when(F.element_at("g", t).isNull(), acc).otherwise((acc + F.element_at("g", t)) * F.when(F.coalesce("__p", F.lit(False)), boost).otherwise(1.0)),
    )
    return own.select("doc_id", fold.alias("relevance"))


def fallback_relevance(post: DataFrame, stats: DataFrame, lengths: DataFrame, terms: Sequence[str]) -> DataFrame:
    """BM25 tf at a fixed average of 500 times the boosted idf; quoted, short and programming terms weigh more."""
    bare = [t.strip('"') for t in terms]
    wanted = F.col("term").isin(*(t.lower() for t in bare))
    # the statistics of the query's terms only: as many rows as the query has words
    rows = post.where(wanted).join(F.broadcast(stats.where(wanted).select("term", "idf_boosted")), "term").join(lengths, "doc_id")
    score = F.lit(0.0)
    for raw, t in zip(terms, bare, strict=True):
        quoted = raw.startswith('"') and raw.endswith('"') and len(raw) > 1
        weight = (3.0 if quoted else 1.0) * 2.0 * (2.0 if quoted and len(t) <= 2 else 1.0) * 1.5
        score = score + F.when(F.col("term") == t.lower(), weight * bm25_tf(F.col("frequency"), F.col("n_terms"), F.lit(500.0)) * F.col("idf_boosted")).otherwise(0.0)
    return rows.groupBy("doc_id").agg(F.sum(score).alias("relevance"))


def url_boosts(relevance: DataFrame, docs: DataFrame, post: DataFrame, terms: Sequence[str], quoted: bool = False) -> DataFrame:
    """Boosts for the share of terms found, and for the first term in url or host."""
    names = [t.strip('"').lower() for t in terms]
    found = post.where(F.col("term").isin(*names)).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))
    rows = relevance.join(docs.select("doc_id", F.lower("url").alias("u")), "doc_id").join(found, "doc_id", "left")
    share = F.coalesce("n", F.lit(0)) / len(names)
    host, query, first = F.regexp_replace(domain(F.col("u")), r"www\.", ""), " ".join(names), names[0]
    score = F.col("relevance") * F.when(share > 0.5, 1 + share).otherwise(1.0)
    if len(names) > 1:
        score = score * F.when(share == 1, 2.5).otherwise(1.0)
    score = score * F.when(F.col("u").contains(first), 2.0 * (1.5 if quoted else 1.0)).otherwise(1.0)
    score = score * F.when((host != "") & (F.lit(query).contains(host) | host.contains(query)), 2.0).otherwise(1.0)
    if len(first) > 3:
        score = score * F.when(host.contains(first), 1.5).otherwise(1.0)
    return rows.select("doc_id", score.alias("relevance"))


def blend(relevance: DataFrame, ranks: DataFrame, dense: DataFrame, weights: tuple[float, float, float] = (0.75, 0.10, 0.15)) -> DataFrame:
    """``doc_id, score``: relevance, link rank and density, each over its largest (1e-6 at least), weighted.

    The default weights are those any ordinary query gets; (.7, .2, .1) is the base.
    """
    rows = ranks.select(F.col("id").alias("doc_id"), "rank").join(relevance, "doc_id", "left").join(dense, "doc_id", "left")
    rows = rows.select("doc_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("relevance", "rank", "density")))
    tops = rows.agg(*(F.greatest(F.max(c), F.lit(1e-6)).alias(f"top_{c}") for c in ("relevance", "rank", "density")))
    score = sum((w * F.col(c) / F.col(f"top_{c}") for w, c in zip(weights[1:], ("rank", "density"), strict=True)), weights[0] * F.col("relevance") / F.col("top_relevance"))
    return rows.join(F.broadcast(tops)).select("doc_id", score.alias("score"))


def field_weighted(fields: DataFrame, stats: DataFrame, lengths: DataFrame, ranks: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Second ranker: title, heading and text counts weigh 3, 2, 1; 0.7 relevance and 0.3 link rank; whole-number order."""
    weight = F.when(F.col("tag") == "title", 3.0).when(F.col("tag").isin("h1", "h2", "h3"), 2.0).otherwise(1.0)
    hit = fields.where(F.col("term").isin(*terms)).groupBy("term", "doc_id").agg(F.sum(weight * F.col("frequency")).alias("wf"))
    hit = hit.join(F.broadcast(stats.where(F.col("term").isin(*terms)).select("term", "idf_ln")), "term").join(lengths, "doc_id")
    rel = hit.groupBy("doc_id").agg(F.sum(F.col("wf") / F.greatest(F.col("n_terms"), F.lit(1)) * F.col("idf_ln")).alias("relevance"))
    rows = ranks.select(F.col("id").alias("doc_id"), "rank").join(rel, "doc_id", "left")
    return rows.select("doc_id", (0.7 * F.coalesce("relevance", F.lit(0.0)) + 0.3 * F.col("rank")).alias("score"))


def whole_number_order(scored: DataFrame) -> DataFrame:
    """Second ranker's order: by the whole part of the score, then id, so most scores tie."""
    return scored.orderBy(F.col("score").cast("int").desc(), "doc_id")


def term_weight(term: str, query: str) -> float:
    """2 for a term that the query holds, else 1."""
    return 2.0 if term.lower() in query.lower() else 1.0
