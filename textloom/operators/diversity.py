"""Likeness by sets of words: neighbours of documents, and one query's best results in diverse order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .graph import stored

# Hosts whose repetition costs less, and terms that favour them.
SOFT_HOSTS = (
    "github.com", "stackoverflow.com", "developer.mozilla.org", "w3schools.com", "freecodecamp.org", "codecademy.com",
    "geeksforgeeks.org", "dev.to", "replit.com", "codesandbox.io", "python.org", "reactjs.org",
)
SOFT_TERMS = ("code", "programming", "python", "javascript", "java", "react", "html", "ai", "css")


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def host_of(url: str) -> str:
    bare = re.sub("^https?://", "", url)
    cut = bare.find("/")
    return re.sub(r"^www\.", "", bare[:cut] if cut > 0 else bare)


def path_alike(a: str, b: str) -> float:
    def clean(p: str) -> str:
        return re.sub(r"\?.*$", "", re.sub(r"/*$", "", p))

    x, y = clean(a), clean(b)
    if not x or not y:
        return 0.0
    p, q = x.split("/"), y.split("/")
    return sum(i == j for i, j in zip(p, q, strict=False)) / max(len(p), len(q))


def features(title: str, url: str, text: str, terms: Sequence[str]) -> set[str]:
    words = [*re.split(r"\W+", title.lower(), flags=re.A), *re.split("[/.-]", re.sub(r"www\.", "", re.sub("https?://", "", url.lower()))), *re.split(r"\W+", text.lower(), flags=re.A)[:300]]
    return {w for w in words if len(w) > 3} | {t.lower() for t in terms}


def rerank(rows: list[dict], terms: Sequence[str]) -> list[int]:
    """Order of the rows (doc_id, url, title, text, score; best first): the first stays, then greedily the best after penalties."""
    if len(rows) <= 1 or len(terms) <= 1:
        return list(range(len(rows)))
    sets = [features(r["title"] or "", r["url"] or "", r["text"] or "", terms) for r in rows]
    urls = [(r["url"] or "").lower() for r in rows]
    hosts = [host_of(u) for u in urls]
    seen: dict[str, int] = {}
    for h in [*hosts, hosts[0]]:
        seen[h] = seen.get(h, 0) + 1
    favoured = any(s in t.lower() for t in terms for s in SOFT_TERMS)
    order, left = [0], list(range(1, len(rows)))
    while left:
        best, at = -1.0, -1
        for i in left:
            alike = [jaccard(sets[i], sets[j]) for j in order]
            top, mean = max(alike), sum(alike) / len(alike)
            penalty = min(0.8, 0.15 * seen.get(hosts[i], 0))
            if hosts[i] in SOFT_HOSTS:
                penalty *= 0.7
            for j in order:
                if hosts[i] == hosts[j] and path_alike(urls[i].replace(hosts[i], ""), urls[j].replace(hosts[j], "")) > 0.7:
                    penalty = min(0.95, penalty + 0.25)
            score = rows[i]["score"] * (1 - (0.9 if top > 0.7 else 0.7) * (0.7 * top + 0.3 * mean)) * (1 - penalty)
            if favoured and hosts[i] in SOFT_HOSTS:
                score *= 1.15
            if score > best:
                best, at = score, i
        if at < 0:
            break
        order.append(at)
        left.remove(at)
        seen[hosts[at]] = seen.get(hosts[at], 0) + 1
    return order


def diversify(results: DataFrame, docs: DataFrame, terms: Sequence[str], k: int = 50) -> DataFrame:
    """``doc_id, score, position`` of all results: the best ``k`` in diverse order, the others after them.

    ``results`` has doc_id and score, and may have query_id; greedy choice is
    sequential, so one query's top ``k`` is one group and nothing larger ever is.  Results
    beyond it have no position: they follow in order of score, then id.
    """
    ship(results.sparkSession)
    by = "query_id"
    keyed = results if by in results.columns else results.withColumn(by, F.lit(0))
    top = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id"))).where(F.col("__n") <= k)
    rows = top.join(docs.select("doc_id", "url", "title", "text"), "doc_id").select(by, "doc_id", "score", "__n", "url", "title", "text")
    names = list(terms)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__n").reset_index(drop=True)
        order = rerank(group.to_dict("records"), names)
        order += [i for i in range(len(group)) if i not in set(order)]
        out = group.loc[order, [by, "doc_id", "score"]].copy()
        out["position"] = range(1, len(out) + 1)
        return out

    first = rows.groupBy(by).applyInPandas(one, f"{by} {dict(rows.dtypes)[by]}, doc_id long, score double, position int")
    # what is left is known by the least of the best, one row a query, so nothing is ranked whole
    last = top.groupBy(by).agg(F.max_by(F.struct("score", "doc_id"), "__n").alias("__last"))
    rest = keyed.join(F.broadcast(last), by).where((F.col("score") < F.col("__last.score")) | ((F.col("score") == F.col("__last.score")) & (F.col("doc_id") > F.col("__last.doc_id"))))
    return first.unionByName(rest.select(by, F.col("doc_id").cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"), F.lit(None).cast("int").alias("position")))


def nearest(sets: DataFrame, queries: DataFrame, k: int = 20, block: int = 20_000, slab: int = 5000, words: int = 4_000_000) -> DataFrame:
    """``query_id, doc_id, jaccard``: of every query the ``k`` most alike documents, itself left out, ties by least id.

    Both tables have doc_id (unique, not null) and w, an array of distinct words;
    null and empty sets are like nothing, and documents without a common word are
    no neighbours.  Words are taken as 64-bit hashes.  Queries form blocks of about
    ``block``, of fewer where they hold over ``words`` words; a block travels to
    the documents as posting lists in packed arrays, each task counts the words
    its documents share with each query, drops all but the best after ``slab``
    documents, and answers with ``k`` rows a query.  No document is exchanged.
    Exact; the work is the number of queries times that of documents, as in any
    search of all rows.
    """
    spark = sets.sparkSession
    ship(spark)
    asked, given = (x.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform("w", lambda w: F.xxhash64(w)).alias("w")) for x in (queries, sets))
    asked = stored(asked).where(F.size("w") > 0)
    n_queries, n_words = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    n_blocks = max(1, -(-n_words // words), -(-n_queries // block))
    given = stored(given) if n_blocks > 1 else given  # read once a block
    found = [_block_nearest(given, asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)) == b), k, slab) for b in range(n_blocks)]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), "doc_id"))
    return reduce(DataFrame.unionAll, found).withColumn("__n", place).where(F.col("__n") <= k).drop("__n")


def _flat(w: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words of each set, and all words; null counts as empty."""
    w = w.combine_chunks() if isinstance(w, pa.ChunkedArray) else w
    return np.asarray(pc.fill_null(pc.list_value_length(w), 0), np.int64), np.asarray(w.flatten(), np.int64)


def _block_nearest(given: DataFrame, asked: DataFrame, k: int, slab: int) -> DataFrame:
    """The ``k`` nearest that each task knows of for every query of a block."""
    table = asked.toArrow()
    sizes, words = _flat(table.column("w"))
    order = np.argsort(words, kind="stable")
    vocabulary, starts = np.unique(words[order], return_index=True)
    lists = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
    block = given.sparkSession.sparkContext.broadcast((np.asarray(table.column("doc_id"), np.int64), sizes, vocabulary, np.r_[starts, len(words)], lists))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, d, j in _nearest_in(*block.value, batches, k, slab):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(j)], ["query_id", "doc_id", "jaccard"])

    return given.mapInArrow(run, "query_id long, doc_id long, jaccard double")


def _nearest_in(ids: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, starts: np.ndarray, lists: np.ndarray, batches: Iterable[pa.RecordBatch], k: int, slab: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``k`` nearest of the sets in ``batches`` to each query, by posting lists of the queries."""
    if not len(vocabulary):
        return
    least = np.zeros(len(ids))  # what the k-th of a query has so far: what is less alike need not wait
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting, held, seen = 0, 0, 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, d, j = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((d, -j, q))
        q, d, j = q[order], d[order], j[order]
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
        last = place == k - 1
        least[q[last]] = j[last]
        return q[place < k], d[place < k], j[place < k]

    for batch in batches:
        lengths, words = _flat(batch.column("w"))
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        known = vocabulary[at] == words
        bounds = np.r_[0, np.cumsum(lengths)]
        for doc, a, b in zip(np.asarray(batch.column("doc_id"), np.int64), bounds[:-1], bounds[1:], strict=True):
            mine = at[a:b][known[a:b]]
            if not len(mine):
                continue
            shared = np.bincount(np.concatenate([lists[starts[i] : starts[i + 1]] for i in mine]), minlength=len(ids))
            alike = shared / (sizes + (b - a) - shared)
            hit = np.flatnonzero((alike >= least) & (shared > 0) & (ids != doc))
            kept.append((hit, np.full(len(hit), doc), alike[hit]))
            waiting += len(hit)
            seen += 1
            if waiting > held + 1_000_000 or (seen >= slab and waiting > held):
                kept, seen = [best()], 0
                held = waiting = len(kept[0][0])
    if waiting:
        q, d, j = best()
        for i in range(0, len(q), 100_000):
            yield ids[q[i : i + 100_000]], d[i : i + 100_000], j[i : i + 100_000]
