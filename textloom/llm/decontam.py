"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A seed is three words of a test item in order, with up to two of the item's words
left out between them, and it meets any three words of a document with up to two
more between them.  That loses nothing at the default share: an alignment whose
score is half of the item's full one has no more edits than matches, and no test
item of eight words or more can reach it with under eight matches, so somewhere
three matches in a row have two edits or fewer between them.  Shorter items count only
where they stand whole, and so do items of one or two words, which are their own seeds.

A document that shares a seed with an item gets the passage around it, as far
as such an alignment can reach, compared with the item: first how many of the
item's words the passage holds at all, which bounds the score; then, if that
leaves it possible, word by word with gaps.  It counts as leaked if the local
score reaches a share of the item's own, so edits and paraphrases of single words
do not hide a copy.

Test items are the query set.  They travel to the executors in blocks of at
most ``BLOCK_BYTES`` of text; a larger benchmark takes more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import Block, as_bytes, mix
from .license_scan import normal
from .runtime import free_name, ragged, ship, trim

BLOCK_BYTES = 8 << 20
SEED_WORDS = 3
MATCH, MISS, GAP = 2, -1, -1
SHARE = 0.5
LEAST_WORDS = 8

_BITS = 22
_PLACE = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: How far the second word is from the first, and the third from the second: two words at most left out.
SPREADS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
CELLS = 4 << 20  # cells of the alignments that advance together


@dataclass
class Items:
    """Words of some test items and their seeds."""

    ids: list[int | None]
    words: list[np.ndarray]
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        """Items without a word have no seed and are left out."""
        ids, words, keys, owner, place = [], [], [], [], []
        for item, text in rows:
            w = Block([normal((text or "").encode())]).word_hash()
            for g, at in _seeds(w, np.array([len(w)]), np.zeros(1, np.int64), {len(w)}):
                keys.append(g)
                owner.append(np.full(len(g), len(ids)))
                place.append(at)
            if len(w):
                ids.append(item)
                words.append(w)
        if not ids:
            return cls([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        k, o, p = np.concatenate(keys), np.concatenate(owner), np.concatenate(place)
        by = np.argsort(k, kind="stable")
        return cls(ids, words, k[by], o[by], p[by])


def _seeds(words: np.ndarray, sizes: np.ndarray, first: np.ndarray, lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and first words of the seeds of some texts, kind by kind.

    ``sizes`` and ``first``: words of each text and the number of its first one;
    ``lengths``: how long the items are, as seeds of one or two words are for items of
    just that length.
    """

    def begins(span: int) -> np.ndarray:
        counts = np.maximum(sizes - span + 1, 0)
        return np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)

    if any(n >= SEED_WORDS for n in lengths):
        for a, b in SPREADS:
            at = begins(a + b + 1)
            yield mix(words[at] * _PLACE[0] + words[at + a] * _PLACE[1] + words[at + a + b] * _PLACE[2]), at
    if 2 in lengths:
        at = begins(2)
        yield mix(words[at] * _PLACE[1] + words[at + 1] * _PLACE[0]), at
    if 1 in lengths:
        yield mix(words * _PLACE[2]), np.arange(len(words))


def _lookup(grams: np.ndarray, keys: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places in ``grams`` of values that ``keys`` holds."""
    near = np.flatnonzero(sieve[(grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, grams[near]), len(keys) - 1)
    return near[keys[at] == grams[near]]


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _BITS, bool)
    out[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return out


def _blocks(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, Block]]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < limit):
            size += len(texts[end])
            end += 1
        yield begin, Block(texts[begin:end])
        begin = end


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each pair, and one past its last word in the item and in the passage.

    All pairs advance together, one word of the item at a time; of equal scores the
    first end counts.
    """
    n, rows, cols = len(items), max(map(len, items), default=0), max(map(len, passages), default=0)
    q = np.zeros((n, rows), np.uint64)
    d = np.zeros((n, cols), np.uint64)
    for i, (a, b) in enumerate(zip(items, passages, strict=True)):
        q[i, : len(a)] = a
        d[i, : len(b)] = b
    inside = np.arange(cols) < np.array([len(p) for p in passages])[:, None]
    ramp = np.arange(cols + 1, dtype=np.int32)
    h = np.zeros((n, cols + 1), np.int32)
    best, at_q, at_d = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    length = np.array([len(a) for a in items])
    for r in range(rows):
        hit = (d == q[:, r : r + 1]) & inside
        step = h[:, :-1] + np.where(hit, MATCH, MISS).astype(np.int32)
        new = np.zeros_like(h)
        np.maximum(step, h[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - GAP * ramp, axis=1) + GAP * ramp
        h = np.where((r < length)[:, None], new, 0)
        top = h.max(axis=1)
        better = top > best
        if better.any():
            best[better] = top[better]
            at_q[better] = r + 1
            at_d[better] = h[better].argmax(axis=1)
    return best, at_q, at_d


def _leaks(texts: list[bytes], items: Items, sieve: np.ndarray, share: float) -> list[list[tuple[int | None, float, int, int]]]:
    """For each text its leaked items: id, share of the full score, first word, one past the last."""
    out: list[list[tuple[int | None, float, int, int]]] = [[] for _ in texts]
    if not len(items.keys):
        return out
    sizes = np.array([len(w) for w in items.words])
    lengths = set(sizes.tolist())
    need = np.maximum(share * MATCH * sizes, MATCH * np.minimum(sizes, LEAST_WORDS))
    for base, block in _blocks([normal(t) for t in texts]):
        words = block.word_hash()
        spots: list[np.ndarray] = []
        for grams, begin in _seeds(words, block.n_words, block.first[:-1], lengths):
            hits = _lookup(grams, items.keys, sieve)
            lo, hi = np.searchsorted(items.keys, grams[hits]), np.searchsorted(items.keys, grams[hits], "right")
            times = hi - lo
            seed = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            begin = np.repeat(begin[hits], times)
            d, item = np.searchsorted(block.first, begin, "right") - 1, items.owner[seed]
            # one passage for each document, item and run of diagonals as long as the item
            tile = np.floor_divide(begin - block.first[d] - items.place[seed], sizes[item])
            spots.append(np.unique(np.stack([d, item, tile], 1), axis=0))
        spot = np.unique(np.concatenate(spots), axis=0) if spots else np.zeros((0, 3), np.int64)
        if not len(spot):
            continue
        # as far as an alignment can reach that goes through one of the diagonals: an item's length either way
        m = sizes[spot[:, 1]]
        first, last = block.first[spot[:, 0]], block.first[spot[:, 0] + 1]
        begin, end = np.maximum(first, first + (spot[:, 2] - 1) * m), np.minimum(last, first + (spot[:, 2] + 3) * m)
        possible = _possible(items, spot[:, 1], words, begin, end, need)
        spot, begin, end = spot[possible], begin[possible], end[possible]
        by = np.argsort(end - begin, kind="stable")
        spot, begin, end = spot[by], begin[by], end[by]
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        a = 0
        while a < len(spot):
            z = a + 1
            while z < len(spot) and (z + 1 - a) * int(end[z] - begin[z]) <= CELLS and z - a < 256:
                z += 1
            some, start, passages = spot[a:z], begin[a:z] - block.first[spot[a:z, 0]], [words[s:e] for s, e in zip(begin[a:z].tolist(), end[a:z].tolist(), strict=True)]
            a = z
            q = [items.words[i] for i in some[:, 1]]
            score, end_q, end_d = align(q, passages)
            good = np.flatnonzero(score >= need[some[:, 1]])
            if not len(good):
                continue
            _, _, back_d = align([q[g][: end_q[g]][::-1] for g in good], [passages[g][: end_d[g]][::-1] for g in good])
            for g, b in zip(good.tolist(), back_d.tolist(), strict=True):
                t, i, _ = some[g].tolist()
                value = (float(score[g]) / (MATCH * int(sizes[i])), int(start[g] + end_d[g]) - b, int(start[g] + end_d[g]))
                if (t, i) not in found or (-value[0], value[1]) < (-found[t, i][0], found[t, i][1]):
                    found[t, i] = value
        for (t, i), value in sorted(found.items()):
            out[base + t].append((items.ids[i], *value))
    return out


def _possible(items: Items, item: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether a passage holds enough of its item's words for the score needed, whatever their order."""
    out = np.zeros(len(item), bool)
    by = np.argsort(item, kind="stable")
    cuts = np.flatnonzero(np.diff(item[by])) + 1
    for mine in np.split(by, cuts):
        q = items.words[item[mine[0]]]
        least = need[item[mine[0]]] / MATCH
        # each distinct word of the item, and how often it has it
        vocabulary, times = np.unique(q, return_counts=True)
        length = end[mine] - begin[mine]
        for at in range(0, len(mine), max(1, CELLS // int(length.max()))):
            some = mine[at : at + max(1, CELLS // int(length.max()))]
            n = end[some] - begin[some]
            own = words[ragged(begin[some], n)]
            place = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
            hit = vocabulary[place] == own
            seen = np.unique(np.repeat(np.arange(len(some)), n)[hit] * len(vocabulary) + place[hit])
            out[some] = np.bincount(seen // len(vocabulary), times[seen % len(vocabulary)], len(some)) >= least
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct test items in parts of about ``limit`` bytes at most."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-2 * int(size) // limit) if size > limit else 1
    return [rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def items_of(block: DataFrame) -> Items:
    """The items of a block with their seeds."""
    return Items.of([(r.item, r.text) for r in block.orderBy("item", "text").collect()])


def leaks_column(text: Column, items: Items, share: float = SHARE) -> Column:
    """``array<struct<item_id, score, first_word, end_word>>`` of the items that a text leaks."""
    from pyspark.sql.pandas.functions import arrow_udf

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    @arrow_udf("array<struct<item_id:bigint,score:double,first_word:bigint,end_word:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        trim()
        got = _leaks(as_bytes(texts), items, _sieve(items.keys), share)
        return pa.array([[dict(zip(("item_id", "score", "first_word", "end_word"), x, strict=True)) for x in row] for row in got], kind)

    return run(text.cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and leaked item: id, item_id, score, first_word, end_word.

    ``score`` is the local alignment's share of the item's full score; words are
    counted after letters are folded and everything else is dropped.  A score
    below ``LEAST_WORDS`` matching words never counts unless the item is shorter
    and matched whole, so an item of one word leaks into every text with that
    word.  From a ``share`` of 0.5 every leak is found; below that an alignment with
    more edits than matches may have no seed.  Of equal scores of one item in a
    text the first place counts.  Null texts leak nothing; null ids are kept; repeated
    rows give their rows again; other columns are ignored; an empty benchmark or
    table gives no rows; a text of any length is searched whole.
    """
    ship(docs.sparkSession)
    out = None
    for block in benchmark_blocks(benchmark):
        items = items_of(block)
        part = docs.select(F.col(id_col).alias(id_col), F.explode(leaks_column(F.col(text_col), items, share)).alias("x")).select(id_col, "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a test item; all columns, of any name, as they are.

    Null and empty texts leak nothing; null ids and repeated rows are judged each by
    their text.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    out = docs
    for k, block in enumerate(benchmark_blocks(benchmark)):
        name = free_name(out, f"__textloom_leaks_{k}")
        out = out.withColumn(name, leaks_column(F.col(text_col), items_of(block), share)).where(F.size(name) == 0)
    return out.select(*columns)
