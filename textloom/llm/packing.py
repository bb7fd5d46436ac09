"""Best-fit packing of tokenised documents into fixed-size sequences.

Lengths are small integers, so the whole instance is its histogram (at most
``capacity`` rows, whatever the corpus holds).  The driver reduces that
histogram by the dominance rules of Martello and Toth, packs what is left by
best fit decreasing with whole groups of equal bins at a time, and every piece
then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import _SPACE, Block, blocks
from .runtime import arrow, checkpointed, map_arrow, n_files, n_parts, ragged

END_ID = 0
# White space beyond ASCII and control strings, and the bytes they begin with.
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|<\|")
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F, ord("<")]] = True
CACHE_CHUNKS = 1_500_000  # chunks a worker remembers, some 50 MB; a block that would pass that starts anew
JOINED = 1000  # unknown chunks the tokenizer gets as one text
_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """The worker's own encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class ChunkEncoder:
    """Token ids of whole texts, each distinct chunk encoded once per worker.

    The byte-level vocabulary splits a text before encoding, and never inside
    "optional single space + run of non-space": such chunks and the white
    space between them encode alike in every text.  Texts with white space
    beyond ASCII or with a control string go to the tokenizer as they are.

    What is known lies in sorted levels, each at least twice as long as the
    next; a level that grows too long for that is merged into the one before.
    """

    def __init__(self, path: str, remember: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.remember = remember
        vocabulary = self.tok.get_vocab()
        # one character of a token's name is one byte of text
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.width[i] = len(name)
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.known = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each sorted key; place -1: unknown."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for level, places, sizes in self.levels:
            i = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[i] == keys
            at[hit], size[hit] = places[i[hit]], sizes[i[hit]]
        return at, size

    def _learn(self, keys: np.ndarray, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        ids, sizes = self._encode(buf, begin, end)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        new = keys, (self.used + np.cumsum(sizes) - sizes).astype(np.uint32), sizes.astype(np.uint32)
        self.used += len(ids)
        self.known += len(keys)
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            both = [np.concatenate(x) for x in zip(self.levels.pop(), new, strict=True)]
            by = np.argsort(both[0], kind="stable")
            new = both[0][by], both[1][by], both[2][by]
        self.levels.append(new)

    def _encode(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has.

        Chunks that hold a word are joined: a space that leads one divides it from
        the last, and where none does a newline is put before it, which is a token
        of its own.  The widths of the tokens tell where each chunk ends.
        """
        white = _SPACE[buf[end - 1]]
        worded = np.flatnonzero(~white)
        bare = buf[begin[worded]] != 0x20
        length = end[worded] - begin[worded]
        full = length + bare
        stop = np.cumsum(full)
        joined = np.full(int(full.sum()), 10, np.uint8)
        joined[ragged(stop - length, length)] = buf[ragged(begin[worded], length)]
        cuts = [0, *stop[JOINED - 1 :: JOINED].tolist()]
        if len(stop) % JOINED:
            cuts.append(int(stop[-1]))
        data = joined.tobytes()
        got = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast([data[a:z].decode("utf-8", "replace") for a, z in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, np.uint32)
        reach = np.cumsum(self.width[ids])
        last = np.searchsorted(reach, stop) + 1
        first = np.searchsorted(reach, stop - length) + 1
        first[stop - length == 0] = 0
        assert len(reach) == 0 or ((reach[last - 1] == stop).all() and (reach[first - 1][first > 0] == (stop - length)[first > 0]).all()), "chunks end where tokens do"
        blank = np.flatnonzero(white)
        spaces = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast([buf[a:z].tobytes().decode() for a, z in zip(begin[blank].tolist(), end[blank].tolist(), strict=True)], add_special_tokens=False)] if len(blank) else []
        sizes, source = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        sizes[worded], source[worded] = last - first, first
        sizes[blank] = [len(x) for x in spaces]
        source[blank] = len(ids) + np.cumsum(sizes[blank]) - sizes[blank]
        return np.concatenate([ids, *spaces])[ragged(source, sizes)], sizes

    def block(self, b: Block) -> list[np.ndarray]:
        """Ids of each text of the block."""
        n = len(b.texts)
        hinted = np.unique(np.searchsorted(b.at, np.flatnonzero(_LEAD[b.buf]), "right") - 1)
        odd = [i for i in hinted.tolist() if _ODD.search(b.texts[i])]
        begin, end, doc = self._chunks(b)
        if odd:
            plain = ~np.isin(doc, odd)
            begin, end, doc = begin[plain], end[plain], doc[plain]
        out: list[np.ndarray] = []
        if len(begin):
            keys, first, back = np.unique(b.span_hash(begin, end), return_index=True, return_inverse=True)
            at, lengths = self._find(keys)
            fresh = at < 0
            if self.known + int(fresh.sum()) > self.remember:
                self._forget()
                fresh[:] = True
            if fresh.any():
                self._learn(keys[fresh], b.buf, begin[first[fresh]], end[first[fresh]])
                at, lengths = self._find(keys)
            lengths = lengths[back]
            ids = self.flat[ragged(at[back], lengths)]
            ends = np.cumsum(np.bincount(doc, lengths, n).astype(np.int64))
        else:
            ids, ends = np.zeros(0, np.uint32), np.zeros(n, np.int64)
        last, whole = 0, set(odd)
        for i in range(n):
            if i in whole:
                out.append(np.array(self.tok.encode(b.texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[last : ends[i]])
            last = ends[i]
        return out

    @staticmethod
    def _chunks(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans that encode by themselves, in order, and the text of each."""
        doc = b.doc_of_word()
        before = np.empty_like(b.start)
        before[1:] = b.end[:-1]
        heads = b.first[:-1][b.n_words > 0]
        before[heads] = b.at[:-1][b.n_words > 0]
        gap = b.start - before
        joined = (gap > 0) & (b.buf[b.start - 1] == 0x20)
        word = b.start - joined
        # all but the last white space of a gap; the last one, if no space; white space that ends a text
        lead = np.flatnonzero(gap > 1)
        single = np.flatnonzero((gap > 0) & ~joined)
        tail_from = b.at[:-1].copy()
        full = b.n_words > 0
        tail_from[full] = b.end[b.first[1:][full] - 1]
        tail = np.flatnonzero(tail_from < b.at[1:] - 1)
        begin = np.concatenate([before[lead], b.start[single] - 1, tail_from[tail]])
        end = np.concatenate([b.start[lead] - 1, b.start[single], b.at[1:][tail] - 1])
        owner = np.concatenate([doc[lead], doc[single], tail])
        order = np.argsort(begin, kind="stable")
        where = np.searchsorted(word, begin[order])
        return np.insert(word, where, begin[order]), np.insert(b.end, where, end[order]), np.insert(doc, where, owner[order])


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.

    Each text becomes its ids and one end id.  Only a longer document is cut,
    into pieces of ``capacity`` of which the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        close = END_ID.to_bytes(4, "little")
        schema = arrow(f"{id_col} long, piece int, start long, length long, ids_crc32 long")
        for batch in batches:
            names: list[int | None] = []
            rows: list[tuple[int, int, int, int]] = []
            all_ids = batch.column(id_col).cast(pa.int64()).to_pylist()
            for part, block in blocks(batch, text_col):
                for name, ids in zip(all_ids[part], encoder.block(block), strict=True):
                    total = len(ids) + 1
                    cut = total % capacity if total > capacity else total
                    edges = [0, *range(cut or capacity, total + 1, capacity)] if total > capacity else [0, total]
                    for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                        crc = zlib.crc32(np.ascontiguousarray(ids[a:z], "<u4"))
                        names.append(name)
                        rows.append((k, a, z - a, zlib.crc32(close, crc) if z == total else crc))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([names, *cols], schema.types, strict=True)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return map_arrow(texts, run, f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def dominate(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that some best packing contains, with how often, and the counts left.

    From the longest length j down, with r room left beside it:
    nothing fits: j alone; an item of exactly r: {j, r} dominates every set with
    j; no two other items fit together: {j, k}, k the longest that fits, does.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left)
    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room = capacity - j
            mine = left[j]
            while sizes and not left.get(sizes[0], 0):
                sizes.pop(0)
            two: list[int] = []  # the two shortest items besides one j
            for s in sizes:
                two += [s] * min(2 - len(two), left.get(s, 0) - (s == j))
                if len(two) == 2:
                    break
            if not two or two[0] > room:
                fixed.append(((j,), mine if (not two or j > room) else 1))
                left[j] -= fixed[-1][1]
                continue
            if room == j and mine >= 2:
                fixed.append(((j, j), mine // 2))
                left[j] -= 2 * (mine // 2)
                continue
            if left.get(room, 0) and room != j:
                m = min(mine, left[room])
                fixed.append(((j, room), m))
                left[j] -= m
                left[room] -= m
                continue
            if len(two) == 2 and sum(two) <= room:
                break
            k = next(s for s in reversed(sizes[: bisect_left(sizes, room + 1)]) if left.get(s, 0) - (s == j) > 0)
            m = 1 if k == j else min(mine, left[k])
            if k < j and left[k] > 1 and 2 * two[0] <= room and m > 1:
                m = 1
            fixed.append(((j, k), m))
            left[j] -= m
            left[k] -= m
    return fixed, {k: v for k, v in left.items() if v > 0}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing; equal bins move together, so the work follows the number of lengths."""
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, bins: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((bins, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * size, (size,) * each, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            bins, m = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = min(room // size, n)
            take = min(m, n // each)
            if take < m:
                put(room, bins, m - take)
            put(room - each * size, bins + (size,) * each, take)
            n -= take * each
    return [x for group in open_bins.values() for x in group]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` must be materialised.  The driver holds the histogram of lengths
    and the kinds of bins, neither of which grows with the rows.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    fixed, left = dominate(counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    used = dict.fromkeys(counts, 0)
    for bins, n in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in bins:
            slots.setdefault(size, []).append((used[size], base, offset))
            used[size] += n
            offset += size
        base += n
    assert used == counts, "every piece has one slot"
    table = {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in slots.items()}
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, at = np.unique(length[order], return_index=True)
            for size, rows in zip(kinds.tolist(), np.split(order, at[1:]), strict=True):
                first, bins, offset = table[size]
                slot = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows] = bins[slot] + rank[rows] - first[slot]
                off[rows] = offset[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    # a piece's rank among those of its length: hot lengths are dealt by a salt first
    parts = n_parts(pieces.sparkSession)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in names if c != "length"]), F.lit(parts)))
    per_salt = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    per_salt = per_salt.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("length", "__salt").orderBy(*[c for c in names if c != "length"])
    ranked = salted.withColumn("__in", F.row_number().over(inside) - 1).join(per_salt, ["length", "__salt"])
    ranked = ranked.select(*names, (F.col("__before") + F.col("__in")).cast("long").alias("__rank"))
    kept = {f.name: f for f in pieces.schema.fields}
    ddl = ", ".join(f"`{c}` {kept[c].dataType.simpleString()}" for c in names)
    return map_arrow(ranked, place, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents.

    Null text: empty (one end id).  A null id is kept as null; repeated rows are
    packed each; other columns are ignored; an empty table gives no rows.
    """
    return pack(checkpointed(tokenised_pieces(docs, tokenizer, capacity, id_col, text_col), n_files(docs)), capacity)
