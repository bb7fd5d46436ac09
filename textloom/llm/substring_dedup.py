"""Substring dedup over a de Bruijn graph of token k-mers.

An edge is a window of ``length`` words, from the node of its first
``length - 1`` words along the label of its last.  Only edges that may repeat
enter the graph: a window that occurs twice holds the same least (length/2)-word
fingerprint both times, so windows whose least fingerprint is single in the
corpus are out.  Edges meet at their node, with their source coordinates
(document, first word); the least coordinate is the one that stays.  Back in
the documents, edges that follow one another without a branch and whose sources
do as well compact into one path, a long repeated span with the coordinates
that verify it.

Three exchanges carry packed arrays with one entry per distinct fingerprint or
edge and block of documents, so a passage that a third of the corpus shares
costs its node no more entries than there are blocks; texts are exchanged once
and read again from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Block, as_bytes, window_hash
from .runtime import aside, block_of, layout, map_arrow, part_of, ship, trim

LENGTH = 20
_NO_ID = 1 << 62  # from here on coordinates stand for rows without an id

EDGE = np.dtype([("node", "<u8"), ("label", "<u4"), ("id", "<i8"), ("start", "<u4"), ("doc", "<u4")])
REPLY = np.dtype([("doc", "<u4"), ("start", "<u4"), ("source", "<i8"), ("at", "<u4"), ("branch", "u1")])
SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("n", "<u4"), ("source", "<i8"), ("at", "<u4")])


def _coordinates(ids: list[int | None], texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of a block's rows, and in that order what stands for each id: a row without one follows all others, by a fingerprint of its text."""
    at = [_NO_ID + (int.from_bytes(blake2b(t, digest_size=8).digest(), "little") >> 2) if i is None else i for i, t in zip(ids, texts, strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (at[i], texts[i]))
    return order, [at[i] for i in order]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class _Windows:
    """Windows of a block's documents, in order of id, and the fingerprints they hang on."""

    def __init__(self, table: pa.Table, length: int):
        ids, texts = table.column("id").to_pylist(), as_bytes(table.column("text"))
        self.order, at = _coordinates(ids, texts)
        self.ids = np.array(at, np.int64)
        self.block = Block([texts[i] for i in self.order])
        self.words = self.block.word_hash()
        _, self.begin, self.doc = self.block.windows(self.words, length)
        self.start = self.begin - self.block.first[self.doc]
        half = length // 2
        width = length - half + 1
        if len(self.begin):
            prints = window_hash(self.words, half)
            value = least(prints, width)[self.begin]
            fresh = np.ones(len(value), bool)
            fresh[1:] = (value[1:] != value[:-1]) | (self.doc[1:] != self.doc[:-1])
            runs = np.flatnonzero(fresh)
            self.keys, back, counts = np.unique(value[runs], return_inverse=True, return_counts=True)
            self.key_of = np.repeat(back, np.diff(np.append(runs, len(value))))
            self.repeated = counts > 1
            # a text with a short period holds a fingerprint twice within one run
            near = np.zeros(len(prints), bool)
            for p in range(1, min(width + 1, len(prints))):
                near[:-p] |= prints[:-p] == prints[p:]
            if near.any():
                self.repeated |= np.isin(self.keys, prints[near])
        else:
            self.keys, self.key_of, self.repeated = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)


def compact(doc: np.ndarray, start: np.ndarray, source: np.ndarray, at: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """Join edges that follow one another, here and at the source, without a branch between."""
    by = np.lexsort((start, doc))
    doc, start, source, at, branch = doc[by], start[by], source[by], at[by], branch[by]
    head = np.ones(len(doc), bool)
    if len(doc):
        head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1) | (branch[1:] != 0)
    heads = np.flatnonzero(head)
    out = np.zeros(len(heads), SPAN)
    out["doc"], out["start"], out["source"], out["at"] = doc[heads], start[heads], source[heads], at[heads]
    out["n"] = np.diff(np.append(heads, len(doc)))
    return out


def _dealt(block: int, parts: int, pieces: dict[int, bytes], name: str) -> pa.Table:
    return pa.table([pa.array(list(pieces), pa.int32()), pa.array([block] * len(pieces), pa.int64()), pa.array(list(pieces.values()), pa.binary())], names=["part", "block", name])


def _cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), slice(bounds[p], bounds[p + 1])


def _paths(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents in blocks, and per block the packed paths that repeat something earlier."""
    spark = docs.sparkSession
    ship(spark)
    blocks, parts = layout(docs)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        block_of(F.col(id_col), F.col(text_col), blocks).alias("block"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).cast("struct<none:int>").alias("rest"),
    )

    def ask_keys(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        w = _Windows(table, length)
        return _dealt(key[0].as_py(), parts, {p: w.keys[s].tobytes() for p, s in _cut(w.keys, parts)}, "keys")

    def answer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        asked = pa.Table.from_batches(got)
        raw = asked.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(raw), "<u8")
        by = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[by][1:] == keys[by][:-1]
        twice = np.empty(len(keys), bool)
        twice[by] = same[1:] | same[:-1]
        ends = np.cumsum([len(x) // 8 for x in raw])
        bits = [np.packbits(twice[e - len(x) // 8 : e]).tobytes() for x, e in zip(raw, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*(asked.column(c).combine_chunks() for c in ("block", "part")), pa.array(bits, pa.binary())], names=["block", "part", "bits"])

    def ask_edges(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        block = key[0].as_py()
        w = _Windows(left, length)
        repeated = w.repeated.copy()
        bits = dict(zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True))
        for p, s in _cut(w.keys, parts):
            repeated[s] |= np.unpackbits(np.frombuffer(bits[p], np.uint8), count=s.stop - s.start).astype(bool)
        pieces: dict[int, bytes] = {}
        own = b""
        maybe = np.flatnonzero(repeated[w.key_of]) if len(w.key_of) else np.zeros(0, np.int64)
        if len(maybe):
            edges = window_hash(w.words, length)[w.begin[maybe]]
            nodes = window_hash(w.words, length - 1)[w.begin[maybe]]
            by = np.argsort(edges, kind="stable")
            fresh = np.ones(len(by), bool)
            fresh[1:] = edges[by][1:] != edges[by][:-1]
            leader = by[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]  # the earliest of each edge, for every place in ``by``
            later, first = maybe[by[~fresh]], maybe[leader[~fresh]]
            own = compact(w.doc[later], w.start[later], w.ids[w.doc[first]], w.start[first], np.zeros(len(later), np.uint8)).tobytes()
            lead = by[fresh]
            lead = lead[np.argsort(nodes[lead], kind="stable")]
            ask = np.zeros(len(lead), EDGE)
            at = maybe[lead]
            ask["node"], ask["label"] = nodes[lead], (w.words[w.begin[at] + length - 1] >> np.uint64(32)).astype(np.uint32)
            ask["id"], ask["start"], ask["doc"] = w.ids[w.doc[at]], w.start[at], w.doc[at]
            pieces = {p: ask[s].tobytes() for p, s in _cut(nodes[lead], parts)}
        table = _dealt(block, parts, pieces, "edges").append_column("paths", pa.array([None] * len(pieces), pa.binary()))
        mine = pa.table([pa.array([block % parts], pa.int32()), pa.array([block], pa.int64()), pa.array([None], pa.binary()), pa.array([own], pa.binary())], names=table.column_names)
        return pa.concat_tables([table, mine])

    def answer_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        asked = pa.Table.from_batches(got)
        blocks, raw = asked.column("block").to_pylist(), [x or b"" for x in asked.column("edges").to_pylist()]
        edges = np.frombuffer(b"".join(raw), EDGE)
        owner = np.repeat(np.arange(len(raw)), [len(x) // EDGE.itemsize for x in raw])
        by = np.lexsort((edges["start"], edges["id"], edges["label"], edges["node"]))
        edges, owner = edges[by], owner[by]
        fresh, node = np.ones(len(edges), bool), np.ones(len(edges), bool)
        node[1:] = edges["node"][1:] != edges["node"][:-1]
        fresh[1:] = node[1:] | (edges["label"][1:] != edges["label"][:-1])
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(edges) else np.zeros(0, np.int64)
        out_degree = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(node)) if len(edges) else np.zeros(0, np.int64)
        branch = (out_degree > 1)[np.cumsum(node) - 1] if len(edges) else np.zeros(0, bool)
        late = np.flatnonzero(~fresh)
        late = late[np.argsort(owner[late], kind="stable")]
        reply = np.zeros(len(late), REPLY)
        reply["doc"], reply["start"], reply["branch"] = edges["doc"][late], edges["start"][late], branch[late]
        reply["source"], reply["at"] = edges["id"][lead[late]], edges["start"][lead[late]]
        bounds = np.searchsorted(owner[late], np.arange(len(raw) + 1))
        replies = [reply[a:z].tobytes() if z > a else None for a, z in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(replies, pa.binary()), asked.column("paths").combine_chunks()], names=["block", "edges", "paths"])

    def joined(left: DataFrame, right: DataFrame, fn: Callable, ddl: str) -> DataFrame:
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(fn, ddl)

    keys = rows.groupBy("block").applyInArrow(ask_keys, "part int, block long, keys binary").repartitionById(parts, F.col("part"))
    bits = map_arrow(keys, answer_keys, "block long, part int, bits binary")
    edges = joined(rows, bits, ask_edges, "part int, block long, edges binary, paths binary").repartitionById(parts, F.col("part"))
    replies = map_arrow(edges, answer_edges, "block long, edges binary, paths binary")
    return rows, replies.where("edges IS NOT NULL OR paths IS NOT NULL")


def _spans(right: pa.Table) -> np.ndarray:
    """Paths of a block: those found within it and those that sources elsewhere verify."""
    reply = np.frombuffer(b"".join(x for x in right.column("edges").to_pylist() if x), REPLY)
    local = np.frombuffer(b"".join(x for x in right.column("paths").to_pylist() if x), SPAN)
    return np.concatenate([local, compact(reply["doc"], reply["start"], reply["source"], reply["at"], reply["branch"])])


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paths that repeat something earlier: id, first_word, n_words, source_id, source_word."""
    rows, replies = _paths(docs, length, id_col, text_col)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_pylist()
        ids = [ids[i] for i in _coordinates(ids, as_bytes(left.column("text")))[0]]
        s = _spans(right)
        s = s[np.lexsort((s["start"], s["doc"]))]
        source = [None if x >= _NO_ID else x for x in s["source"].tolist()]
        return pa.table(
            [pa.array([ids[d] for d in s["doc"].tolist()], pa.int64()), pa.array(s["start"].astype(np.int64)), pa.array(s["n"].astype(np.int64) + length - 1), pa.array(source, pa.int64()), pa.array(s["at"].astype(np.int64))],
            names=[id_col, "first_word", "n_words", "source_id", "source_word"],
        )

    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, f"{id_col} long, first_word long, n_words long, source_id long, source_word long")


NAMES = ("__n_words", "__n_removed", "__kept")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", names: Sequence[str] = NAMES) -> DataFrame:
    """``docs`` and, for each row, how many words it has, how many go, and the words left, one space between, under ``names``.

    A word goes if a window of ``length`` words over it also starts earlier: at a
    smaller id, or earlier in the same document.  Rows without an id follow all
    others, in order of a fingerprint of their text (ids of 2**62 and more are not told
    from them); rows that repeat an id follow each other in order of their text.
    A null or empty text has no words; a text of any length is taken whole.  Other
    columns are carried along, those called like one of ``names`` as ``<name>_input``;
    an empty table gives no rows.
    """
    docs = aside(docs, *names)
    rows, replies = _paths(docs, length, id_col, text_col)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        ids, texts = left.column("id").to_pylist(), as_bytes(left.column("text"))
        order, _ = _coordinates(ids, texts)
        spans = _spans(right)
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        bounds = np.searchsorted(spans["doc"], np.arange(len(order) + 1))
        kept, total, removed = [""] * len(ids), [0] * len(ids), [0] * len(ids)
        for d, i in enumerate(order):
            words = texts[i].split()
            total[i] = len(words)
            mine = spans[bounds[d] : bounds[d + 1]]
            if len(mine):
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, mine["start"], 1)
                np.add.at(cover, mine["start"].astype(np.int64) + mine["n"] + length - 1, -1)
                stay = np.cumsum(cover)[:-1] == 0
                removed[i] = len(words) - int(stay.sum())
                words = compress(words, stay.tolist())
            kept[i] = b" ".join(words).decode("utf-8", "replace")
        return pa.table(
            [left.column("id"), left.column("text"), left.column("rest"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["id", "text", "rest", "__n_words", "__n_removed", "__kept"],
        )

    ddl = f"id long, text string, rest {rows.schema['rest'].dataType.simpleString()}, __n_words long, __n_removed long, __kept string"
    done = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, ddl)
    back = [F.col("id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*back, *(F.col(old).alias(new) for old, new in zip(NAMES, names, strict=True)))
