"""N-gram Jaccard join: size-aware, heavy and light.

Documents are sets of word shingles; equal sets fall together first.  Of the
distinct sets, those up to a boundary enumerate their fixed-size subsets, of
the sizes that a partner of theirs must share, and meet in a subset; larger
sets meet in the inverted lists of their rarest shingles, as many of them as a
partner cannot miss.  The boundary is the size up to which subsets cost less
than lists, given how long the lists of this corpus are.  A shingle that one
document holds alone is no list, so most documents leave after the counting.

Short lists give their pairs at once, cut by size, place and a parity bitmap
whose distance bounds the sets'.  Long lists give a star around their first
member; only members that the star leaves outside the largest component are
then compared with the rest, so a group of copies is never paired out.  Every
pair is verified on the whole sets.

Counting, listing and fetching sets go through packed arrays between blocks of
documents and parts of the shingle space; texts are exchanged once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import Block, as_bytes, mix, sequence_hash
from .runtime import block_of, checkpointed, layout, map_arrow, pack_counts, part_of, ragged, ship, trim, unpack_counts

SHORT_LIST = 32
HOT_CLASS = 12  # a shingle of some 2**12 documents or more goes past the parts as rows
MAX_BOUNDARY = 24
MAPS = 8  # 64-bit words of the parity bitmap

SETS = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8")])
ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("block", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("small", "u1"), ("map", "<u8", (MAPS,))])


def need(n: int, m: int, percent: int) -> int:
    """Least common part of sets of n and m at the threshold: 100 i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which any partner shares one."""
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of the common part that partners of a set of n require, other than the equal set."""
    return sorted({need(n, m, percent) for m in partner_sizes(n, percent) if m != n or need(n, m, percent) < n})


def boundary(percent: int, mates: float) -> int:
    """Largest size up to which enumerating subsets is no dearer than scanning lists with ``mates`` others a list."""
    best = 0
    for n in range(1, MAX_BOUNDARY + 1):
        subsets = sum(math.comb(n, c) for c in subset_sizes(n, percent))
        if subsets > prefix_size(n, percent) * (1 + mates):
            break
        best = n
    return best


class _Sets:
    """Shingle sets of a block's documents in order of id: flat sorted values and bounds."""

    def __init__(self, table: pa.Table, k: int, only: set[int] | None = None):
        ids, texts = table.column("id").to_pylist(), as_bytes(table.column("text"))
        order = sorted((i for i in range(len(ids)) if only is None or ids[i] in only), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        values, sizes = [], []
        at = 0
        while at < len(order):
            end, held = at, 0
            while end < len(order) and (end == at or held < 2 << 20):
                held += len(texts[order[end]])
                end += 1
            b = Block([texts[i] for i in order[at:end]])
            words = b.word_hash(fold=True)
            grams, _, doc = b.windows(words, k)
            short = np.flatnonzero((b.n_words > 0) & (b.n_words < k))
            if len(short):
                grams = np.concatenate([grams, sequence_hash(words, b.first[short], b.first[short + 1])])
                doc = np.concatenate([doc, short])
            by = np.lexsort((grams, doc))
            grams, doc = grams[by], doc[by]
            keep = np.ones(len(grams), bool)
            keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
            values.append(grams[keep])
            sizes.append(np.bincount(doc[keep], minlength=end - at))
            at = end
        self.values = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.n = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, whatever the order of its members; 0 for an empty one."""
        total = np.zeros((2, len(self.values) + 1), np.uint64)
        np.cumsum(mix(self.values), out=total[0, 1:])
        np.cumsum(mix(self.values ^ np.uint64(0xD1B54A32D192ED03)), out=total[1, 1:])
        h = total[:, self.at[1:]] - total[:, self.at[:-1]]
        return mix(h[0] + self.n.astype(np.uint64)), h[1]

    def maps(self, docs: np.ndarray) -> np.ndarray:
        """Parity bitmap of each of these documents."""
        out = np.zeros((len(docs), MAPS), np.uint64)
        for row, d in enumerate(docs.tolist()):
            v = mix(self.values[self.at[d] : self.at[d + 1]])
            slot = (v & np.uint64(64 * MAPS - 1)).astype(np.int64)
            odd = np.bincount(slot, minlength=64 * MAPS) & 1
            out[row] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
        return out

    def lead(self) -> np.ndarray:
        """The first row of each id that has one, and a set."""
        first = np.array([x is not None and (i == 0 or x != self.ids[i - 1]) for i, x in enumerate(self.ids)], bool).reshape(len(self.ids))
        return first & (self.n > 0)


def _cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), slice(int(bounds[p]), int(bounds[p + 1]))


def _pairs(e: np.ndarray, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one short list that size, place and bitmap leave."""
    i, j = np.triu_indices(len(e), 1)
    a, b = e[i], e[j]
    ok = (a["node"] != b["node"]) & (~((a["small"] == 1) & (b["small"] == 1) & (a["n"] <= limit) & (b["n"] <= limit)) | (a["small"] == 2))
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    lo, hi = np.minimum(n, m), np.maximum(n, m)
    least = -(-percent * (n + m) // (100 + percent))
    ok &= (100 * lo >= percent * hi) & (np.minimum(n - a["pos"], m - b["pos"]) >= least)
    ok &= np.bitwise_count(a["map"] ^ b["map"]).sum(axis=1) <= n + m - 2 * least
    return i[ok], j[ok]


def class_links(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``n_shingles`` and ``component_id``.

    Two documents link if the Jaccard similarity of their sets of ``k``-word
    shingles (A-Z folded; fewer words: the whole sequence) is ``percent`` or
    more; the component is the least id that links reach.  Documents without
    words, and null texts, link with nothing.  A null id stays alone with a null
    component.  Rows that repeat an id get its component, and the first text in
    order is the one compared.  Other columns are ignored; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, parts = layout(docs)
    rows = docs.select(
        block_of(F.col(id_col), F.col(text_col), blocks).alias("block"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
    )

    def ask_counts(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        s = _Sets(table, k)
        values, counts = np.unique(s.values, return_counts=True)
        cells = {p: [values[c].astype("<u4").tobytes(), pack_counts(counts[c]), b""] for p, c in _cut(values, parts)}
        h1, h2 = s.prints()
        lead = np.flatnonzero(s.lead())
        rec = np.zeros(len(lead), SETS)
        rec["h1"], rec["h2"], rec["id"] = h1[lead], h2[lead], [s.ids[i] for i in lead.tolist()]
        rec = rec[np.lexsort((rec["id"], rec["h2"], rec["h1"]))]
        first = np.ones(len(rec), bool)
        first[1:] = (rec["h1"][1:] != rec["h1"][:-1]) | (rec["h2"][1:] != rec["h2"][:-1])
        rec = rec[first]
        for p, c in _cut(rec["h1"], parts):
            cells.setdefault(p, [b"", b"", b""])[2] = rec[c].tobytes()
        cols = list(zip(*cells.values(), strict=True)) or [(), (), ()]
        return pa.table([pa.array(list(cells), pa.int32()), pa.array([key[0].as_py()] * len(cells), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "block", "tokens", "counts", "sets"])

    def answer_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        asked = pa.Table.from_batches(got)
        raw, part = asked.column("tokens").to_pylist(), asked.column("part").to_pylist()
        sizes = np.array([len(x) // 4 for x in raw])
        tokens = np.frombuffer(b"".join(raw), "<u4")
        if len(set(part)) > 1:
            tokens = tokens.astype(np.uint64) | (np.repeat(np.array(part), sizes).astype(np.uint64) << np.uint64(32))
        counts = [unpack_counts(x, n) for x, n in zip(asked.column("counts").to_pylist(), sizes.tolist(), strict=True) if n]
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        code, total = np.zeros(0, np.uint8), np.zeros(0)
        if len(tokens):
            by = np.argsort(tokens, kind="stable")
            fresh = np.ones(len(tokens), bool)
            fresh[1:] = tokens[by][1:] != tokens[by][:-1]
            total = np.add.reduceat(counts[by], np.flatnonzero(fresh))
            classes = np.minimum(np.ceil(4 * np.log2(total)), 255).astype(np.uint8)  # 0: one document alone
            code = np.empty(len(tokens), np.uint8)
            code[by] = classes[np.cumsum(fresh) - 1]
        ends = np.cumsum(sizes)
        codes = [code[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
        raw = asked.column("sets").to_pylist()
        sets = np.frombuffer(b"".join(raw), SETS)
        owner = np.repeat(np.arange(len(raw)), [len(x) // SETS.itemsize for x in raw])
        by = np.lexsort((sets["id"], sets["h2"], sets["h1"]))
        fresh = np.ones(len(sets), bool)
        fresh[1:] = (sets["h1"][by][1:] != sets["h1"][by][:-1]) | (sets["h2"][by][1:] != sets["h2"][by][:-1])
        rep = np.zeros(len(sets), np.int64)
        if len(sets):
            rep[by] = sets["id"][by][np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        moved = np.flatnonzero(rep != sets["id"])
        bounds = np.searchsorted(owner[moved], np.arange(len(raw) + 1))
        pairs = np.stack([sets["id"][moved], rep[moved]], 1).astype("<i8") if len(moved) else np.zeros((0, 2), "<i8")
        reps = [pairs[a:z].tobytes() for a, z in zip(bounds, bounds[1:], strict=False)]
        many = total[total > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked.column("block").to_pylist(), pa.int64()), pa.array(part, pa.int32()), pa.array(codes, pa.binary()), pa.array(reps, pa.binary()), pa.array([None] * len(raw), pa.int64()), pa.array([None] * len(raw), pa.int64())],
            names=["block", "part", "codes", "reps", "lists", "entries"],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([len(many)], pa.int64()), pa.array([int(many.sum())], pa.int64())],
            names=["block", "part", "codes", "reps", "lists", "entries"],
        )

    def enter_lists(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        block = key[0].as_py()
        s = _Sets(left, k)
        values, back = np.unique(s.values, return_inverse=True)
        code = np.zeros(len(values), np.uint8)
        codes = dict(zip(right.column("part").to_pylist(), right.column("codes").to_pylist(), strict=True))
        for p, c in _cut(values, parts):
            code[c] = np.frombuffer(codes[p], np.uint8)
        code = code[back]
        moved = np.frombuffer(b"".join(x for x in right.column("reps").to_pylist() if x), "<i8").reshape(-1, 2)
        rep = dict(moved.tolist())
        lists, entries = (right.column(c)[0].as_py() if right.num_rows else 0 for c in ("lists", "entries"))
        limit = boundary(percent, max(0.0, entries / lists - 1) if lists else 0.0)
        # one row of each distinct set speaks for it
        h1, h2 = s.prints()
        lead = np.flatnonzero(s.lead())
        of_set: dict[tuple[int, int], int] = {}
        of_row: dict[int, int] = {}
        chosen = []
        for i, a, b in zip(lead.tolist(), h1[lead].tolist(), h2[lead].tolist(), strict=True):
            if (a, b) not in of_set:
                of_set[a, b] = rep.get(s.ids[i], s.ids[i])
                if of_set[a, b] == s.ids[i]:
                    chosen.append(i)
            of_row[s.ids[i]] = of_set[a, b]
        reps = [of_row.get(x, x) for x in s.ids]

        found: list[np.ndarray] = []
        ids = np.array([x or 0 for x in s.ids], np.int64)

        def entry(doc: np.ndarray, token: np.ndarray, pos: np.ndarray, small: np.ndarray) -> None:
            e = np.zeros(len(doc), ENTRY)
            e["token"], e["node"], e["block"], e["n"], e["pos"], e["small"] = token, ids[doc], block, s.n[doc], pos, small
            found.append(e)

        chosen_at = np.array(chosen, np.int64)
        n = s.n[chosen_at]
        listed = chosen_at[100 * n // percent > limit]
        if len(listed):
            take = ragged(s.at[listed], s.n[listed])
            doc, value, c = s.doc[take], s.values[take], code[take]
            by = np.lexsort((mix(value), c, doc))
            doc, value, c = doc[by], value[by], c[by]
            pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
            first = s.n - -(-percent * s.n // 100) + 1
            use = (pos < first[doc]) & (c > 0)
            entry(doc[use], value[use], pos[use], (s.n[doc[use]] <= limit).astype(np.uint8))
            hot = c[use] >= 4 * HOT_CLASS
        else:
            hot = np.zeros(0, bool)
        docs_, tokens_ = [], []
        for i in chosen_at[n <= limit].tolist():
            lo, hi = s.at[i], s.at[i + 1]
            shared = mix(s.values[lo:hi][code[lo:hi] > 0]).tolist()
            for size in subset_sizes(int(s.n[i]), percent):
                if size <= len(shared):  # a subset with a shingle nobody else has meets nobody
                    for some in combinations(shared, size):
                        docs_.append(i)
                        tokens_.append((sum(some) + size * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        if docs_:
            entry(np.array(docs_), mix(np.array(tokens_, np.uint64)), np.zeros(len(docs_), np.int64), np.full(len(docs_), 2, np.uint8))
            hot = np.concatenate([hot, np.zeros(len(docs_), bool)])
        e = np.concatenate(found) if found else np.zeros(0, ENTRY)
        if len(e):
            nodes, node_of = np.unique(e["node"], return_inverse=True)
            row_of = dict(zip(ids[chosen_at].tolist(), chosen, strict=True))
            e["map"] = s.maps(np.array([row_of[x] for x in nodes.tolist()]))[node_of]
        hot_rows, e = e[hot], e[~hot]
        e = e[np.argsort(part_of(e["token"], parts), kind="stable")]
        pieces = {p: e[c].tobytes() for p, c in _cut(e["token"], parts)}
        table = pa.array(list(pieces), pa.int32()), pa.array(list(pieces.values()), pa.binary())
        m = len(pieces)
        doc_ids = np.array([(x if x is not None else 0, r if r is not None else 0) for x, r in zip(s.ids, reps, strict=True)], "<i8").reshape(-1, 2)
        nulls = np.array([x is None for x in s.ids], np.uint8)
        return pa.table(
            [
                pa.array([*table[0].to_pylist(), block % parts], pa.int32()),
                pa.array([block] * (m + 1), pa.int64()),
                pa.array([*table[1].to_pylist(), None], pa.binary()),
                pa.array([None] * m + [hot_rows.tobytes()], pa.binary()),
                pa.array([None] * m + [doc_ids.tobytes() + s.n.astype("<i8").tobytes() + nulls.tobytes()], pa.binary()),
            ],
            names=["part", "block", "entries", "hot", "docs"],
        )

    def read_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = MAX_BOUNDARY
        names = ["block", "want", "pairs", "long", "docs"]
        out: dict[int, dict[str, list[bytes]]] = {}

        def put(block: int, name: str, data: bytes) -> None:
            out.setdefault(block, {}).setdefault(name, []).append(data)

        raw = []
        for batch in batches:
            for block, entries, hot, docs_ in zip(*(batch.column(c).to_pylist() for c in ("block", "entries", "hot", "docs")), strict=True):
                if entries:
                    raw.append(entries)
                if hot:
                    put(block, "long", hot)
                    put(block, "want", np.unique(np.frombuffer(hot, ENTRY)["node"]).tobytes())
                if docs_ is not None:
                    put(block, "docs", docs_)
        e = np.frombuffer(b"".join(raw), ENTRY)
        raw.clear()
        if len(e):
            e = e[np.lexsort((e["node"], e["pos"], e["token"]))]
            head = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
            size = np.diff(np.append(head, len(e)))
            x_all, y_all = [], []
            long = []
            for a, m in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                if m <= SHORT_LIST:
                    i, j = _pairs(e[a : a + m], percent, limit)
                    x_all.append(a + i)
                    y_all.append(a + j)
                else:
                    long.append(e[a : a + m])
            x = np.concatenate(x_all) if x_all else np.zeros(0, np.int64)
            y = np.concatenate(y_all) if y_all else np.zeros(0, np.int64)
            if len(x):
                swap = e["node"][x] > e["node"][y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                pairs = np.unique(np.stack([e["node"][x], e["node"][y], e["block"][x].astype(np.int64), e["block"][y].astype(np.int64)], 1), axis=0)
                for block in np.unique(pairs[:, 2:]).tolist():
                    mine = pairs[:, 2] == block
                    if mine.any():
                        put(block, "pairs", pairs[mine][:, :2].astype("<i8").tobytes())
                    want = np.unique(np.concatenate([pairs[mine][:, 0], pairs[pairs[:, 3] == block][:, 1]]))
                    put(block, "want", want.astype("<i8").tobytes())
            if long:
                rows_ = np.concatenate(long)
                for block in np.unique(rows_["block"]).tolist():
                    mine = rows_[rows_["block"] == block]
                    put(block, "long", mine.tobytes())
                    put(block, "want", np.unique(mine["node"]).tobytes())
        cols = [[b"".join(v[n]) if n in v else None for v in out.values()] for n in names[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=names)

    def fetch(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        join = lambda c, t: np.frombuffer(b"".join(x for x in right.column(c).to_pylist() if x), t)
        want = np.unique(join("want", "<i8"))
        pairs = join("pairs", "<i8").reshape(-1, 2)
        long = join("long", ENTRY)
        out: dict[str, list] = {c: [] for c in ("kind", "a", "b", "n", "pos", "small", "data")}

        def add(kind: str, size: int, **cols: list) -> None:
            for c in out:
                out[c] += [kind] * size if c == "kind" else cols.get(c, [None] * size)

        for x in right.column("docs").to_pylist():
            if x is not None:
                m = len(x) // 25
                ids = np.frombuffer(x, "<i8", 2 * m).reshape(-1, 2)
                sizes, nulls = np.frombuffer(x, "<i8", m, 16 * m).tolist(), np.frombuffer(x, np.uint8, m, 24 * m).tolist()
                add("doc", m, a=[None if z else v for v, z in zip(ids[:, 0].tolist(), nulls, strict=True)], b=[None if z else v for v, z in zip(ids[:, 1].tolist(), nulls, strict=True)], n=sizes)
        add("pair", len(pairs), a=pairs[:, 0].tolist(), b=pairs[:, 1].tolist())
        add("long", len(long), a=long["node"].tolist(), b=long["token"].view("<i8").tolist() if len(long) else [], n=long["n"].tolist(), pos=long["pos"].tolist(), small=long["small"].tolist(), data=[x.tobytes() for x in long["map"]])
        if len(want):
            s = _Sets(left, k, set(want.tolist()))
            lead = np.flatnonzero(s.lead()).tolist()
            add("set", len(lead), a=[s.ids[i] for i in lead], n=s.n[lead].tolist(), data=[s.values[s.at[i] : s.at[i + 1]].tobytes() for i in lead])
        kinds = {"kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "pos": pa.int64(), "small": pa.int32(), "data": pa.binary()}
        return pa.table([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))

    def joined(left: DataFrame, right: DataFrame, fn: Callable, ddl: str) -> DataFrame:
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(fn, ddl)

    asked = rows.groupBy("block").applyInArrow(ask_counts, "part int, block long, tokens binary, counts binary, sets binary").repartitionById(parts, F.col("part"))
    replies = map_arrow(asked, answer_counts, "block long, part int, codes binary, reps binary, lists long, entries long")
    stats = replies.where("block IS NULL").agg(F.coalesce(F.sum("lists"), F.lit(0)).alias("lists"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"))
    replies = replies.where("block IS NOT NULL").drop("lists", "entries").join(F.broadcast(stats))
    entries = joined(rows, replies, enter_lists, "part int, block long, entries binary, hot binary, docs binary").repartitionById(parts, F.col("part"))
    lists = map_arrow(entries, read_lists, "block long, want binary, pairs binary, long binary, docs binary")
    found = checkpointed(joined(rows, lists, fetch, "kind string, a long, b long, n long, pos long, small int, data binary"))
    return _link(found, percent, id_col)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose whole sets reach the threshold."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, big = (p, q) if len(p) <= len(q) else (q, p)
            at = np.minimum(np.searchsorted(big, small), len(big) - 1)
            common = int((big[at] == small).sum())
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pa.array(out, pa.bool_())

    both = pairs.join(sets.select(F.col("a"), F.col("data").alias("left")), "a").join(sets.select(F.col("a").alias("b"), F.col("data").alias("right")), "b")
    return both.where(linked("left", "right")).select("a", "b")


def _can_link(percent: int, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Bounds that a linked pair of one list keeps: size, place and bitmap."""
    n, m = x("n"), y("n")
    least = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
    apart = sum((F.bit_count(x(f"m{i}").bitwiseXOR(y(f"m{i}"))) for i in range(1, MAPS)), F.bit_count(x("m0").bitwiseXOR(y("m0"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - x("pos"), m - y("pos")) >= least) & (apart <= n + m - 2 * least)


SALTS = 16  # tasks that one very long list is dealt to


def _to_lists(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Members of long lists with their list's one row; a list is dealt by its members to ``SALTS`` tasks."""
    own = members.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    each = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(each, ["token", "__salt"]).drop("__salt")


def _link(found: DataFrame, percent: int, id_col: str) -> DataFrame:
    sets = found.where("kind = 'set'").select("a", "data")
    # a bitmap as longs: eight bytes each, the same order on either side
    words = [F.conv(F.hex(F.substring("data", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"m{i}") for i in range(MAPS)]
    long = found.where("kind = 'long'").select(F.col("b").alias("token"), F.col("a").alias("node"), "n", "pos", *words)
    centre = long.groupBy("token").agg(F.min(F.struct("pos", "node", "n", *(f"m{i}" for i in range(MAPS)))).alias("c"))
    star = _to_lists(long, centre).where(F.col("node") != F.col("c.node"))
    star = star.where(_can_link(percent, F.col, lambda c: F.col(f"c.{c}")))
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = found.where("kind = 'pair'").select("a", "b").unionByName(star.select(*ends(F.col("node"), F.col("c.node")))).distinct()
    links = checkpointed(_verified(first, sets, percent))
    comp = checkpointed(components(links))
    # members of a long list that its largest component leaves out, against the whole list
    named = long.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("token").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("top.component").alias("main"))
    named = checkpointed(_to_lists(named, main))
    x, y = named.where("component != main").alias("x"), named.alias("y")
    rest = x.join(y, F.col("x.token") == F.col("y.token")).where(F.col("x.component") != F.col("y.component"))
    rest = rest.where(_can_link(percent, lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
    rest = rest.select(*ends(F.col("x.node"), F.col("y.node"))).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(rest, sets, percent)
    name = comp.select(F.col("node"), F.col("component"))
    for end in ("a", "b"):
        more = more.join(name.withColumnRenamed("node", end).withColumnRenamed("component", f"c{end}"), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
    second = components(more.distinct()).withColumnRenamed("component", "last")
    comp = comp.join(second.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    alone = second.join(comp, second["node"] == comp["node"], "left_anti").select("node", F.col("last").alias("component"))
    comp = comp.unionByName(alone)
    rows = found.where("kind = 'doc'").select(F.col("a").alias(id_col), F.col("n").alias("n_shingles"), F.col("b").alias("node"))
    return rows.join(comp, "node", "left").select(id_col, "n_shingles", F.coalesce("component", "node").alias("component_id"))
