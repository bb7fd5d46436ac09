"""Language-model scoring by a weighted backoff automaton.

States are the root, the beginning of a text, and the histories of up to
``order - 1`` tokens that the training texts hold at least ``cutoff`` times.
From state u an arc for a token w seen after it has the smoothed probability
``(c(uw) + k * P(w | suffix of u)) / (c(u) + k)`` and leads to the longest suffix
of uw that is a state; a token without an arc takes the failure arc to the
suffix of u, with weight ``k / (c(u) + k)``.  The root has an arc for every token,
add-one smoothed with one class for unknown words.  At every state the arcs and
the failure arc together sum to one.  A text is scored in one traversal from left
to right that carries the state and adds up the logarithms.

The automaton of a large corpus fits no machine, so it is never gathered:
documents fall into blocks, each block asks once for every distinct n-gram it
holds, parts of the n-gram space add up the training counts and answer each
block.  Longer n-grams are asked for only where their history turned out to be a
state.  From the answers a block builds the states and arcs its own texts can
meet and traverses them.  What moves is packed arrays with one entry per distinct
n-gram and block, so a common n-gram costs a part no more entries than there are
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Block, as_bytes, window_hash
from .runtime import block_of, layout, map_arrow, pack_counts, part_of, ship, trim, unpack_counts

_END = np.uint64(0x51ED270B7C3A9D11)
_BEGIN = np.uint64(0xA0761D6478BD642F)
ORDER = 3
CUTOFF = 2
#: Pseudo-counts of the suffix at states of one token, two, and more (the last holds for all longer ones).
STRENGTHS = (256.0, 32.0)  # of those tried, held-out text of the test tables is likeliest at these
SEGMENT = 512  # tokens of a text that one lane of the traversal takes
ROOT, BEGIN = 0, 1


class _Line:
    """Tokens of a block of documents, a begin mark before each text and an end after it."""

    def __init__(self, texts: list[bytes]):
        b = Block(texts)
        size = b.n_words + 2
        at = np.cumsum(size) - size
        self.line = np.full(int(size.sum()), _BEGIN, np.uint64)
        own = np.ones(len(self.line), bool)
        own[at] = False
        body = own.copy()
        body[at + size - 1] = False
        self.line[body] = b.word_hash(fold=True)
        self.line[at + size - 1] = _END
        self.place = np.flatnonzero(own)
        self.n_tokens = b.n_words + 1
        self.doc = np.repeat(np.arange(len(texts)), self.n_tokens)
        self.ends = np.cumsum(self.n_tokens)
        self.begins = self.ends - self.n_tokens
        self.number = np.arange(len(self.doc)) - self.begins[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def grams(self, k: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints of the ``k``-grams that end at tokens (of ``use``), and each token's number among them or -1."""
        some = np.flatnonzero(self.number >= k - 2) if use is None else np.flatnonzero(use & (self.number >= k - 2))
        back = np.full(len(self.doc), -1, np.int64)
        if not len(some):
            return np.zeros(0, np.uint64), back
        grams = self.line if k == 1 else window_hash(self.line, k)
        keys, back[some] = np.unique(grams[self.place[some] - k + 1], return_inverse=True)
        return keys, back


def _five(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _ordered(table: pa.Table) -> tuple[list[int | None], list[bytes], np.ndarray]:
    """Rows of a block in one order for every reading of it."""
    ids, texts = table.column("id").to_pylist(), as_bytes(table.column("text"))
    held = np.array(table.column("held").to_pylist(), bool)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], held[order] if order else held


def _cells(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), slice(int(bounds[p]), int(bounds[p + 1]))


class _Answers:
    """Training counts of a block's n-grams, as far as they were asked for."""

    def __init__(self, line: _Line, orders: Sequence[int], replies: pa.Table, parts: int, cutoff: int):
        of = {k: {} for k in orders}
        for k, part, counts in zip(*(replies.column(c).to_pylist() for c in ("k", "part", "counts")), strict=True):
            if k in of:
                of[k][part] = counts
        self.line, self.cutoff = line, cutoff
        self.keys, self.back, self.count = {}, {}, {}
        for k in orders:
            keys, back = line.grams(k, self.wanted(k))
            count = np.zeros(len(keys) + 1, np.int64)  # the last one: not asked for
            for p, cell in _cells(keys, parts):
                count[cell] = unpack_counts(of[k][p], cell.stop - cell.start)
            self.keys[k], self.back[k], self.count[k] = keys, back, count
            if k == 1:
                self.n_train = int(count[back[line.ends[0] - 1]]) if len(line.ends) else 0

    def at_token(self, k: int) -> np.ndarray:
        return self.count[k][self.back[k]]

    def wanted(self, k: int) -> np.ndarray | None:
        """Tokens whose ``k``-gram can be an arc: its history is a state and its suffix was seen."""
        if k < 3:
            return None
        seen = self.at_token(k - 1)
        before = np.zeros(len(seen), np.int64)
        before[1:] = seen[:-1]
        before[self.line.begins] = 0
        return (before >= self.cutoff) & (seen > 0)


class Automaton:
    """The states and arcs that a block's texts can meet."""

    def __init__(self, a: _Answers, order: int, strengths: Sequence[float], tokens: int, kinds: int):
        self.a, self.order = a, order
        line = a.line
        strength = lambda k: strengths[min(k, len(strengths)) - 1]
        # the root and the beginning first, then the histories by length
        depth, fail, count = [np.array([0, 1])], [np.array([ROOT, ROOT])], [np.array([0, a.n_train])]
        total = 2
        self.state, self.arc, self.log, self.dest = {}, {}, {}, {}
        chance: dict[int, np.ndarray] = {}
        self.root = np.log10((a.count[1] + 1) / (tokens + kinds + 1))
        for k in range(1, order + 1):
            n = len(a.keys[k])
            at = np.zeros(n, np.int64)  # a token where each n-gram ends; any one will do
            at[a.back[k][a.back[k] >= 0]] = np.flatnonzero(a.back[k] >= 0)
            own = a.count[k][:n]
            if k == 1:
                chance[1], self.arc[1] = (own + 1) / (tokens + kinds + 1), np.ones(n, bool)
                shorter = np.zeros(n, np.int64)
            else:
                history = np.where(line.number[at] >= 1, a.count[k - 1][a.back[k - 1][at - 1]], a.n_train)
                known = np.ones(n, bool) if k == 2 else a.back[k - 1][at - 1] >= 0
                self.arc[k] = (own > 0) & (history >= a.cutoff) & known
                lower = chance[k - 1][a.back[k - 1][at]] if n else np.zeros(0)
                chance[k] = (own + strength(k - 1) * lower) / (history + strength(k - 1))
                shorter = self.dest[k - 1][a.back[k - 1][at]] if n else np.zeros(0, np.int64)
            self.log[k] = np.log10(chance[k])
            self.state[k] = np.full(n + 1, -1, np.int64)
            if k < order:
                new = np.flatnonzero(own >= a.cutoff)
                self.state[k][new] = total + np.arange(len(new))
                total += len(new)
                depth.append(np.full(len(new), k))
                fail.append(shorter[new])
                count.append(own[new])
            self.dest[k] = np.where(self.state[k][:n] >= 0, self.state[k][:n], shorter)
        self.depth, self.fail = np.concatenate(depth), np.concatenate(fail)
        seen = np.concatenate(count)
        k = np.array([strength(max(1, int(d))) for d in range(order + 1)])[self.depth]
        self.fail_log = np.log10(k / (seen + k))
        self.start = BEGIN if a.n_train >= a.cutoff and order > 1 else ROOT

    def after(self, tokens: np.ndarray) -> np.ndarray:
        """The state that any traversal is in after these tokens: the longest suffix that is one."""
        out = np.zeros(len(tokens), np.int64)
        for k in range(1, self.order):
            own = self.state[k][self.a.back[k][tokens]]
            out = np.where(own >= 0, own, out)
        return out

    def score(self) -> np.ndarray:
        """log10 probability of each text: all texts side by side, one token a step, each lane carrying its state.

        A text of more than ``SEGMENT`` tokens takes several lanes; a later one
        begins in the state that the tokens before it lead to.
        """
        line = self.a.line
        lanes = -(-line.n_tokens // SEGMENT)
        doc = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = line.begins[doc] + nth * SEGMENT
        length = np.minimum(line.ends[doc] - begin, SEGMENT)
        state = np.where(nth == 0, self.start, self.after(np.maximum(begin - 1, 0)))
        by = np.argsort(-length, kind="stable")
        doc, begin, length, state = doc[by], begin[by], length[by], state[by]
        total = np.zeros(len(doc))
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for step, n in enumerate(active.tolist()):
            token, now, sum_ = begin[:n] + step, state[:n], total[:n]
            left = np.arange(n)
            for k in range(self.order, 0, -1):
                here = left[self.depth[now[left]] == k - 1]
                if not len(here):
                    continue
                gram = self.a.back[k][token[here]]
                hit = np.ones(len(here), bool) if k == 1 else (gram >= 0) & self.arc[k][gram] if len(self.arc[k]) else np.zeros(len(here), bool)
                go, miss = here[hit], here[~hit]
                sum_[go] += self.log[k][gram[hit]]
                sum_[miss] += self.fail_log[now[miss]]
                now[miss] = self.fail[now[miss]]
                now[go] = self.dest[k][gram[hit]]
                # those that took an arc are done with this token
                done = np.zeros(n, bool)
                done[go] = True
                left = left[~done[left]]
        return np.bincount(doc, total, len(lanes))


def score_documents(docs: DataFrame, held_out: str | None = None, order: int = ORDER, strengths: Sequence[float] = STRENGTHS, cutoff: int = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document under the model of those that are not held out.

    ``held_out``: a boolean SQL expression over the columns of ``docs``; null counts as false.
    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score, both log10 of the text's probability.  Tokens are words
    with A-Z folded, then one end.  A null text is empty, a null id one more
    document; repeated rows are documents of their own; other columns are
    ignored; an empty table gives no rows.  N-grams of two and more words are
    told apart by 40 bits of a hash besides their part's number (parts do not
    grow, so at some millions of n-grams a part, one in a few hundred thousand
    shares its count with another), single words by 64.
    """
    spark = docs.sparkSession
    ship(spark)
    blocks, parts = layout(docs)
    held = F.coalesce(F.expr(held_out), F.lit(False)) if held_out else F.lit(False)
    rows = docs.select(block_of(F.col(id_col), F.col(text_col), blocks).alias("block"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))

    def questions(block: int, line: _Line, is_held: np.ndarray, grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        train = ~is_held[line.doc]
        out = []
        for k, (keys, back) in grams.items():
            own = back[train & (back >= 0)]
            counts = np.bincount(own, minlength=len(keys))
            for p, cell in _cells(keys, parts):
                out.append((p, block, k, keys[cell].tobytes() if k == 1 else _five(keys[cell]), pack_counts(counts[cell])))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "k", "keys", "counts"])

    def ask_first(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        _, texts, is_held = _ordered(table)
        line = _Line(texts)
        return questions(key[0].as_py(), line, is_held, {k: line.grams(k) for k in range(1, min(order, 2) + 1)})

    def ask_longer(k: int):  # noqa: ANN202
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            trim()
            _, texts, is_held = _ordered(left)
            line = _Line(texts)
            a = _Answers(line, range(1, k), right, parts, cutoff)
            return questions(key[0].as_py(), line, is_held, {k: line.grams(k, a.wanted(k))})

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        asked = pa.Table.from_batches(got)
        block, part, order_of = (asked.column(c).to_pylist() for c in ("block", "part", "k"))
        raw, packed = asked.column("keys").to_pylist(), asked.column("counts").to_pylist()
        del asked, got
        tokens = kinds = 0
        replies: list[bytes] = [b""] * len(raw)
        for k in sorted(set(order_of)):
            mine = [i for i, x in enumerate(order_of) if x == k]
            sizes = [len(raw[i]) // (8 if k == 1 else 5) for i in mine]
            joined = b"".join(raw[i] for i in mine)
            keys = np.frombuffer(joined, "<u8") if k == 1 else _eight(joined)
            if k > 1 and len({part[i] for i in mine}) > 1:  # several parts in one task: 40 bits tell n-grams apart within a part only
                keys = keys | (np.repeat(np.array([part[i] for i in mine]), sizes).astype(np.uint64) << np.uint64(40))
            counts = np.concatenate([unpack_counts(packed[i], n) for i, n in zip(mine, sizes, strict=True)])
            by = np.argsort(keys, kind="stable")
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[by][1:] != keys[by][:-1]
            totals = np.add.reduceat(counts[by], np.flatnonzero(fresh))
            reply = np.empty(len(keys), np.int64)
            reply[by] = totals[np.cumsum(fresh) - 1]
            if k == 1:
                tokens, kinds = int(totals.sum()), int((totals > 0).sum())
            at = 0
            for i, n in zip(mine, sizes, strict=True):
                replies[i] = pack_counts(reply[at : at + n])
                at += n
        names = ["block", "part", "k", "counts", "tokens", "kinds"]
        nothing = pa.nulls(len(raw), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(order_of, pa.int32()), pa.array(replies, pa.binary()), nothing, nothing], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([tokens], pa.int64()), pa.array([kinds], pa.int64())], names=names)

    ask_ddl = "part int, block long, k int, keys binary, counts binary"
    reply_ddl = "block long, part int, k int, counts binary, tokens long, kinds long"
    answered = lambda asked: map_arrow(asked.repartitionById(parts, F.col("part")), answer, reply_ddl)
    first = answered(rows.groupBy("block").applyInArrow(ask_first, ask_ddl))
    size = first.where("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    replies = first.where("block IS NOT NULL").drop("tokens", "kinds")
    for k in range(3, order + 1):
        longer = answered(rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(ask_longer(k), ask_ddl))
        replies = replies.unionByName(longer.where("block IS NOT NULL").drop("tokens", "kinds"))
    # the size of the training text goes to each block once, not along with every reply
    nothing = lambda kind: F.lit(None).cast(kind)
    sizes = spark.range(blocks).join(F.broadcast(size)).select(F.col("id").alias("block"), nothing("int").alias("part"), nothing("int").alias("k"), nothing("binary").alias("counts"), "tokens", "kinds")
    replies = replies.withColumn("tokens", nothing("long")).withColumn("kinds", nothing("long")).unionByName(sizes)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        names, texts, is_held = _ordered(left)
        n = len(names)
        if not n:  # a block that no document fell into
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        line = _Line(texts)
        a = _Answers(line, range(1, order + 1), right, parts, cutoff)
        tokens, kinds = (right.column(c).drop_null()[0].as_py() for c in ("tokens", "kinds"))
        seen = a.at_token(1)
        base = np.add.reduceat(np.log10((seen + 1) / (tokens + kinds + 1)), line.begins)
        known = np.add.reduceat((seen > 0).astype(np.int64), line.begins)
        total = Automaton(a, order, strengths, tokens, kinds).score()
        return pa.table(
            [pa.array(names, pa.int64()), pa.array(is_held), pa.array(line.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(base), pa.array(total)],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
