import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import lm, queries

from .samples import no_documents, odd_documents, odd_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEGIN, END = "\r", "\n"


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD)), END]


class Walk:
    """The automaton as dictionaries: states by history, arcs, failure links; walked token by token."""

    def __init__(self, lines, order, strengths=lm.STRENGTHS, cutoff=lm.CUTOFF):
        count = Counter()
        for line in lines:
            seq = [BEGIN, *line]
            for j in range(1, len(seq)):
                for n in range(1, order + 1):
                    if j - n + 1 >= 0:
                        count[tuple(seq[j - n + 1 : j + 1])] += 1
        count[(BEGIN,)] = len(lines)
        self.count = count
        self.total = sum(c for g, c in count.items() if len(g) == 1 and g != (BEGIN,))
        self.kinds = sum(len(g) == 1 and g != (BEGIN,) for g in count)
        self.k = lambda n: strengths[min(n, len(strengths)) - 1]
        self.states = {()} | {g for g, c in count.items() if len(g) < order and c >= cutoff}
        self.arcs = defaultdict(dict)
        for g, c in count.items():
            if len(g) > 1 and g[:-1] in self.states and c:
                self.arcs[g[:-1]][g[-1]] = c

    def unigram(self, w):
        return (self.count[(w,)] + 1) / (self.total + self.kinds + 1)

    def chance(self, h, w):
        if not h:
            return self.unigram(w)
        c, k = self.arcs[h].get(w), self.k(len(h))
        rest = self.chance(h[1:], w)
        return (c + k * rest) / (self.count[h] + k) if c else k / (self.count[h] + k) * rest

    def score(self, line):
        state = (BEGIN,) if (BEGIN,) in self.states else ()
        total = 0.0
        for w in line:
            here = state
            while here and w not in self.arcs[here]:
                k = self.k(len(here))
                total += math.log10(k / (self.count[here] + k))
                here = here[1:]
            total += math.log10(self.chance(here, w))
            state = (*here, w)
            while state not in self.states:
                state = state[1:]
        return total


def reference(rows, held, order=lm.ORDER):
    """rows: (id, text); held(id): out of training."""
    walk = Walk([tokens(t) for i, t in rows if not held(i)], order)
    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10(walk.unigram(t)) for t in own)
        out.append((i, held(i), len(own), sum(walk.count[(t,)] > 0 for t in own), walk.total, base, walk.score(own)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_states_sum_to_one():
    lines = [tokens(t) for t in ("a b a b c", "a b c", "b c a", "a", "")]
    walk = Walk(lines, 3)
    words = sorted({w for x in lines for w in x})
    for h in walk.states:
        if h[-1:] == (END,):  # nothing follows an end
            continue
        assert sum(walk.chance(h, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op8_lm_scoring(spark, sf_dir).collect()
    same(got, reference(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_odd_documents(spark, order):
    df = odd_documents(spark).unionByName(odd_documents(spark).limit(1)).unionByName(spark.sql("SELECT cast(NULL AS long) doc_id, 'a b' text, '' lang, '' source, 1L n_chars, '' length, '' bucket, '' score"))
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [rows[0], (None, "a b")]
    same(lm.score_documents(df, "doc_id % 3 = 1", order).collect(), reference(rows, lambda i: i is not None and i % 3 == 1, order))
    assert lm.score_documents(no_documents(spark)).count() == 0


def test_nothing_to_train_on(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    same(lm.score_documents(df, "true").collect(), reference([(1, "a b a"), (2, None)], lambda i: True))


def test_counts_beyond_a_byte():
    import numpy as np
    from textloom.llm.runtime import pack_counts, unpack_counts

    counts = np.array([0, 1, 254, 255, 256, 2**32, 2**40, 3])
    assert (unpack_counts(pack_counts(counts), len(counts)) == counts).all()
    assert len(unpack_counts(pack_counts(counts[:0]), 0)) == 0
