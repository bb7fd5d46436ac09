import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import packing, queries

from .samples import no_documents, odd_documents, odd_rows


def reference_pieces(rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    out = {}
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        edges = [0, len(ids)]
        if len(ids) > 2048:
            edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            out[doc, k] = (a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes()))
    return out


def check(rows, docs):
    want = reference_pieces(docs)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_odd_documents(spark):
    rows = packing.pack_documents(odd_documents(spark), queries.tokenizer_path()).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack_documents(no_documents(spark), queries.tokenizer_path()).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op1_best_fit_packing(spark, sf_dir).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs])
    assert used <= -(-sum(r.length for r in rows) // 2048) + 3


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_an_optimum(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 30))
    items = sorted((int(x) for x in rng.integers(1, capacity + 1, int(rng.integers(1, 9)))), reverse=True)
    fixed, left = packing.dominate(dict(Counter(items)), capacity)
    used = Counter()
    for bins, n in fixed:
        assert sum(bins) <= capacity and n > 0
        for b in bins:
            used[b] += n
    assert used + Counter(left) == Counter(items)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)
    packed = packing.best_fit(left, capacity)
    assert Counter(x for bins, n in packed for b in [bins] * n for x in b) == Counter(left)
    assert all(sum(bins) <= capacity for bins, _ in packed)


def test_encoder_forgets(sf_dir):
    """With memory for few chunks the ids are the same, and no more chunks are held than asked for."""
    import pyarrow.parquet as pq
    from textloom.llm.kernel import Block

    texts = [x.encode() for x in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()][:120]
    texts += ["a b c".encode(), b"", b" ", b"\n\n x  y\t\tz \n", "<|endoftext|> x".encode(), b"word", b"word word\nword"]
    small = packing.ChunkEncoder(queries.tokenizer_path(), 3000)
    for a in range(0, len(texts), 10):
        some = texts[a : a + 10]
        got = small.block(Block(some))
        want = [small.tok.encode(x.decode(), add_special_tokens=False).ids for x in some]
        assert [g.tolist() for g in got] == want
        n = len({c for x in some for c in x.split()})
        assert small.known <= max(3000, 3 * n)
        assert all((np.diff(k.astype(object)) > 0).all() for k, _, _ in small.levels)
