import random
import re

import pytest

from textloom.llm import ngram_join, queries
from textloom.llm.components import components

from .samples import no_documents, odd_documents, odd_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            p, q = sets[i], sets[j]
            if p and q and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                c = len(p & q)
                if 100 * c >= percent * (len(p) + len(q) - c):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(rows, 4, 85)
    assert any(i != c for i, (_, c) in got.items())


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 4, 85), (1, 2, 80), (2, 1, 60), (3, 1, 85)])
def test_random_groups(spark, monkeypatch, seed, k, percent):
    """Small and large near copies, long lists and stars, chains that link only through others."""
    rng = random.Random(seed)
    rows = []
    for g in range(14):
        size = rng.choice([3, 5, 7, 9, 12, 14, 20, 26, 60, 150])
        base = [f"g{g}w{rng.randrange(2 * size)}" if rng.random() < 0.8 else rng.choice(["the", "of"]) for _ in range(size)]
        for _ in range(rng.choice([1, 4, 12, 60])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 9))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(60)}"
            rows.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.class_links(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_sizes_and_boundary():
    for percent in (60, 80, 85):
        for n in range(1, 30):
            for m in ngram_join.partner_sizes(n, percent):
                c = ngram_join.need(n, m, percent)
                assert 100 * c >= percent * (n + m - c) and 100 * (c - 1) < percent * (n + m - c + 1)
    assert ngram_join.boundary(85, 0.0) <= ngram_join.boundary(85, 5.0) <= ngram_join.boundary(85, 500.0)


def test_odd_inputs(spark):
    df = odd_documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.class_links(df).collect()}
    assert got == brute([(r[0], r[1]) for r in odd_rows()], 4, 85)
    assert ngram_join.class_links(no_documents(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "z y x w v"), (7, "A b C d e")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in ngram_join.class_links(df).collect()) == [(-1, None), (5, 5), (5, 5), (7, 5)]


def test_hubs_and_long_lists_in_many_tasks(spark, monkeypatch):
    """Nodes with many neighbours are told by broadcast, very long lists are salted; the rows are the same."""
    from textloom.llm import components as c

    monkeypatch.setattr(c, "HUB", 5)
    monkeypatch.setattr(c, "MOST_HUBS", 10)
    rng = random.Random(2)
    edges = [(0, j) for j in range(1, 200)] + [(199, j) for j in range(300, 500)] + [(j, j + 1) for j in range(600, 640)]
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(8)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{j: 0 for j in [*range(200), *range(300, 500)]}, **{j: 600 for j in range(600, 641)}}


def test_components_of_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(1000, 1000 + j) for j in range(1, 40)]
    rng.shuffle(edges)
    df = spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: i // 50 * 50 for i in range(300)}, **{1000 + j: 1000 for j in range(40)}}
    assert components(df.limit(0)).count() == 0
