import numpy as np
import pytest

from textloom import queries
from textloom.operators import graph


def test_relation_matrix_is_whole(spark, tmp_path):
    """One order of parts around both bounds: a chain of links between neighbours."""
    parts = [5, 99, 100, 101, 5998, 5999, 6000, 6001]
    spark.createDataFrame([(1, p) for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    chain = set(zip(parts, parts[1:]))
    rows = lambda name: {(r.src, r.dst) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("relation_matrix_full") == chain
    assert rows("relation_matrix") == {(a, b) for a, b in chain if b < 6000}


def test_all_iterations_of_the_constant_teleport(spark, tmp_path):
    """A long chain of parts with two shortcuts: ranks still move after the first steps."""
    n = 60
    chain = [(k, p) for k in range(1, n) for p in (k, k + 1)]
    spark.createDataFrame(chain + [(n, 7), (n, 30), (n + 1, 2), (n + 1, 50)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(1, n + 1)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    links = np.zeros((n, n))
    for a, b in {(k, k + 1) for k in range(1, n)} | {(7, 30), (2, 50)}:
        links[a - 1, b - 1] = 1
    step = 0.85 * links / np.maximum(links.sum(axis=1, keepdims=True), 1)
    ranks = {0: np.full(n, 1 / n)}
    for k in range(1, 101):
        ranks[k] = ranks[k - 1] @ step + 0.15 / n
    assert abs(ranks[100] - ranks[5]).max() > 1e-3
    got = {r.id: r["rank"] for r in graph.page_rank(queries._nodes(spark, str(tmp_path)), queries._edges(spark, str(tmp_path)), False, 100, None).collect()}
    assert [got[i] for i in range(1, n + 1)] == pytest.approx(ranks[100].tolist(), abs=1e-12)
    shown = {r.id: r["rank"] for r in queries.QUERIES["pagerank_fixed_full"](spark, str(tmp_path)).collect()}
    assert shown == {i: round(x, 9) for i, x in got.items()}


def test_rounds_that_move_nothing_are_left_out(spark, monkeypatch):
    """From the third round on a short chain stands still; a ring with a way in goes on for longer and keeps all its rounds."""
    calls = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: calls.append(1) or cut(df))
    nodes = spark.range(1, 5)
    chain = spark.createDataFrame([(1, 2), (2, 3), (2, None)], "src long, dst long")
    got = {r.id: r.rank for r in graph.page_rank(nodes, chain, False, 100, None).collect()}
    t = 0.15 / 4
    assert got == pytest.approx({1: t, 2: t + 0.85 * t, 3: t + 0.425 * (t + 0.85 * t), 4: t}, abs=1e-15)
    assert len(calls) <= 3
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long")
    some = {r.id: r.rank for r in graph.page_rank(nodes, ring, False, 12, None).collect()}
    ranks = dict.fromkeys(range(1, 5), 0.25)
    for _ in range(12):
        ranks = {1: t, 2: t + 0.85 * (ranks[1] + ranks[3]), 3: t + 0.85 * ranks[2], 4: t}
    assert some == pytest.approx(ranks, abs=1e-15)
