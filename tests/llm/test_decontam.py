import random

import numpy as np
import pytest

from textloom.llm import decontam, queries

from .samples import no_documents, odd_documents


def brute_score(q, d):
    best = 0
    h = [[0] * (len(d) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(d) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if q[i - 1] == d[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(10))
def test_alignment_score(seed):
    rng = random.Random(seed)
    q = [np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))], np.uint64) for _ in range(9)]
    d = [np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 20))], np.uint64) for _ in range(9)]
    score, end_q, end_d = decontam.align(q, d)
    assert score.tolist() == [brute_score(a, b) for a, b in zip(q, d)]
    for a, b, s, i, j in zip(q, d, score, end_q, end_d):
        assert brute_score(a[:i], b[:j]) == s


def test_query_finds_all_copies(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id): r for r in queries.op9_benchmark_decontamination(spark, sf_dir).collect()}
    assert want <= set(got)
    assert all(got[k].score == 1 for k in want)
    assert len(got) <= len(want) + 0.02 * len(docs)


def test_edited_copies_and_clean_documents(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(20, 50)))) for i in range(30)] + [(99, "qq zz"), (98, None), (None, "")]
    rows, want = [], set()
    for k in range(120):
        text = rng.choices(vocab, k=300)
        if k % 3 == 0:
            i, passage = items[rng.randrange(30)]
            words = passage.split()
            for _ in range(len(words) // 6):
                at = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[at] = "edited"
                else:
                    words.insert(at, "more")
            at = rng.randrange(300)
            text[at:at] = [w.upper() + "," for w in words]
            want.add((k, i))
        rows.append((k, " ".join(text), "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == want
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert kept == set(range(120)) - {k for k, _ in want}


def all_pairs(docs, items):
    """Every document aligned whole with every item: (doc, item) -> share of the full score."""
    out = {}
    words = lambda t: decontam.Block([decontam.normal((t or "").encode())]).word_hash()
    own = [(i, words(t)) for i, t in items]
    for d, text in docs:
        w = words(text)
        some = [(i, q) for i, q in own if len(q) and len(w)]
        if some:
            score, _, _ = decontam.align([q for _, q in some], [w] * len(some))
            for (i, q), x in zip(some, score.tolist()):
                if x >= max(len(q), 2 * min(len(q), 8)):
                    out[d, i] = x / (2 * len(q))
    return out


def test_query_against_all_pairs(spark, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in queries.op9_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == pytest.approx(all_pairs(docs, items))


@pytest.mark.parametrize("kind", ["change", "insert", "drop", "mixed"])
def test_edits_against_all_pairs(spark, kind):
    """Copies with an edit at every 1st to 6th word, evenly or at random, among common words: all leaks and nothing else, so a recall of 1."""
    rng = random.Random(kind)
    common = ["the", "of", "and", "to", "in"]
    items, docs = [], []
    for i in range(60):
        m = rng.choice((1, 2, 3, 5, 7, 8, 9, 12, 20, 24, 40, 60))
        items.append((i, " ".join(rng.choice(common) if rng.random() < 0.4 else f"i{i}x{j}" for j in range(m))))
        for step in range(1, 7):
            out = []
            for j, w in enumerate(items[-1][1].split()):
                edit = rng.random() * step < 1 if step % 2 else j % step == step - 1
                what = rng.choice(("change", "insert", "drop")) if kind == "mixed" else kind
                out += [w] if not edit else [w, rng.choice([*common, "more"])] if what == "insert" else [rng.choice([*common, "other"])] if what == "change" else []
            pad = lambda: [rng.choice([*common, f"c{rng.randrange(300)}"]) for _ in range(rng.randrange(0, 90))]
            docs.append((10 * i + step, " ".join(pad() + out + pad())))
    want = all_pairs(docs, items)
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == pytest.approx(want)
    assert len(want) > 60


def test_short_items_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "x yes, NO y"), (1, "x yes, NO y"), (None, "yes no"), (2, "no yes"), (3, None), (4, ""), (5, "a b c d " * 30_000 + "yes no")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "yes no"), (8, "absent"), (9, "d")], "item_id long, text string")
    got = sorted([tuple(r) for r in decontam.find_leaks(docs, bench).collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [r[:2] for r in got] == [(1, 7), (1, 7), (5, 7), (5, 9), (None, 7)] and all(r[2] == 1 for r in got)
    assert got[0][3:] == (1, 3) and got[2][3:] == (120_000, 120_002) and got[3][3:] == (3, 4)


def test_blocks_give_the_same(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.find_leaks(docs, bench).collect()))
    parts = decontam.benchmark_blocks(bench, limit=6000)
    assert len(parts) > 2
    monkeypatch.setattr(decontam, "benchmark_blocks", lambda b: parts)
    assert sorted(map(tuple, decontam.find_leaks(docs, bench).collect())) == whole


def test_odd_inputs(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.find_leaks(odd_documents(spark), bench).count() == 0
    assert decontam.find_leaks(no_documents(spark), bench).count() == 0
    assert decontam.find_leaks(odd_documents(spark), bench.limit(0)).count() == 0
    assert decontam.drop_leaks(odd_documents(spark), bench).columns == odd_documents(spark).columns


@pytest.mark.parametrize("exact", [0, 3])
def test_heavily_edited_copies(spark, exact):
    """18 to 33 % of the words substituted, evenly or at random, with and without exact copies elsewhere."""
    rng = random.Random(11)
    items = [(i, [f"i{i}x{j}" for j in range(rng.choice((24, 40, 60)))]) for i in range(40)]
    texts, want = [], set()
    for i, words in items:
        m = len(words)
        if i % 2:
            gone = set(range(2, m, 3 + i // 2 % 3))
        else:
            gone = set(rng.sample(range(m), int(m * rng.choice((0.18, 0.25, 0.33)))))
        copies = [[f"s{i}x{j}" if j in gone else w for j, w in enumerate(words)]] + [words] * exact
        for words in copies:
            want.add((len(texts), i))
            texts.append([f"c{rng.randrange(500)}" for _ in range(50)] + words + [f"c{rng.randrange(500)}" for _ in range(50)])
    # a word more after every two
    items.append((40, [f"i40x{j}" for j in range(30)]))
    want.add((len(texts), 40))
    texts.append([w for j, x in enumerate(items[40][1]) for w in ([x, f"m{j}"] if j % 2 else [x])])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for k, i in want:
        q = dict(items)[i]
        assert brute_score(q, texts[k]) >= len(q)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == want
