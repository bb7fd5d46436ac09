import re
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import quality_rules, queries
from textloom.llm.stats import BASE, MORE, document_stats

from .samples import no_documents, odd_documents, odd_rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_base_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r[1:]) for r in document_stats(docs).collect()} == want
    assert {r.doc_id: tuple(r[1:]) for r in document_stats(odd_documents(spark)).collect()} == {r[0]: base(r[1]) for r in odd_rows()}


def test_more_statistics(spark):
    got = {r.doc_id: r for r in document_stats(odd_documents(spark), BASE + MORE).collect()}
    for i, text, *_ in odd_rows():
        words = WORD.findall(text or "")
        assert got[i].n_distinct_words == len(set(words)), i
        assert got[i].n_chars_all == len(text or "")
        assert got[i].n_same_next == sum(a == b for a, b in zip(words, words[1:]))
        assert got[i].longest_word == max((len(w.encode()) for w in words), default=0)


def test_query_keeps_good_and_drops_junk(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = queries.op5_quality_rules(spark, sf_dir).join(labels, "doc_id").collect()
    assert not any(r.kept for r in got if r.base_failed)
    good = [r.kept for r in got if r.label == 1]
    bad = [r.kept for r in got if r.label == 0]
    assert sum(good) / len(good) > 0.9
    votes = quality_rules._with_votes(document_stats(spark.read.parquet(f"{sf_dir}/documents.parquet"), BASE + MORE), quality_rules.RULES).collect()
    assert len({r["__pattern"] for r in votes}) > 10
    assert sum(bad) / len(bad) < 0.2


def plain_em(patterns):
    """Two-class estimation in plain Python over single documents' votes; the start is part of the method."""
    n = len(patterns[0])
    post = []
    for v in patterns:
        bad, cast = v.count(-1), n - v.count(0)
        post.append(0.1 if 2 * bad > cast else 0.6 if bad else 0.95)
    for _ in range(500):
        tables = []
        for right, weight in ((1, post), (-1, [1 - p for p in post])):
            rows = []
            for r in range(n):
                seen = {x: 1.0 + (x == right) for x in (-1, 0, 1)}
                for v, w in zip(patterns, weight):
                    seen[v[r]] += w
                rows.append({x: c / sum(seen.values()) for x, c in seen.items()})
            tables.append(rows)
        share = (sum(post) + 1) / (len(post) + 2)
        new = []
        for v in patterns:
            g, b = share, 1 - share
            for r, x in enumerate(v):
                g, b = g * tables[0][r][x], b * tables[1][r][x]
            new.append(g / (g + b))
        moved = max(abs(a - b) for a, b in zip(new, post))
        post = new
        if moved < 1e-9:
            break
    return post


def test_kept_against_plain_estimation(spark, sf_dir):
    """Every verdict of the query, from votes taken in Python and estimated document by document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_quality_rules(spark, sf_dir).collect()}
    stats = [r.asDict() for r in document_stats(docs, BASE + MORE).collect()]
    between = lambda s: s.replace(" AND ", " and ").replace(" OR ", " or ")
    votes = []
    for r in stats:
        bad = [eval(between(rule.bad), {}, r) for rule in quality_rules.RULES]
        good = [eval(between(rule.good), {}, r) for rule in quality_rules.RULES]
        votes.append(tuple(0 if b == g else -1 if b else 1 for b, g in zip(bad, good)))
    post = plain_em(votes)
    for r, p in zip(stats, post):
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert abs(got[r["doc_id"]].quality - p) < 1e-6
        assert got[r["doc_id"]].kept == (not failed and p >= 0.5), r["doc_id"]


def test_accuracies_are_estimated():
    """Rules of known accuracy, one of them worse than chance and one that mostly abstains."""
    import random

    rng = random.Random(5)
    right, cast = (0.95, 0.9, 0.85, 0.9, 0.3, 0.9), (0.9, 0.8, 0.9, 0.7, 0.9, 0.2)
    patterns, truth = Counter(), {}
    for _ in range(30000):
        good = rng.random() < 0.8
        code = 0
        for p, c in zip(right, cast):
            v = 0 if rng.random() > c else (1 if good else -1) * (1 if rng.random() < p else -1)
            code = code * 3 + v + 1
        patterns[code] += 1
        truth.setdefault(code, Counter())[good] += 1
    model = quality_rules.fit_votes(patterns, 6)
    assert abs(model.share - 0.8) < 0.02
    for a, p in zip(model.accuracies(), right):
        assert abs(a - p) < 0.03
    called = {p: model.posterior(quality_rules._votes(p, 6)) >= 0.5 for p in patterns}
    assert sum(c for p, seen in truth.items() for good, c in seen.items() if called[p] == good) / 30000 > 0.95
    # not all must pass: most documents with some bad vote are good, and kept
    some = [p for p in patterns if -1 in quality_rules._votes(p, 6)]
    assert sum(patterns[p] for p in some if called[p]) > 0.5 * sum(patterns[p] for p in some)


def test_odd_inputs(spark):
    got = quality_rules.quality_votes(odd_documents(spark))
    assert got.count() == len(odd_rows())
    assert got.where(F.col("quality").isNull()).count() == 0
    again = quality_rules.quality_votes(odd_documents(spark).unionByName(odd_documents(spark)).unionByName(odd_documents(spark).limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert again.count() == 2 * len(odd_rows()) + 1 and again.where("doc_id IS NULL").count() == 1
    assert quality_rules.quality_votes(no_documents(spark)).count() == 0
