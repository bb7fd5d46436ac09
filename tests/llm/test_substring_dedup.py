import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, substring_dedup

from .samples import no_documents, odd_documents, odd_rows


def split(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(rows, length=20):
    """rows: (id, text) in order; the words that stay."""
    seen, out = set(), []
    for _, text in rows:
        words = split(text)
        gone = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone.update(range(i, i + length))
            seen.add(w)
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def test_query(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want = {i: (len(split(t)), len(split(t)) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, t), k in zip(rows, brute(rows))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, sf_dir).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    """Few words, so periods, overlaps, branches and shared passages abound."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randrange(5, 70))] for _ in range(12)]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(pool) if rng.random() < 0.7 else [rng.choice("ab")] * rng.randrange(1, 45)
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for length in (20, 3, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: r["__kept"] for r in substring_dedup.dedup(df, length).collect()}
        want = {i: " ".join(k) for (i, _), k in zip(sorted(rows), brute(sorted(rows), length))}
        assert got == want, length


def test_spans_are_verified_by_their_sources(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: split(r.text) for r in docs.collect()}
    spans = substring_dedup.repeated_spans(docs).collect()
    assert spans and any(s.n_words > 50 for s in spans)
    for s in spans:
        assert s.n_words >= 20 and (s.source_id, s.source_word) < (s.doc_id, s.first_word)
        assert words[s.doc_id][s.first_word : s.first_word + s.n_words] == words[s.source_id][s.source_word : s.source_word + s.n_words]


def test_odd_inputs(spark):
    got = substring_dedup.dedup(odd_documents(spark))
    assert got.columns[:8] == odd_documents(spark).columns
    want = {i: " ".join(k) for (i, *_), k in zip(odd_rows(), brute([(r[0], r[1]) for r in odd_rows()]))}
    assert {r.doc_id: r["__kept"] for r in got.collect()} == want
    assert all(r.length == "x" and r.bucket == "y" for r in got.collect())
    assert substring_dedup.dedup(no_documents(spark)).count() == 0
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, same), (5, same), (5, same)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r["__n_removed"]) for r in substring_dedup.dedup(df).collect()) == [(-1, 40), (5, 0), (5, 40)]
    assert got.where(F.col("__n_words").isNull()).count() == 0


@pytest.mark.parametrize("length", [20, 21, 3, 2])
def test_every_period(spark, length):
    """A line repeated in a row, in a document that shares nothing with any other."""
    rows = [(p, " ".join([f"p{p}w{j}" for j in range(p)] * 50)) for p in range(1, 2 * length + 1)]
    got = {r.doc_id: r["__kept"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    assert got == {i: " ".join(k) for (i, _), k in zip(rows, brute(rows, length))}


def test_clashing_columns_and_rows_without_id(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, same, 1, 2, 3), (None, "y " + same, 1, 2, 3), (None, same, 1, 2, 3), (9, same, 1, 2, 3)], "doc_id long, text string, __kept int, __n_words int, __n_removed int")
    got = substring_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "__kept_input", "__n_words_input", "__n_removed_input", "__n_words", "__n_removed", "__kept"]
    assert sorted((r.doc_id or -1, r["__n_removed"], r["__n_words"]) for r in got.collect()) == [(-1, 40, 40), (-1, 40, 40), (-1, 40, 41), (9, 0, 40)]
    spans = substring_dedup.repeated_spans(df).collect()
    assert len(spans) == 3 and {s.source_id for s in spans} <= {9, None}
