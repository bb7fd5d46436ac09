import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries, rule_classifier

from .samples import no_documents, odd_documents, odd_rows


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(3)
    x = {k: rng.random(4000) for k in ("words", "upper", "symbols")}
    y = ((x["words"] > 0.4) & ~((x["upper"] > 0.5) & (x["symbols"] > 0.3))).astype(int)
    model = rule_classifier.fit_rules(x, y)
    assert ((model.predict(x) >= 0.5) == y).mean() > 0.95
    assert 0 < len(model.rules) < 120


def test_query_on_held_out(spark, sf_dir):
    got = queries.op10_quality_classifier(spark, sf_dir)
    rows = got.collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.85


def test_column_equals_arrays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = rule_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stats = docs.select("doc_id", rule_classifier.stats_struct(F.col("text")).alias("s"))
    x = stats.select("doc_id", *(rule_classifier._feature(f, "s").alias(f) for f in rule_classifier.FEATURES)).orderBy("doc_id").toPandas()
    want = model.predict({f: x[f].to_numpy() for f in rule_classifier.FEATURES})
    got = [r.score for r in rule_classifier.with_score(docs, model).orderBy("doc_id").collect()]
    assert got == pytest.approx(want, rel=1e-9)


def test_odd_inputs(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] * 2 + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    docs = odd_documents(spark)
    model = rule_classifier.train(docs, labels)
    got = rule_classifier.with_score(docs, model).collect()
    assert {r.score_input for r in got} == {"z"}
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    again = rule_classifier.train(docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("zzz"))), labels)
    assert again == model  # of rows that repeat an id the first text counts, however many there are
    empty = rule_classifier.train(docs, labels.limit(0))
    assert empty.rules == () and empty.bias == 0
    assert rule_classifier.with_score(no_documents(spark), empty).count() == 0
