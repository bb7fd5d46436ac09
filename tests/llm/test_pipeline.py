import re

import pytest

import corpus_pipeline as cp
from textloom.llm import queries

from .samples import folder, odd_documents
from .test_ngram_join import brute as brute_links
from .test_packing import check
from .test_substring_dedup import brute as brute_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Every stage's input and output on the smallest tables."""
    root = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        after = spark.read.parquet(f"{root}/{k}")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, sf_dir, stages):
    before, after = map(rows, stages[0])
    assert all(before[i] == r for i, r in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i in after for i in before if labels.get(i) == 1]
    bad = [i in after for i in before if labels.get(i) == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_near_duplicates(stages):
    before, after = map(rows, stages[1])
    links = brute_links([(i, r.text) for i, r in before.items()], 5, 80)
    assert after == {i: r for i, r in before.items() if links[i][1] == i}


def test_repeated_spans(stages):
    before, after = map(rows, stages[2])
    order = sorted(before)
    kept = dict(zip(order, brute_spans([(i, before[i].text) for i in order])))
    for i in order:
        words = re.findall("[^\x20\x09-\x0d]+", before[i].text)
        if len(kept[i]) == len(words):
            assert after[i] == before[i]
        elif kept[i]:
            assert after[i].text == " ".join(kept[i]) and after[i].n_chars == len(after[i].text)
        else:
            assert i not in after


def test_decontaminate(spark, sf_dir, stages):
    before, after = map(rows, stages[3])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert all(before[i] == r for i, r in after.items())
    for i, r in before.items():
        if any(x in r.text for x in items):
            assert i not in after
    assert len(after) > 0.8 * len(before)


def test_pack(stages):
    before, after = stages[4]
    check(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_run_and_odd_tables(spark, sf_dir, stages, tmp_path):
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in cp.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[-1][1].collect())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    odd = folder(spark, tmp_path / "odd", documents=odd_documents(spark), labels=labels, benchmark=bench)
    got = {r.doc_id for r in cp.run(spark, odd).collect()}
    assert {0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12} >= got >= {0, 1, 2, 3, 4, 5, 6, 8}
    none = folder(spark, tmp_path / "none", documents=odd_documents(spark).limit(0), labels=labels, benchmark=bench)
    assert cp.run(spark, none).count() == 0
    assert queries.tokenizer_path()


def test_clashes_nulls_and_repeats(spark, sf_dir, tmp_path):
    """Columns called like those a stage adds, null ids and texts, repeated rows, ties: every stage gives its columns back."""
    same = " ".join(f"word{i}" for i in range(60))
    rows = [(1, same), (1, same), (1, "another text of this id stands here"), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, "short one"), (5, "short one")]
    names = ["__quality", "__kept", "__n_words", "__n_removed", "__gone", "__times", "score", "block", "rest", "component_id", "__textloom_leaks_0", "__textloom_stats"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    folder(spark, tmp_path, labels=labels, benchmark=spark.createDataFrame([(1, "short one"), (2, None)], "item_id long, text string"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: repr(tuple(r))
    got = {}
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.dtypes == docs.dtypes, name
        got[name] = sorted(after.collect(), key=key)
    texts = lambda name: sorted([(r.doc_id or -1, r.text) for r in got[name]], key=repr)
    count = lambda pairs: sorted([(i or -1, t) for i, t in pairs], key=repr)
    # near duplicates: of the repeated rows one each; 2 is a copy of another text of 1's rows than the one compared
    assert texts("ngram_jaccard_join") == count([(1, same), (1, rows[2][1]), (2, same), (None, same), (None, None), (3, None), (4, ""), (5, "short one")])
    assert texts("substring_dedup") == count([(1, same), (1, rows[2][1]), (None, None), (3, None), (4, ""), (5, "short one"), (5, "short one")])
    assert texts("benchmark_decontamination") == count([r for r in rows if r[1] != "short one"])
    for name in ("quality_classifier", "benchmark_decontamination"):
        assert set(map(key, got[name])) <= set(map(key, docs.collect()))
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() == len(rows)
