import random
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import boolean, diversity, graph, index, phrase, relevance, store
from textloom.plans.engine import SearchEngine
from textloom.plans.parser import parse_query
from textloom.sources import tables

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "apple cherry cherry date"), (4, "elder")]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, f"http://h.org/{i}", t.split()[0], t) for i, t in DOCS], "doc_id long, url string, title string, text string")
    tokens, lengths = index.text_tokens(docs), index.doc_lengths(docs)
    post = index.postings(tokens, lengths)
    return {"docs": docs, "tokens": tokens, "lengths": lengths, "post": post, "stats": index.term_stats(post, index.count_documents(docs))}


def test_idf_variants(small):
    got = {r.term: r for r in small["stats"].collect()}
    assert got["apple"].idf_log10 == pytest.approx(0.124939, abs=1e-6) and got["date"].idf_log10 == pytest.approx(0.301030, abs=1e-6)
    assert got["apple"].idf_smooth == pytest.approx(1.510826, abs=1e-6) and got["elder"].idf_smooth == pytest.approx(1.916291, abs=1e-6)
    assert got["cherry"].idf_plain == pytest.approx(0.301030, abs=1e-6) and got["date"].idf_ln == pytest.approx(1.386294, abs=1e-6)


def test_bm25(small):
    got = {(r.term, r.doc_id): r for r in index.metrics(small["post"], small["stats"], small["lengths"]).collect()}
    assert got["apple", 1].tf_idf == pytest.approx(1.966755, abs=1e-6) and got["apple", 3].normalized == pytest.approx(0.616788, abs=1e-6)
    assert got["cherry", 2].tf_idf == pytest.approx(1.645454, abs=1e-6) and got["cherry", 3].tf_idf == pytest.approx(1.777442, abs=1e-6)
    assert max(r.normalized for r in got.values()) == 1


def test_sets(small):
    post = small["post"]
    ids = lambda df: {r.doc_id for r in df.collect()}
    a, c = boolean.having_term(post, "apple"), boolean.having_term(post, "cherry")
    assert ids(boolean.both(a, c)) == {3} and ids(boolean.either(a, c)) == {1, 2, 3} and ids(boolean.first_only(a, c)) == {1}
    assert ids(boolean.relaxed(post, ["banana", "date", "elder"])) == {1, 2, 3, 4}
    assert ids(boolean.relaxed(post, ["apple", "banana"])) == {1}
    assert ids(boolean.relaxed(post, ["none"])) == set()
    assert ids(boolean.relaxed(post, ["apple", "x1", "x2", "x3"])) == {1, 3}


def test_phrases(spark, small):
    tokens = small["tokens"]
    hits = lambda p, **k: {r.doc_id: r.n_hits for r in phrase.positional(tokens, p.split(), **k).collect()}
    assert hits("banana apple") == {1: 1} and hits("cherry cherry") == {3: 1} and hits("apple date") == {}
    two = spark.createDataFrame([(1, "p", 0, 0, "a"), (1, "p", 1, 1, "b")], "doc_id long, tag string, element_no int, position int, term string")
    assert phrase.positional(two, ["a", "b"]).count() == 0 and phrase.positional(two, ["a", "b"], strict=True).count() == 1
    docs = spark.createDataFrame([(1, "u/big-cat", "big cat", "big cat and big cat", "x"), (2, "u", "t", "one big cat", "one big cat"), (3, "u", "t", "big dog", "")], "doc_id long, url string, title string, text string, first string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", phrase.literal_score("big cat", F.col("first")).alias("s")).collect()}
    assert got[1] == pytest.approx(3 * (1 + np.log(2)) * 2) and got[2] == 1.5 and got[3] == 1


def test_live_short_cuts(spark):
    long = " ".join(["filler"] * 60)
    rows = [
        (1, "u", "t", "alpha beta"), (2, "u", "has alpha beta", long), (3, "x/alpha/beta", "t", long), (4, "u", "beta then alpha", long), (5, "u", "t", long + " alpha beta"),
        (6, "u", "t", long + " alpha"), (7, "u", "t", " ".join(["w"] * 48)), (8, "u", "t", " ".join(["w"] * 49 + ["alpha"])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, text string")
    post = index.postings(index.text_tokens(docs), index.doc_lengths(docs))
    stats = index.term_stats(post, index.count_documents(docs))
    got = {r.doc_id: r.score for r in relevance.live(docs, post, stats, ["alpha", "beta"]).collect()}
    assert got[1] == 0.01 and got[2] == 1000 and got[3] == 500 and got[4] == 300 and got[7] == 0.01
    assert got[8] == pytest.approx(np.log10(8 / 4) / 50)
    assert got[5] == pytest.approx((np.log10(8 / 4) / 62 + np.log10(8 / 2) / 62) * 3) and got[6] == pytest.approx(np.log10(8 / 4) / 61)
    assert {r.score for r in relevance.live(docs, post, stats, []).collect()} == {0.0}


def test_proximity_bands(spark):
    rows = [(g, "aa " + "x " * (g - 1) + "bb") for g in (1, 3, 4, 10, 11, 50, 51)] + [(99, "aa aa"), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.bonus for r in relevance.proximity(docs, ["aa", "bb"]).collect()}
    assert got == {1: 2.0, 3: 2.0, 4: 1.0, 10: 1.0, 11: 0.5, 50: 0.5, 51: 0.0, 99: 0.0, 98: 0.0}
    assert relevance.proximity(docs, ["aab", "aa"]).where("bonus > 0").count() == 0


def test_page_rank(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1)], "src long, dst long")
    ranks = lambda *a: [r.rank for r in graph.page_rank(nodes, edges, *a).orderBy("id").collect()]
    assert ranks(True, 1) == pytest.approx([0.25, 0.14375, 0.35625, 0.0375])
    assert ranks(False, 60, None) == pytest.approx([0.290842, 0.161108, 0.298050, 0.0375], abs=1e-4)
    assert ranks(True, 100, 1e-12)[:3] == pytest.approx([0.010611, 0.005761, 0.010824], abs=2e-6)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    s = graph.link_stats(edges).first()
    assert (s.n_parents, s.n_relationships, s.avg_children, s.max_children, s.max_parent) == (2, 3, 1.5, 2, 1)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent_url string, child_url string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.level) for r in graph.expand_frontier(seeds, links).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.expand_frontier(seeds, links, limit=2).count() == 2


def test_blend_and_density(small):
    ranks = small["docs"].select(F.col("doc_id").alias("id"), F.lit(0.5).alias("rank"))
    rel = relevance.weighted_tfidf(small["post"], small["stats"], ["apple"])
    dens = relevance.density(small["post"], small["lengths"], ["apple"])
    got = {r.doc_id: r.score for r in relevance.blend(rel, ranks, dens).collect()}
    assert got[1] == pytest.approx(1.0) and got[4] == pytest.approx(0.1)
    assert {r.doc_id: r.density for r in dens.collect()}[1] == pytest.approx(100 * 2 / 3 * 1.2)


def test_store(spark):
    old = spark.createDataFrame([("a", 1, 2, 0.5, 2), ("b", 1, 1, 0.1, 8)], "term string, doc_id long, frequency long, tf double, importance int")
    new = spark.createDataFrame([("a", 1, 3, 0.9, 1), ("c", 2, 1, 0.2, 2)], old.schema)
    got = {(r.term, r.doc_id): tuple(r)[2:] for r in store.merge_postings(old, new).collect()}
    assert got == {("a", 1): (5, 0.9, 2), ("b", 1): (1, 0.1, 8), ("c", 2): (1, 0.2, 2)}
    assert sorted(r.frequency for r in store.add_counts(old, new, ["term"]).collect()) == [1, 1, 5]
    assert store.insert_ignore(old, new.union(new), ["term", "doc_id"]).count() == 3
    once = store.reindex(old, new)
    assert sorted(map(tuple, store.reindex(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert store.replace_rows(old, new, ["term"]).count() == 3 and store.delete_documents(old, new).count() == 0


@pytest.mark.parametrize(
    ("query", "kind"),
    [("machine learning", "keyword"), ('"machine learning"', "phrase"), ('"a b" AND "c d"', "boolean"), ('"a b" or "c d"', "boolean"), ("salt and pepper", "error"), ('"salt and pepper"', "error"), ('"a" AND "b" OR "c"', "phrase"), ('"', "error")],
)
def test_parser(query, kind):
    assert parse_query(query).kind == kind


def test_parser_parts():
    q = parse_query('"A b" not "c d"')
    assert (q.operator, q.phrases) == ("NOT", ("A b", "c d"))
    assert parse_query("The running dogs us").terms == ("run", "dog", "us")


def test_search(spark, small):
    long = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"http://h.org/{i}", f"title {i}", f"This apple pie number {i} is long enough. {long} more text {'apple ' * i}") for i in range(1, 8)], "doc_id long, url string, title string, text string")
    e = SearchEngine(docs)
    one = e.search("apple pies", 1, 3)
    assert one["totalResults"] == 7 and one["totalPages"] == 3 and len(one["results"]) == 3 and not one["fromCache"]
    assert e.search("apple pies", 1, 3)["fromCache"]
    two = e.search("apple pies", 2, 3)
    scores = [r["score"] for r in one["results"] + two["results"]]
    assert scores == sorted(scores, reverse=True) and not {r["doc_id"] for r in one["results"]} & {r["doc_id"] for r in two["results"]}
    assert "<strong>" in one["results"][0]["snippet"]
    assert e.search('"apple pie"')["totalResults"] == 7 and e.search('"pie apple"')["totalResults"] == 0
    assert e.search('"apple pie" AND "number 3"')["totalResults"] == 1 and e.search('"apple pie" not "number 3"')["totalResults"] == 6
    assert e.search("salt and pepper")["error"] and e.search("zzz")["totalResults"] == 0
    assert e.suggestions("apple pie", e.scored(e.analyze("apple")).join(docs, "doc_id")) == ["apple pie title", "title pie"]
    e.release()


def test_html_engine(spark, sf_dir):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<title>Apple</title><h1>apple</h1><p>apple tree apple</p><a href='/y'>n</a>"), (2, "http://a.org/y", "<title>T</title><p>tree</p>"), (3, None, "x")], "page_id long, url string, html string")
    docs = tables.html_documents(pages)
    e = SearchEngine(docs)
    got = {(r.term, r.doc_id): r for r in e.postings.collect()}
    assert got["appl", 1].importance == 10 and got["appl", 1].frequency == 4 and got["tree", 2].importance == 2
    assert [tuple(r) for r in graph.relations(graph.extract_links(docs), docs).collect()] == [(1, 2)]
    assert e.link_stats().first().n_relationships == 1
    e.release()


def test_robots(spark):
    lines = spark.createDataFrame([("a.org", i, v) for i, v in enumerate(["User-agent: bot", "Disallow: /no", "User-agent: *", "Disallow: /private", "Disallow:", "disallow: /tmp "])], "host string, line_no int, value string")
    rules = tables.robots_rules(lines)
    assert {(r.host, r.prefix) for r in rules.collect()} == {("a.org", "/private"), ("a.org", "/tmp")}
    urls = spark.createDataFrame([("http://a.org/private/x",), ("http://a.org/no",), ("http://b.org/private",), ("http://a.org/",)], "url string")
    assert {r.url for r in tables.allowed_by_robots(urls, rules).collect()} == {"http://a.org/no", "http://b.org/private", "http://a.org/"}


def test_seeds_and_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" http://a \n\nhttp://b\n")
    assert sorted(r.url for r in tables.seed_urls(spark, str(tmp_path / "s.txt")).collect()) == ["http://a", "http://b"]
    from textloom.functions import stop_words

    assert stop_words.load(spark, str(tmp_path / "s.txt")) == ["http://a", "http://b"]


def test_diversity():
    rows = [{"doc_id": i, "url": u, "title": t, "text": x, "score": s} for i, (u, t, x, s) in enumerate([("http://a/1", "one", "alpha beta gamma delta", 1.0), ("http://a/2", "one", "alpha beta gamma delta", 0.99), ("http://b/1", "two", "other words entirely here", 0.9)])]
    assert diversity.rerank(rows, ["alpha", "beta"]) == [0, 2, 1]
    assert diversity.rerank(rows, ["alpha"]) == [0, 1, 2] and diversity.rerank(rows[:1], ["a", "b"]) == [0]


def test_stream(spark, sf_dir, tmp_path):
    """Two deliveries of overlapping documents give the index of the whole."""
    from textloom.streaming import incremental

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    source, state = tmp_path / "in", {}
    docs.where("doc_id < 120").coalesce(1).write.mode("append").parquet(str(source))
    docs.where("doc_id >= 100").coalesce(1).write.mode("append").parquet(str(source))

    def write(df, number):
        path = str(tmp_path / f"v{number}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    read = lambda s: s.read.parquet(state["path"]) if state else None
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = incremental.index_batches(stream, read, write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = index.postings(index.text_tokens(docs), index.doc_lengths(docs)).select("term", "doc_id", "frequency")
    got = read(spark).select("term", "doc_id", "frequency")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_stream_windows(spark, sf_dir, tmp_path):
    from textloom.streaming import incremental

    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").coalesce(1)
    events.write.parquet(str(tmp_path / "e"))
    stream = incremental.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = incremental.event_counts(events)
    assert spark.table("counted").select("event_type", "n").groupBy("event_type").sum("n").exceptAll(want.groupBy("event_type").sum("n")).count() == 0


def test_lookups_and_views(spark, small):
    from textloom.operators import lookup
    from textloom.plans.engine import as_text

    docs, post, tokens = small["docs"], small["post"], small["tokens"]
    assert lookup.by_url(docs, "http://h.org/2").first().doc_id == 2
    assert lookup.existing(spark.createDataFrame([("http://h.org/1",), ("x",)], "url string"), docs).count() == 1
    assert [r.doc_id for r in lookup.posting_list(post, "apple", 1).collect()] == [1]
    assert [r.position for r in lookup.positions_of(tokens, "cherry", 3, "p").collect()] == [1, 2]
    assert lookup.at_position(tokens, 3, 3).first().term == "date" and lookup.of_document(post, 4).first().term == "elder"
    assert lookup.length_array(small["lengths"]).first().lengths == [3, 2, 4, 1]
    assert lookup.by_status(docs.withColumn("status", F.lit("visited")), "visited").count() == 4
    assert lookup.by_ids(docs, docs.where("doc_id = 1")).count() == 1 and lookup.idf_pairs(small["stats"]).count() == 5
    assert [r.doc_id for r in relevance.whole_number_order(spark.createDataFrame([(3, 1.9), (1, 1.1), (2, 2.0)], "doc_id long, score double")).collect()] == [2, 1, 3]
    assert relevance.term_weight("a", "b A") == 2.0 and relevance.term_weight("x", "b") == 1.0
    e = SearchEngine(docs, stem=False)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(e.mixed_boolean('apple AND "cherry cherry"')) == {3} and ids(e.mixed_boolean("apple not cherry")) == {1} and ids(e.mixed_boolean('"banana cherry" or elder')) == {2, 4}
    assert as_text(e.search("zzz")).startswith("zzz: 0 results") and e.total("zzz") == 0
    e2 = e.reindex(spark.createDataFrame([(9, "http://h.org/4", "fig", "fig")], docs.schema))
    assert ids(boolean.having_term(e2.build_index(), "fig")) == {9} and boolean.having_term(e2.postings, "elder").count() == 0
    ranks = docs.select(F.col("doc_id").alias("id"), F.lit(0.25).alias("rank"))
    page = e.ranked_page(["apple"], ranks, 1, 3).collect()
    assert [r.position for r in page] == [1, 2, 3] and page[0].doc_id == 1
    assert store.stamped(docs).where("last_indexed IS NULL").count() == 0
    e.release()
    e2.release()


def test_small_views():
    from textloom.functions import snippets

    assert snippets.highlight("<b>a short</b>", ["short"]) == "a short"
    assert snippets.highlight("this is a longer text about cats", ["cats"]) == "this is a longer text about <strong>cats</strong>"
    assert snippets.page_buttons(1, 10) == [1, 2, 3, 4, 5] and snippets.page_buttons(9, 10) == [6, 7, 8, 9, 10] and snippets.page_buttons(1, 2) == [1, 2]


def test_statistics_of_saved_tables(spark, small):
    small["post"].write.mode("overwrite").saveAsTable("textloom_post")
    store.refresh_statistics(spark, ["textloom_post"])
    assert spark.table("textloom_post").count() == small["post"].count()
    spark.sql("DROP TABLE textloom_post")


def test_diverse_head_and_tail(spark):
    """The best k in diverse order, then all others by score; greedy order against the plain function."""
    rows = [(i, f"http://h{i % 3}.org/a/{i}", f"title number {i % 4}", f"alpha beta words{i % 5} here and there number{i}", 10.0 - i // 2) for i in range(30)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, url string, title string, text string")
    hits = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, score double")
    got = diversity.diversify(hits, docs, ["alpha", "beta"], 8).collect()
    best = sorted(({"doc_id": r[0], "url": r[1], "title": r[2], "text": r[3], "score": r[4]} for r in rows), key=lambda r: (-r["score"], r["doc_id"]))
    want = [best[i]["doc_id"] for i in diversity.rerank(best[:8], ["alpha", "beta"])]
    assert [r.doc_id for r in sorted((r for r in got if r.position), key=lambda r: r.position)] == want
    assert {r.doc_id for r in got if r.position is None} == {r["doc_id"] for r in best[8:]} and len(got) == 30


def test_long_robots_rules(spark):
    far = "/" + "x" * 3000
    lines = spark.createDataFrame([("a.org", 0, "User-agent: *"), ("a.org", 1, f"Disallow: {far}y")], "host string, line_no int, value string")
    urls = spark.createDataFrame([(f"http://a.org{far}y",), (f"http://a.org{far}z",)], "url string")
    assert [r.url for r in tables.allowed_by_robots(urls, tables.robots_rules(lines)).collect()] == [f"http://a.org{far}z"]


def test_parts_of_many_dotted_words_take_linear_time(spark):
    import time

    from textloom.functions import text

    df = spark.createDataFrame([(" ".join(f"a{i}.b{i % 7}" for i in range(n)),) for n in (100, 20_000)], "t string")
    sizes = df.select(F.size(text.with_parts(text.tokens(F.col("t")))).alias("n"))
    sizes.collect()
    began = time.time()
    assert [r.n for r in sizes.collect()] == [207, 40_007]
    assert time.time() - began < 20


def test_nearest_against_all_pairs(spark):
    """Many blocks and slabs, ties, repeats of one set, empty and null sets, queries that are like nothing."""
    rng = random.Random(5)
    sets = {i: sorted({f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.randrange(1, 15))}) for i in range(120)}
    sets |= {120: [], 121: None, 122: sets[0], 123: sets[0], 140: sets[7], 160: ["alone"], 180: []}
    df = spark.createDataFrame(list(sets.items()), "doc_id long, w array<string>")
    want = set()
    for q in (i for i in sets if i % 20 == 0 and sets[i]):
        near = sorted((-len(set(sets[q]) & set(w)) / len(set(sets[q]) | set(w)), d) for d, w in sets.items() if d != q and w and set(w) & set(sets[q]))
        want |= {(q, d, -j) for j, d in near[:6]}
    for options in ({}, {"block": 2, "slab": 11}):
        got = [tuple(r) for r in diversity.nearest(df, df.where("doc_id % 20 = 0"), 6, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert diversity.nearest(df.limit(0), df.limit(0)).count() == 0


def test_forward_rows_give_the_postings_without_an_exchange(spark):
    texts = [(1, "b a a c.d a"), (2, None), (3, ""), (4, "the the"), (5, "walking walked walks the"), (6, "zz b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for rows in (texts, texts + [(1, "a new"), (None, "x yy")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for parts, stem in ((False, False), (True, True)):
            unique = index.unrepeated(docs)
            assert unique == (len(rows) == len(texts))
            lengths = index.doc_lengths(docs, parts=parts)
            want = index.postings(index.text_tokens(docs, ("the",), parts, stem), lengths)
            ahead = index.forward(docs, ("the",), parts, stem)
            assert "Exchange hash" not in ahead._jdf.queryExecution().executedPlan().toString()
            got = index.forward_postings(ahead, unique)
            assert sorted(got.drop("n_terms").collect(), key=repr) == sorted(want.collect(), key=repr)
            assert sorted(ahead.select("doc_id", "n_terms").collect(), key=repr) == sorted(lengths.collect(), key=repr)
            some = index.forward_postings(index.forward(docs, ("the",), parts, stem, only=["walk", "b"]), unique)
            assert sorted(some.drop("n_terms").collect(), key=repr) == sorted(want.where("term IN ('walk', 'b')").collect(), key=repr)


def test_nested_rows_are_the_nested_index_flat(spark):
    docs = spark.createDataFrame([(1, "u1", "t1", "aa bb aa"), (2, "u2", "t2", "bb"), (2, "u3", "t3", "cc bb"), (3, "u4", None, "")], "doc_id long, url string, title string, text string")
    for part in (docs, docs.where("doc_id <> 2")):
        nested = index.nested_index(index.text_tokens(part), part)
        want = nested.select("term", "total_frequency", F.explode("documents").alias("d")).select("term", "d.doc_id", "d.url", "d.title", "d.frequency", "total_frequency")
        unique = index.unrepeated(part)
        got = index.nested_rows(index.postings(index.text_tokens(part)), part, unique)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_nearest_exchanges_no_documents(spark):
    rows = [(i, [f"w{j}" for j in range(i % 7, i % 7 + 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>")
    asked = df.where("doc_id % 20 = 0")
    whole = diversity.nearest(df, asked, 3)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and "Repartition" not in plan
    assert {tuple(r) for r in diversity.nearest(df, asked, 3, words=4).collect()} == {tuple(r) for r in whole.collect()}


def test_a_query_builds_no_whole_index(spark):
    """Before the index is built a query makes tables of its own terms; afterwards it reads the index, with the same answers."""
    rows = [(i, f"http://h.org/{i}", f"t{i}", f"walking dogs {'bark loudly ' * (i % 3)}and {'run ' * i}" + "filler " * 60) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, title string, text string")
    new, built = SearchEngine(docs), SearchEngine(docs)
    built.build_index()
    ranks = docs.select(F.col("doc_id").alias("id"), F.lit(0.125).alias("rank"))
    for query in ("dog bark run", '"bark loudly"', '"walking dogs" and "bark loudly"'):
        assert sorted(new.scored(new.analyze(query)).collect()) == sorted(built.scored(built.analyze(query)).collect()) != []
    assert sorted(new.mixed_boolean('"walking dogs" NOT bark').collect()) == sorted(built.mixed_boolean('"walking dogs" NOT bark').collect()) != []
    assert new.ranked_page(["dog", "run"], ranks).collect() == built.ranked_page(["dog", "run"], ranks).collect() != []
    assert "postings" not in new.__dict__
