import pytest
from pyspark.sql import functions as F

from textloom.functions import html, snippets, stem, text, url
from textloom.operators import diversity

TOKENS = [
    ("Hello World", "hello world"),
    ("x+y=z", "x y z"),
    ("arr[i]", "arr i"),
    ("os.path.join path", "os.path.join os path join path"),
    ("path os.path", "path os.path os"),
    (".py file.py", ".py py file.py file"),
    ("cat /usr/local-bin/a.sh", "cat /usr/local-bin/a.sh /usr/local-bin/a sh usr local bin a.sh"),
    ("foo/bar", "foo /bar bar"),
    ("Café straße", "caf stra e"),
    ("a--b 3.14", "a b 3.14 3 14"),
    ("", ""),
    (None, ""),
]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", text.with_parts(text.tokens(F.col("t"))).alias("w")).collect()}
    for i, (_, want) in enumerate(TOKENS):
        assert got[i] == want.split(), TOKENS[i]


def test_stop_words_and_counts(spark):
    row = spark.sql("SELECT array('a','the','cat','x','sat') w, 'de la de la dela' t, '  a\n b  ' p").select(
        text.without_stop_words(F.col("w"), ["the", "cat"]).alias("w"), text.occurrences(F.col("t"), "de la").alias("n"), text.word_count(F.col("p")).alias("k")
    ).first()
    assert row.w == ["sat"] and row.n == 2 and row.k == 2


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
        ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("rational", "ration"), ("digitizer", "digit"), ("radically", "radic"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"),
        ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
        ("allowance", "allow"), ("inference", "infer"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"),
        ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("x1", "x1"),
    ],
)
def test_porter(word, want):
    assert stem.porter(word) == want


PAGE = """<html><head><title>Alpha one</title><style>p{}</style><script>var t="</p>";</script><meta name="description" content=" about "></head>
<body><h1>Alpha two</h1><p>first <b>bold <a href="/x">link</a><p>second &amp; last<h2>sub alpha</h2><code>alpha()</code><a href="#top">t</a></body></html>"""


def test_html():
    x = html.extract(PAGE)
    assert x["title"] == "Alpha one" and x["description"] == "about" and x["first_paragraph"] == "first bold link"
    assert [(e["tag"], e["text"]) for e in x["elements"]] == [("title", "Alpha one"), ("h1", "Alpha two"), ("p", "first bold link"), ("p", "second & last"), ("h2", "sub alpha")]
    assert x["hrefs"] == ["/x", "#top"] and x["code"] == "alpha()"
    assert "</p>" not in x["text"] and "p{}" not in x["text"] and x["text"].startswith("Alpha one")
    assert html.extract(None)["text"] == "" and html.extract("<p")["elements"] == []


def test_references_need_their_semicolon():
    x = html.extract('<title>a &amp;&amp; b&amp</title><p>&am &copy &ampx; &lt;&#38;&#x26; \ufdd0</p><code>1 &lt 2</code><a href="/x?a=1&copy=2&amp;b=3">l</a>')
    assert x["title"] == "a && b&amp" and x["elements"][1]["text"] == "&am &copy &ampx; <&& \ufdd0"
    assert html.hrefs('<a href="/a?b&amp"><noscript><a HREF=c></noscript>') == ["/a?b&amp", "c"] and html.hrefs(None) == []
    assert x["code"] == "1 &lt 2" and x["hrefs"] == ["/x?a=1&copy=2&b=3"] and "b&amp" in x["text"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://Example.com/a/", "https://example.com/a"),
        ("http://example.com:8080/a", "http://example.com/a"),
        ("http://example.com/a?b=2&a=1#x", "http://example.com/a?a=1&b=2"),
        ("http://example.com/a/b/../c", "http://example.com/a/c"),
        ("http://example.com/a/./b//c", "http://example.com/a/b/c"),
        ("http://example.com/A/../c", "http://example.com/A/../c"),
        ("http://example.com/a?q=a b", "http://example.com/a?q=a+b"),
        ("nonsense", "nonsense"),
        (None, None),
    ],
)
def test_normalize_url(raw, want):
    assert url.normalize(raw) == want


def test_url_columns(spark):
    df = spark.createDataFrame([("https://www.a.com/x/y", "/a/b/c", "/a/q/c/"), ("http://b.org", "", "/a"), (None, "/a?x=1", "/a")], "u string, p string, q string")
    got = df.select(url.domain(F.col("u")).alias("d"), F.round(url.path_similarity(F.col("p"), F.col("q")), 4).alias("s"), url.short_url(F.concat("u", F.repeat(F.lit("x"), 300))).alias("l")).collect()
    assert [r.d for r in got] == ["a.com", "b.org", ""] and [r.s for r in got] == [0.75, 0.0, 1.0]
    assert len(got[0].l) == 248 and got[0].l[185:188] == "___"
    for a, b in (("/a/b/c", "/a/q/c/"), ("/a?x=1", "/a"), ("", "/a")):
        assert diversity.path_alike(a, b) == pytest.approx({"/a/b/c": 0.75, "/a?x=1": 1.0, "": 0.0}[a])


def test_snippets():
    body = "Short. This sentence is about green apples and more. Another sentence talks of apples green and red. End"
    assert snippets.term_snippet(body, ["green", "apples"]) == "This sentence is about <strong>green apples</strong> and more"
    assert snippets.term_snippet(body, ["red"]) == "Another sentence talks of apples green and <strong>red</strong>"
    assert snippets.term_snippet("", ["x"]) == snippets.NOTHING and snippets.term_snippet(". ", ["x"]) in ("", snippets.NOTHING)
    long = "word " * 100 + "needle in hay " + "tail " * 100
    got = snippets.phrase_snippet(long, "needle in")
    assert got.startswith("...word") and "<strong>needle in</strong>" in got and got.endswith("...")
    assert snippets.phrase_snippet("nothing here at all but text of some length", "needle") == "nothing here at all but text of some length"
    assert snippets.description(["short", "p" * 60, "q" * 150, "r" * 99], "body") == "p" * 60 + " " + "q" * 150
    assert snippets.description([], "b" * 400) == "b" * 300 + "..."
    assert "needle" in snippets.context_snippet(long, ["needle"])


def test_tidy(spark):
    rows = [("x data:image/png;base64,AAA y var a = 1; z {--c: d} " + "w" * 300,), ("a. " * 60 + "b" * 200,), ("short   text ",)]
    got = spark.createDataFrame(rows, "t string").select(text.tidy_description(F.col("t")).alias("d"), text.tidy_snippet(F.col("t")).alias("s")).collect()
    assert got[0].d.startswith("x y z w") and got[0].d.endswith("...") and got[2].d == "short text" and got[2].s == "short text"
    assert got[1].s == ("a. " * 60).strip()


def test_batches_to_python_are_small(spark):
    """Also outside the corpus operators: rows are whole texts and pages, so a batch must not be 10,000 of them."""
    from textloom.shipping import ship
    from textloom.sources.tables import html_documents, html_links

    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old["spark.sql.execution.arrow.maxRecordsPerBatch"])
    pages = spark.createDataFrame([(i, f"http://h/{i}", PAGE) for i in range(20)], "page_id long, url string, html string")
    assert sorted(html_links(pages).collect()) == sorted(html_documents(pages).select("doc_id", "url", "hrefs").collect())
