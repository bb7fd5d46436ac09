import math
import random
import re
import time

import numpy as np

from textloom.llm import license_scan as ls
from textloom.llm import queries

from .samples import no_documents, odd_documents


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates, threshold):
    """Every passage of every template, the best ones taken first, in plain Python; as (licence, dice, first word, words)."""
    w = words(text)
    grams = list(zip(w, w[1:]))
    every = []
    for name, template in templates.items():
        t = list(zip(words(template), words(template)[1:]))
        own, m = set(t), len(set(t))
        least, most = math.ceil(threshold / (2 - threshold) * m - 1e-9), math.floor((2 - threshold) / threshold * m + 1e-9)
        reach = max(most, math.floor((2 - threshold) / threshold * len(t) + 1e-9))
        mine = []
        for a, g in enumerate(grams):
            if g not in own:
                continue
            seen, hit, best = set(), 0, (0.0, 0, 0)
            for z in range(a, min(len(grams), a + reach)):
                hit += grams[z] in own and grams[z] not in seen
                seen.add(grams[z])
                if grams[z] in own and least <= len(seen) <= most:
                    best = max(best, (2 * hit / (m + len(seen)), -z, hit))
            if best[0] >= threshold:
                mine.append((best[0], a, -best[1], best[2]))
        kept = []
        for x in sorted(mine, key=lambda x: (-x[0], x[1], x[2])):
            if all(x[2] < y[1] or x[1] > y[2] for y in kept):
                kept.append(x)
        every += [(-own_, -dice, a, name, z) for dice, a, z, own_ in kept]
    kept = []
    for x in sorted(every):
        if all(x[4] < y[2] or x[2] > y[4] for y in kept):
            kept.append(x)
    return {(x[3], round(-x[1], 12), x[2], x[4] - x[2] + 2) for x in kept}


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add((r.licence, round(r.dice, 12), r.first_word, r.n_words))
    return out


def test_query_against_brute_force(spark, sf_dir):
    """All templates, whole texts, every passage."""
    got = found(queries.op2_license_scan(spark, sf_dir).collect())
    n = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = brute(r.text, ls.TEMPLATES, ls.THRESHOLD)  # a whole licence is longer than any passage here
        assert got.get(r.doc_id, set()) == want
        n += len(want)
    assert n


def test_families_whole_texts_and_edits(spark):
    rng = random.Random(3)
    texts = ls.templates()
    assert len(texts) > 25 and max(map(len, texts.values())) > 30_000
    docs, best = [], {}
    for i, (name, t) in enumerate(texts.items()):
        w = t.split()
        best[3 * i] = name
        docs.append((3 * i, f"some words before. {t} and some after it"))
        if len(w) > 20:
            for _ in range(len(w) // 40):
                w[rng.randrange(len(w))] = "edited"
            docs.append((3 * i + 1, "x y z " + " ".join(w)))
            best[3 * i + 1] = name
    got = found(ls.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    for i, name in best.items():
        assert name in {x[0] for x in got[i]}, name
    small = {k: v for k, v in texts.items() if len(v) < 700}
    pick = [(i, t) for i, t in docs if len(t) < 900]
    got = found(ls.scan(spark.createDataFrame(pick, "doc_id long, text string"), small).collect())
    for i, t in pick:
        assert got.get(i, set()) == brute(t, small, ls.THRESHOLD)


def test_repeated_licences_are_scanned_in_linear_time():
    t = ls.Template(ls.TEMPLATES["MIT text"], ls.THRESHOLD)
    for text, n, limit in ((ls.TEMPLATES["MIT text"] + " ", 10_000, 30), (ls.TEMPLATES["MIT text"].replace("merge", "mend") + " ", 1_000, 30)):
        grams = ls._bigrams((text * n).encode())
        began = time.process_time()
        got = ls.passages(ls.previous(grams), np.flatnonzero(np.isin(grams, t.grams)), t)
        assert time.process_time() - began < limit
        assert n - 1 <= len(got) <= n  # edited ones may begin after the edit, one text on


def test_edited_and_wrapped_header(spark):
    t = ls.TEMPLATES["Apache-2.0 header"]
    wrapped = "# code\n" + re.sub(r"(\S+ \S+ \S+ \S+) ", r"\1\n// ", t).replace("governing", "ruling") + "\nint main() {}"
    df = spark.createDataFrame([(1, wrapped), (2, t[: len(t) // 3]), (3, "x " * 50000 + t), (3, t + " and more words here. " + t), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.licence) for r in ls.scan(df).collect() if r.licence == "Apache-2.0 header")
    assert got == [(-1, "Apache-2.0 header"), (1, "Apache-2.0 header")] + [(3, "Apache-2.0 header")] * 3


def test_odd_inputs(spark):
    assert ls.scan(odd_documents(spark)).count() == 0
    assert ls.scan(no_documents(spark)).count() == 0
