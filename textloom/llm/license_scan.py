"""Licence scan: text compared with licence templates by Dice over word bigrams.

Text is normalised (letters folded, everything but letters and digits to
spaces).  A template with m distinct bigrams can only reach the threshold t in
a passage with between ``t/(2-t) * m`` and ``(2-t)/t * m`` of them, of which at
least ``t/(2-t) * m`` must be the template's own; these bounds prune templates
before any passage is compared.  A passage begins and ends at bigrams of the
template and has, repeats counted, no more bigrams than the whole template's
upper bound, so the work is the number of matches times the length of a template,
however often a text repeats it.  Templates of one family match one another's
texts; of passages that overlap the one with more of its own template's bigrams
stands, so an AGPL header is that and not a GPL header with a word too many.
"""

from __future__ import annotations

import importlib.resources
import math
from bisect import bisect
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Block, blocks, window_hash
from .runtime import arrow, map_arrow

# Notices and headers of public licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}
THRESHOLD = 0.85

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    return text.translate(_NORMAL)


@cache
def templates() -> dict[str, str]:
    """The notices and headers above, and the whole texts of the folder ``licences``, named by their files."""
    whole = importlib.resources.files(__package__).joinpath("licences")
    return TEMPLATES | {f"{x.name.removesuffix('.txt')} text": x.read_text("utf-8") for x in sorted(whole.iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")}


def _bigrams(text: bytes) -> np.ndarray:
    return window_hash(Block([normal(text)]).word_hash(), 2)


class Template:
    """Bigrams of a licence and the sizes that a passage like it can have."""

    def __init__(self, text: str, threshold: float):
        grams = _bigrams(text.encode())
        self.grams = np.unique(grams)
        self.m, self.threshold = len(self.grams), threshold
        self.least = max(1, math.ceil(threshold / (2 - threshold) * self.m - 1e-9))
        self.most = math.floor((2 - threshold) / threshold * self.m + 1e-9)
        self.reach = max(self.most, math.floor((2 - threshold) / threshold * len(grams) + 1e-9))


CELLS = 1 << 19  # starts times reach that are compared at a time


def previous(grams: np.ndarray) -> np.ndarray:
    """Where each bigram stood last before, or -1."""
    by = np.argsort(grams, kind="stable")
    out = np.full(len(grams), -1, np.int64)
    same = np.flatnonzero(grams[by][1:] == grams[by][:-1]) + 1
    out[by[same]] = by[same - 1]
    return out


def passages(before: np.ndarray, hits: np.ndarray, t: Template) -> list[tuple[float, int, int, int]]:
    """Best disjoint passages as (dice, first bigram, last bigram, own bigrams); ties: the earlier, then the shorter.

    ``before``: where each bigram of the text stood last; ``hits``: places of the template's.
    """
    begins = hits[np.searchsorted(hits, hits + t.reach) - np.arange(len(hits)) >= t.least]
    if not len(begins):
        return []
    inside = np.zeros(len(before) + t.reach, bool)
    inside[hits] = True
    last = np.full(len(before) + t.reach, len(before) + t.reach)
    last[: len(before)] = before
    own_in, last_in = sliding_window_view(inside, t.reach), sliding_window_view(last, t.reach)
    found: list[tuple[float, int, int, int]] = []
    step, at = max(1, min(CELLS // t.reach, max(64, t.reach // 2))), 0  # few starts at a time, as those inside a whole copy are passed over
    while at < len(begins):
        b = begins[at : at + step]
        fresh = last_in[b] < b[:, None]
        every = np.cumsum(fresh, axis=1, dtype=np.int32)
        own = np.cumsum(fresh & own_in[b], axis=1, dtype=np.int32)
        dice = np.where(own_in[b] & (every >= t.least) & (every <= t.most), 2 * own / (t.m + every), 0.0)
        end = dice.argmax(axis=1)
        rows = np.arange(len(b))
        best = dice[rows, end]
        good = np.flatnonzero(best >= t.threshold)
        at += len(b)
        whole = np.flatnonzero(best[good] == 1)
        if len(whole):  # nothing is better, so what begins inside it is beaten
            good = good[: whole[0] + 1]
            at = int(np.searchsorted(begins, b[good[-1]] + end[good[-1]], "right"))
        found += [(float(best[i]), int(b[i]), int(b[i] + end[i]), int(own[i, end[i]])) for i in good.tolist()]
    return disjoint(sorted(found, key=lambda x: (-x[0], x[1], x[2])), lambda x: (x[1], x[2]))


def disjoint(ranked: list, span) -> list:  # noqa: ANN001
    """Of ranked entries those whose spans (first, last) meet none of a better one, in order of place."""
    begins: list[int] = []
    kept: list = []
    for x in ranked:
        a, z = span(x)
        i = bisect(begins, a)
        if (i == 0 or span(kept[i - 1])[1] < a) and (i == len(kept) or span(kept[i])[0] > z):
            begins.insert(i, a)
            kept.insert(i, x)
    return kept


def scan(docs: DataFrame, texts: Mapping[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: id, licence, dice, first_word, n_words.

    ``texts``: templates by name, ``templates()`` by default.  Passages of one text
    are disjoint; of those that overlap the one with most bigrams of its template
    stands, of equals the higher Dice, then the earlier, then the first name.
    Places count normalised words.  Null or empty texts and texts of one word give
    no rows; null ids are kept; repeated rows give their rows again; other columns
    are ignored; a text of any length is scanned whole; an empty table gives no rows.
    """
    texts = templates() if texts is None else texts
    names = list(texts)
    forms = [Template(t, threshold) for t in texts.values()]
    keys = np.unique(np.concatenate([t.grams for t in forms]))
    member = [np.isin(keys, t.grams) for t in forms]
    ddl = f"{id_col} long, licence string, dice double, first_word long, n_words long"

    def of_text(grams: np.ndarray, hits: np.ndarray, key: np.ndarray) -> list[tuple[str, float, int, int]]:
        """``hits``: places of bigrams that some template has; ``key``: which."""
        before = None
        ranked = []
        present = np.unique(key)
        for name, t, inside in zip(names, forms, member, strict=True):
            if inside[present].sum() >= t.least:
                before = previous(grams) if before is None else before
                ranked += [(-own, -dice, a, name, z) for dice, a, z, own in passages(before, hits[inside[key]], t)]
        return [(x[3], -x[1], x[2], x[4] - x[2] + 2) for x in disjoint(sorted(ranked), lambda x: (x[2], x[4]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(ddl)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = []
            for part, block in blocks(batch, "text", change=normal):
                grams, _, doc = block.windows(block.word_hash(), 2)
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == grams)
                bounds = np.searchsorted(doc, np.arange(len(block.texts) + 1))
                cuts = np.searchsorted(hit, bounds)
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    mine, lo = hit[cuts[d] : cuts[d + 1]], bounds[d]
                    rows += [(ids[part.start + d], *x) for x in of_text(grams[lo : bounds[d + 1]], mine - lo, at[mine])]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, ddl)
