"""Whole-text statistics of documents, computed block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import _SPACE, Block, blocks, mix
from .runtime import arrow, map_arrow, trim

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars_all", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct_words", "n_same_next", "n_stops", "longest_word", "n_capital_words", "n_bang")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of the keys, and which places in it belong to a key found twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    return order, same


def block_stats(b: Block, window: int = 5) -> dict[str, np.ndarray]:
    """Each statistic as one long per document of the block."""
    n = len(b.texts)
    buf = b.buf
    start_char = ~_CONT[buf]
    upper = (buf >= 65) & (buf <= 90)
    out = {
        "n_words": b.n_words.astype(np.int64),
        "word_chars": _per_doc(start_char & ~_SPACE[buf], b.at),
        "n_symbols": _per_doc(_SYMBOL[buf], b.at),
        "n_chars_all": _per_doc(start_char, b.at) - 1,
        "n_upper": _per_doc(upper, b.at),
        "n_digits": _per_doc((buf >= 48) & (buf <= 57), b.at),
        "n_punct": _per_doc(_PUNCT[buf], b.at),
        "n_bang": _per_doc(buf == 33, b.at),
        "n_stops": _per_doc(buf == 46, b.at),
    }
    # lines: the text between newlines, as split("\n") gives them
    breaks = np.flatnonzero(buf == 10)
    line_end = breaks
    line_start = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64)
    line_doc = np.searchsorted(b.at, line_start, "right") - 1
    worded = np.searchsorted(b.start, line_end) > np.searchsorted(b.start, line_start)
    out["n_lines"] = np.bincount(line_doc[worded], minlength=n).astype(np.int64)
    ls, le, ld = line_start[worded], line_end[worded], line_doc[worded]
    keys = mix(b.span_hash(ls, le) + mix(ld.astype(np.uint64)))
    order, same = _repeats(keys)
    out["n_dup_lines"] = np.bincount(ld[order][same[:-1]], minlength=n).astype(np.int64)
    # words in windows that the text holds twice or more, first ones included
    words = b.word_hash()
    grams, begin, doc = b.windows(words, window)
    order, same = _repeats(mix(grams + mix(doc.astype(np.uint64))))
    twice = begin[order][same[:-1] | same[1:]]
    cover = np.zeros(len(words) + window + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    covered = np.cumsum(cover)[: len(words)] > 0
    out["n_repeat_words"] = _per_doc(covered, b.first)
    owner = b.doc_of_word()
    order, same = _repeats(mix(words + mix(owner.astype(np.uint64))))
    out["n_distinct_words"] = out["n_words"] - np.bincount(owner[order][same[:-1]], minlength=n)
    nxt = np.zeros(len(words), bool)
    nxt[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out["n_same_next"] = _per_doc(nxt, b.first)
    out["n_capital_words"] = _per_doc(upper[b.start], b.first)
    long = np.zeros(n, np.int64)
    if len(words):
        full = b.n_words > 0
        long[full] = np.maximum.reduceat(b.end - b.start, b.first[:-1][full])
    out["longest_word"] = long
    return {k: v.astype(np.int64) for k, v in out.items()}


def document_stats(docs: DataFrame, columns: tuple[str, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and one long per statistic, for every row; a null text counts as empty."""
    ddl = f"{id_col} long, " + ", ".join(f"{c} long" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow(ddl)
        for batch in batches:
            for part, block in blocks(batch, "text"):
                got = block_stats(block)
                ids = batch.column("id").slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[c]) for c in columns)], schema=schema)

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, ddl)


def stats_struct(text: Column, columns: tuple[str, ...] = BASE + MORE) -> Column:
    """The statistics as one struct column beside all others; no name can clash."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in columns) + ">")
    def run(texts: pa.Array) -> pa.Array:
        trim()
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        got = [block_stats(block) for _, block in blocks(batch)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([g[c] for g in got]) if got else np.zeros(0, np.int64)) for c in columns], names=list(columns))

    return run(text.cast("string"))
