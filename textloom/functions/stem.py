"""Porter's stemmer (1980), from the published algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Each letter as c or v; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings: dict[str, str] | tuple[str, ...]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past forms
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and _has_vowel(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and _has_vowel(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            word = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            word = cut + "e"
        else:
            word = cut
    # 1c
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    # 2 and 3: double suffixes
    for table in (_STEP2, _STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    # 4: what is left of suffixes
    end = _longest(word, _STEP4)
    if end:
        stem = word[: -len(end)]
        if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
            word = stem
    # 5: a final e, a double l
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(1_000_000)
def remembered(word: str) -> str:
    return porter(word)


def stem_terms(tokens: DataFrame, column: str = "term") -> DataFrame:
    """Replace a term by its stem, where the rows are: no exchange, so no task that the commonest word fills.

    A worker stems each distinct term of a batch once and remembers the last million.
    """
    ship(tokens.sparkSession)

    @F.pandas_udf(T.StringType())
    def stem(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        return pd.Series(np.array([*map(remembered, distinct), None], object)[codes])

    return tokens.withColumn(column, stem(column))


def stem_lists(rows: DataFrame, column: str) -> DataFrame:
    """Replace the words of an array column by their stems, each distinct word of a batch once."""
    ship(rows.sparkSession)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stem(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        words = lists.flatten().cast(pa.string()).dictionary_encode()
        stems = pa.array([remembered(w) for w in words.dictionary.to_pylist()], pa.string())
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return pa.ListArray.from_arrays(offsets, stems.take(words.indices))

    return rows.withColumn(column, stem(column))
