"""Porter's suffix stripping, as published in 1980, on lower-case words."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidepool.functions.text import column

#: Words that are told apart together, and stems that a Python worker keeps.
WORDS, KEPT = 1 << 20, 1 << 15
# The suffixes of steps 2, 3 and 4.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _ends_cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a word; words of up to two letters, or over 64, stay."""
    if not 2 < len(word) <= 64:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                if "v" in _shape(word[: -len(suffix)]):
                    word = word[: -len(suffix)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word[-1:] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _ends_cvc(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP2, 0)
    word = _replace(word, STEP3, 0)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _ends_cvc(word[:-1]):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _each_word(lists: pa.ListArray, change: Callable[[str], str]) -> pa.ListArray:
    """Lists of words with each changed: every different word of up to ``WORDS`` is changed once, and no word of a list becomes a Python object."""
    lists = pa.concat_arrays([lists.cast(pa.list_(pa.string()))])
    words, parts = lists.flatten(), []
    for low in range(0, len(words), WORDS):
        coded = words[low : low + WORDS].dictionary_encode()
        fresh = pa.array([None if w is None else change(w) for w in coded.dictionary.to_pylist()], pa.string())
        parts.append(fresh.take(coded.indices))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts) if parts else pa.array([], pa.string()), mask=lists.is_null())


def stemmed(tokens: str | Column) -> Column:
    """The stems of an array of terms; there is no built-in stemmer, so batches go through Python, one Arrow column at a time."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(lists: pa.Array) -> pa.Array:
        return _each_word(lists, stem)

    return run(column(tokens))


@functools.lru_cache(maxsize=10_000)
def _plain(letter: str) -> str:
    parts = unicodedata.normalize("NFD", letter)
    return parts[0] if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) else letter


def folded(word: str) -> str:
    """A lower-case word with Latin letters without their diacritic; letters with several stay, as in SQLite's unicode61."""
    return word if word.isascii() else "".join(map(_plain, word))


@functools.lru_cache(maxsize=KEPT)
def normal(word: str) -> str:
    """A term as the tokenizer 'porter unicode61' files it."""
    return stem(folded(word))


def normal_terms(tokens: str | Column) -> Column:
    """``normal`` of each of an array of terms."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(lists: pa.Array) -> pa.Array:
        return _each_word(lists, normal)

    return run(column(tokens))
