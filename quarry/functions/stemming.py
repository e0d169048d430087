"""Porter's stemming algorithm and folding of accents, for the distinct words of an index."""

from __future__ import annotations

import itertools
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published suffix rules of steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y after a consonant is a vowel."""
    shape = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return len(word) > 2 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _step1(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = _longest(word, ("ed", "ing"))
        if end and "v" in _shape(word[: -len(end)]):
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return word


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    word = _step1(word)
    for rules in (STEP2, STEP3):
        end = _longest(word, rules)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = _longest(word, STEP4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


@lru_cache(1 << 16)
def _one(word: str | None) -> str | None:
    plain = fold(word) if word is not None else None
    return porter(plain) if plain and plain.isascii() else plain


#: About so many words are counted side by side.
WORDS_AT_ONCE = 1 << 18


def _counted(rows: pa.Array, stem: bool) -> pa.Array:
    words = rows.flatten().dictionary_encode()
    forms, place = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    if stem:
        stems = pa.array(map(_one, forms.to_pylist()), pa.string()).dictionary_encode()
        forms, place = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False)[place]
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    found, times = np.unique(owner * max(1, len(forms)) + place, return_counts=True)
    owner, place = np.divmod(found, max(1, len(forms)))
    pairs = pa.StructArray.from_arrays([forms.take(pa.array(place)), pa.array(times, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(rows) + 1)), pa.int32()), pairs)


def term_counts(terms: Column | str, stem: bool = False) -> Column:
    """The distinct terms of each row's array with their occurrences (tf); with stem, of the terms' folded stems."""

    def run(rows: pa.Array) -> pa.Array:
        groups = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // WORDS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(rows)]
        return pa.concat_arrays([_counted(rows.slice(a, b - a), stem) for a, b in itertools.pairwise(edges)])

    return F.arrow_udf(run, "array<struct<term:string,tf:long>>")(terms)


def fold_and_stem(word: Column | str) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map(_one)

    return F.pandas_udf(run, "string")(word)
