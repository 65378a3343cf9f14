"""Porter's suffix stripping, over a vocabulary.

A word is a string of letters and a mask of their classes (C or V; ``y`` is a consonant at the start and behind a vowel). The mask of a prefix is the prefix of the
mask, so every condition on a stem is read off the word's own mask. Rules are tables; of each table the first suffix that fits decides, whether or not its condition holds.

It runs in Arrow batches over distinct words: as expressions the rules exceed what the JVM compiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes and replacements of steps 2 and 3, suffixes of step 4.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


def mask(word: str) -> str:
    """The class of each letter."""
    out = ""
    for letter in word:
        out += "V" if letter in "aeiou" or letter == "y" and out[-1:] == "C" else "C"
    return out


def measure(classes: str) -> int:
    """How often a vowel is followed by a consonant."""
    return classes.count("VC")


def _short(word: str, classes: str) -> bool:
    """Whether a word ends in consonant, vowel and a consonant other than w, x, y."""
    return classes.endswith("CVC") and word[-1] not in "wxy"


def _swapped(word: str, rules: list[tuple[str, str]], least: int) -> str:
    """The first rule whose suffix fits, if the measure of what stands before it is above ``least``."""
    for suffix, by in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "ion" and not stem.endswith(("s", "t")):
                return word
            return stem + by if measure(mask(word)[: len(stem)]) > least else word
    return word


def _participle(word: str) -> str:
    """Step 1b: -eed, -ed, -ing, and the repair of what is left."""
    classes = mask(word)
    if word.endswith("eed"):
        return word[:-1] if measure(classes[:-3]) > 0 else word
    n = 2 if word.endswith("ed") else 3 if word.endswith("ing") else 0
    if not n or "V" not in classes[:-n]:
        return word
    stem, classes = word[:-n], classes[:-n]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and classes.endswith("C") and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if measure(classes) == 1 and _short(stem, classes) else stem


def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters or with other signs than a to z stay as they are."""
    if len(word) < 3 or not _LETTERS.issuperset(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _participle(word)
    if word.endswith("y") and "V" in mask(word)[:-1]:
        word = word[:-1] + "i"
    word = _swapped(word, STEP_2, 0)
    word = _swapped(word, STEP_3, 0)
    word = _swapped(word, [(suffix, "") for suffix in STEP_4], 1)
    classes = mask(word)
    if word.endswith("e") and (measure(classes[:-1]) > 1 or measure(classes[:-1]) == 1 and not _short(word[:-1], classes[:-1])):
        word, classes = word[:-1], classes[:-1]
    return word[:-1] if word.endswith("ll") and measure(classes) > 1 else word


def _stemming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else stem_word(w) for w in words], pa.string())], ["word", "stem"])


def stemmed(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, stem) of distinct lower-case words."""
    return words.select(F.col(column).alias("word")).distinct().mapInArrow(_stemming, "word string, stem string")


def token_parts(token: Column) -> Column:
    """The parts of a token between its joining signs, which stay: letters and other runs in turn."""
    return F.regexp_extract_all(token, F.lit("[^/'’‐‑‒–—-]+|[/'’‐‑‒–—-]+"), F.lit(0))
