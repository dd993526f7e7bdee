"""English stems by the rules of the Porter2 stemmer (snowballstem.org/algorithms/english), for words that are already in lower case.

The rules run once for each distinct word of a corpus; the result is joined back.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published algorithm's word lists and suffixes.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGIONS = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_SHORT_END = re.compile(f"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$")


def _ends(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _has_vowel(part: str) -> bool:
    return any(c in _V for c in part)


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first vowel with a consonant behind it, and the same again from there."""
    begin = next((len(x) for x in _REGIONS if word.startswith(x)), None)
    if begin is None:
        begin = m.end() if (m := _REGION.search(word)) else len(word)
    return begin, m.end() if (m := _REGION.search(word, begin)) else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").removeprefix("'")
    if word in _WHOLE:
        return _WHOLE[word]
    word = re.sub(f"^y|(?<=[{_V}])y", "Y", word)
    r1, r2 = _regions(word)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    if end := _ends(word, ("eed", "eedly")):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := _ends(word, ("ed", "edly", "ing", "ingly"))) and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif _SHORT_END.search(word) and r1 >= len(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # 2
    if end := _ends(word, (*_STEP2, "ogi", "li")):
        stays = word[: -len(end)]
        if len(stays) >= r1:
            if end in _STEP2:
                word = stays + _STEP2[end]
            elif end == "ogi":
                word = stays + "og" if stays.endswith("l") else word
            elif stays[-1:] and stays[-1] in "cdeghkmnrt":
                word = stays
    # 3
    if end := _ends(word, (*_STEP3, "ative")):
        stays = word[: -len(end)]
        if len(stays) >= r1 and end in _STEP3:
            word = stays + _STEP3[end]
        elif end == "ative" and len(stays) >= r2:
            word = stays
    # 4
    if end := _ends(word, (*_STEP4, "ion")):
        stays = word[: -len(end)]
        if len(stays) >= r2 and (end != "ion" or stays.endswith(("s", "t"))):
            word = stays
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_table(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, term): the stem of each distinct word; null words are left out."""
    return words.select(F.col(column).alias("word")).where("word is not null").distinct().withColumn("term", stem_words("word"))
