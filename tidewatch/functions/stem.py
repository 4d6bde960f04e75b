"""The English (Porter2) stemmer, written from its published rules.

"R1" is what follows the first consonant after a vowel; "R2" is R1 within R1.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The algorithm's own tables.
EXCEPTIONS = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = "ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al aliti:al ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble ogi:og li:".split()
STEP_3 = "ational:ate tional:tion alize:al icate:ic iciti:ic ative: ical:ic ness: ful:".split()
STEP_4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = re.compile("[aeiouy]")


def _region(word: str, start: int) -> int:
    found = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return found.end() if found else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = w.lstrip("'") if w.startswith("'") else w
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)
    # step 0 and 1a
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # step 1b
    if end := re.search("(eedly|eed)$", w):
        if end.start() >= r1:
            w = w[: end.start()] + "ee"
    elif (end := re.search("(ingly|edly|ing|ed)$", w)) and _VOWEL.search(w[: end.start()]):
        w = w[: end.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # step 2
    for suffix, to in (x.split(":") for x in STEP_2):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    # step 3
    for suffix, to in (x.split(":") for x in STEP_3):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + to
            break
    # step 4
    for suffix in STEP_4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # step 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(words: Column) -> Column:
    """Stems of an array of words, in order."""

    @F.pandas_udf("array<string>")
    def run(arrays: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return arrays.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, stem(w)) for w in ws])

    return run(words)
