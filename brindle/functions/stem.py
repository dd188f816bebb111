"""English stemming by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the algorithm: whole words, words that stay after step 1a, and the suffix tables.
WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        found = _REGION.search(word)
        start = found.end() if found else len(word)
    found = _REGION.search(word, start)
    return start, found.end() if found else len(word)


def _suffix(word: str, table) -> str | None:
    return max((s for s in table if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case token."""
    if len(word) < 3:
        return word
    if word in WORDS:
        return WORDS[word]
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in STAY:
        return word
    ending = _suffix(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and _VOWEL.search(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT.match(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    ending = _suffix(word, STEP2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if not (ending == "ogi" and not before.endswith("l")) and not (ending == "li" and not (before and before[-1] in "cdeghkmnrt")):
            word = before + STEP2[ending]
    ending = _suffix(word, STEP3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP3[ending]
    ending = _suffix(word, STEP4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT.match(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
