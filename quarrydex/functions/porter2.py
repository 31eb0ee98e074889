"""The English (Porter2) stemmer, written from the published description of the algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
R1_PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_HAS_VOWEL = re.compile(f"[{VOWELS}]")
#: Endings from the longest to the shortest, as each step looks for its longest one.
_ENDINGS_2 = sorted([*STEP_2, "ogi", "li"], key=len, reverse=True)
_ENDINGS_3 = sorted([*STEP_3, "ative"], key=len, reverse=True)
_ENDINGS_4 = sorted([*STEP_4, "ion"], key=len, reverse=True)


def _after_region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    """Ends in a short syllable: a vowel then a consonant other than w, x, Y after a consonant; or the word is just vowel, consonant."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS + "wxY"


def _first(word: str, endings: list[str]) -> str:
    return next((e for e in endings if word.endswith(e)), "")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    # y is a consonant at the start and after a vowel.
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    w = w.removeprefix("'")
    prefix = next((p for p in R1_PREFIXES if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _after_region(w, 0)
    r2 = _after_region(w, r1)

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    # Step 1a: plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # Step 1b: past and progressive forms.
    e = _first(w, ["eedly", "ingly", "edly", "eed", "ing", "ed"])
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and _HAS_VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    # Step 1c: a final y after a consonant that isn't the first letter.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # Step 2.
    e = _first(w, _ENDINGS_2)
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in LI_ENDINGS else w
        else:
            w = w[: -len(e)] + STEP_2[e]
    # Step 3.
    e = _first(w, _ENDINGS_3)
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + STEP_3[e]
    # Step 4.
    e = _first(w, _ENDINGS_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    # Step 5.
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
