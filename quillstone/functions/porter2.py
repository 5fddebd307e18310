"""The Porter2 (English Snowball) stemmer, after its published definition."""

from __future__ import annotations

import re

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")

# Words with a stem of their own.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
# Words left alone after step 1a.
INVARIANTS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: A vowel and what follows it that is none, after which a region begins.
REGION = re.compile("[aeiouy][^aeiouy]")
REGION_PREFIXES = ("gener", "commun", "arsen")

# Suffixes of steps 2, 3 and 4 and what replaces them.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
SUFFIXES_1B, SUFFIXES_2, SUFFIXES_3 = ("eed", "eedly", "ed", "edly", "ing", "ingly"), (*STEP2, "ogi", "li"), (*STEP3, "ative")
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
SUFFIXES_4 = (*STEP4, "ion")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(start: int) -> int:
        found = REGION.search(word, start)
        return found.end() if found else len(word)

    prefix = next((p for p in REGION_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def _mark_consonant_y(word: str) -> str:
    """A y that begins the word or follows a vowel counts as a consonant: Y."""
    if "y" not in word:
        return word
    marked = ""
    for i, c in enumerate(word):
        marked += "Y" if c == "y" and (not i or marked[-1] in VOWELS) else c
    return marked


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS | {"w", "x", "Y"} and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return not VOWELS.isdisjoint(part)


def _longest(word: str, suffixes: tuple[str, ...]) -> str:
    # most words end in none of them
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else ""


def _step1b(word: str, r1: int) -> str:
    suffix = _longest(word, SUFFIXES_1B)
    stem = word[: len(word) - len(suffix)]
    if suffix in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else word
    if not suffix or not _has_vowel(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(DOUBLES):
        return stem[:-1]
    if r1 >= len(stem) and _ends_short(stem):
        return stem + "e"
    return stem


def stem(token: str) -> str:
    """The stem of a token; input is lower-cased, words of one or two letters stay as they are."""
    word = token.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    word = _mark_consonant_y(word)
    r1, r2 = _regions(word)

    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]

    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        word = word[:-2]
    elif suffix in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif suffix == "s" and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in INVARIANTS:
        return word

    word = _step1b(word, r1)

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    suffix = _longest(word, SUFFIXES_2)
    at = len(word) - len(suffix)
    if suffix and at >= r1:
        if suffix == "ogi":
            word = word[:-1] if word[at - 1 : at] == "l" else word
        elif suffix == "li":
            word = word[:at] if word[at - 1 : at] in LI_ENDINGS and at else word
        else:
            word = word[:at] + STEP2[suffix]

    suffix = _longest(word, SUFFIXES_3)
    at = len(word) - len(suffix)
    if suffix and at >= r1:
        if suffix == "ative":
            word = word[:at] if at >= r2 else word
        else:
            word = word[:at] + STEP3[suffix]

    suffix = _longest(word, SUFFIXES_4)
    at = len(word) - len(suffix)
    if suffix and at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
        word = word[:at]

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _ends_short(word[:-1])):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")
