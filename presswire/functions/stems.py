"""Stems of words by suffix rules: Porter's for English, light ones (endings of number, gender and case) for German, Spanish, French and Russian.

They are for terms of an index: a stem need not be a word, and words of one root should share it.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "[aeiou]|(?<=[^aeiou])y"
_MEASURE = re.compile(rf"(?:{_VOWEL})+(?:(?!{_VOWEL}).)+")
_HAS_VOWEL = re.compile(_VOWEL)
_SHORT = re.compile(rf"(?:^|.*?)(?!{_VOWEL})(?:.)(?:{_VOWEL})(?!{_VOWEL})[^wxy]$")

#: Porter's suffixes and what they become, where what stands before them has the measure.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Endings of Russian nouns and adjectives.
_RU = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "его", "ого", "ему", "ому", "ыми", "ими", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "ая", "яя", "ое", "ее", "ые", "ую", "юю", "ый", "ым", "им", "ых", "их", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")


def _measure(stem: str) -> int:
    return len(_MEASURE.findall(stem))


def _closed(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return bool(_SHORT.match(stem))


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted((s for s in rules if word.endswith(s)), key=len, reverse=True):
        stem = word[: -len(suffix)]
        return stem + rules[suffix] if _measure(stem) >= least else word
    return word


def english(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = re.sub("(?<=ss)es$|(?<=i)es$|(?<=[^s])s$", "", word)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif (cut := re.sub("(ed|ing)$", "", word)) != word and _HAS_VOWEL.search(cut):
        if re.search("(at|bl|iz)$", cut):
            cut += "e"
        elif re.search(r"([^aeioulsz])\1$", cut):
            cut = cut[:-1]
        elif _measure(cut) == 1 and _closed(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2, 1), _STEP3, 1)
    for suffix in sorted((s for s in _STEP4 if word.endswith(s)), key=len, reverse=True):
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
            word = stem
        break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _closed(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def german(word: str) -> str:
    word = word.translate(str.maketrans("äöüàáâèéêìíîòóôùúû", "aouaaaeeeiiiooouuu"))
    for least, pattern in ((6, "ern$"), (5, "(em|en|er|es)$"), (4, "e$|(?<=[bdfghklmnt])s$")):
        if len(word) >= least and re.search(pattern, word):
            word = re.sub(pattern, "", word)
            break
    for least, pattern in ((6, "est$"), (5, "(er|en)$|(?<=[bdfghklmnt])st$")):
        if len(word) >= least and re.search(pattern, word):
            return re.sub(pattern, "", word)
    return word


def spanish(word: str) -> str:
    if len(word) < 4:
        return word
    word = word.translate(str.maketrans("áàâéèêíìîóòôúùûü", "aaaeeeiiiooouuuu"))
    for pattern, put in (("eses$", "es"), ("ces$", "z"), ("[oae]s$", ""), ("[oae]$", "")):
        if re.search(pattern, word):
            return re.sub(pattern, put, word)
    return word


def french(word: str) -> str:
    if len(word) < 6:
        return word
    if word.endswith("x"):
        return word[:-2] + "l" if word.endswith("aux") else word[:-1]
    for letter in "sreé":
        word = word.removesuffix(letter)
    return word[:-1] if word[-1] == word[-2] else word


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    for ending in _RU:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


STEMMERS = {"de": german, "en": english, "es": spanish, "fr": french, "ru": russian}


@lru_cache(1 << 17)
def stem(language: str, word: str) -> str:
    """The stem of a word in lower case; in other languages the word itself."""
    return STEMMERS[language](word) if language in STEMMERS else word
