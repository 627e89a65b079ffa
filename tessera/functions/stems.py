"""Word stems by the published Snowball algorithms for English (Porter 2) and Russian.

The suffix lists below are fixed values of the algorithms.
"""

from __future__ import annotations

import re
from functools import lru_cache

_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_LATE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"),
    ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    """After the first consonant that follows a vowel, from start on."""
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


@lru_cache(maxsize=100_000)
def english(word: str) -> str:
    if word in _SPECIAL:
        return _SPECIAL[word]
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    head = re.match(r"(gener|commun|arsen)", word)
    r1 = head.end() if head else _region(word, 0)
    r2 = _region(word, r1)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif re.search(r"(ied|ies)$", word):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not re.search(r"(us|ss)$", word) and re.search(r"[aeiouy].+s$", word):
        word = word[:-1]
    if word in _LATE:
        return word
    if m := re.search(r"(eedly|eed)$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", word)) and re.search(r"[aeiouy]", word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLE):
            word = word[:-1]
        elif r1 >= len(word) and _short(word):
            word += "e"
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)
    for a, b in _STEP2:
        if word.endswith(a):
            at = len(word) - len(a)
            if at >= r1 and (a != "ogi" or word[at - 1 : at] == "l") and (a != "li" or word[at - 1 : at] in tuple(_LI)):
                word = word[:at] + b
            break
    for a, b in _STEP3:
        if word.endswith(a):
            at = len(word) - len(a)
            if at >= r1 and (a != "ative" or at >= r2):
                word = word[:at] + b
            break
    for a in _STEP4:
        if word.endswith(a):
            at = len(word) - len(a)
            if at >= r2 and (a != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# Fixed values of the Russian algorithm: endings, longest first within each pattern by alternation.
_GERUND = re.compile(r"(?:(?<=[ая])(?:вшись|вши|в)|(?:ившись|ывшись|ивши|ывши|ив|ыв))$")
_REFLEXIVE = re.compile(r"(?:ся|сь)$")
_ADJECTIVE = r"(?:ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею)"
_PARTICIPLE = re.compile(rf"(?:(?:ивш|ывш|ующ)|(?<=[ая])(?:ем|нн|вш|ющ|щ))?{_ADJECTIVE}$")
_VERB = re.compile(
    r"(?:(?:уйте|ейте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ует|ят|ей|уй|ил|ыл|им|ым|ен|ит|ыт|ую|ю)|(?<=[ая])(?:ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н))$"
)
_NOUN = re.compile(r"(?:иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я)$")
_DERIVED = re.compile(r"(?:ость|ост)$")
_SUPERLATIVE = re.compile(r"(?:ейше|ейш)$")
_RU_VOWEL = "аеиоуыэюя"


@lru_cache(maxsize=100_000)
def russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = re.search(rf"[{_RU_VOWEL}]", word)
    if not m:
        return word
    rv = m.end()
    r1 = re.compile(rf"[{_RU_VOWEL}][^{_RU_VOWEL}]").search(word)
    r2 = re.compile(rf"[{_RU_VOWEL}][^{_RU_VOWEL}]").search(word, r1.end()) if r1 else None
    head, tail = word[:rv], word[rv:]
    cut = _longest(_GERUND, tail)
    if cut is not None:
        tail = cut
    else:
        tail = tail[: x.start()] if (x := _REFLEXIVE.search(tail)) else tail
        for pattern in (_PARTICIPLE, _VERB, _NOUN):
            if (cut := _longest(pattern, tail)) is not None:
                tail = cut
                break
    tail = tail[:-1] if tail.endswith("и") else tail
    word = head + tail
    if r2 and (x := _DERIVED.search(word)) and x.start() >= r2.end():
        word = word[: x.start()]
    if x := _SUPERLATIVE.search(word[rv:]):
        word = head + word[rv:][: x.start()]
    if word[rv - 1 :].endswith("нн") or word.endswith("нн"):
        return word[:-1]
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def _longest(pattern: re.Pattern, tail: str) -> str | None:
    x = pattern.search(tail)
    return tail[: x.start()] if x else None


def stem(word: str, lang: str) -> str:
    return russian(word) if lang.strip().lower() == "ru" else english(word)
