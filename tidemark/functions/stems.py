"""English stems by Porter's published algorithm (1980): suffixes go in five steps, each on conditions of what stands before them."""

from __future__ import annotations

from collections.abc import Callable

#: Steps 2 to 4 (fixed values of the publication): suffixes and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def kinds(word: str) -> str:
    """``c`` or ``v`` for each letter; a y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[k - 1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    k = kinds(stem)
    return sum(a == "v" and b == "c" for a, b in zip(k, k[1:], strict=False))


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes: dict[str, str], when: Callable[[str, str], bool]) -> str:
    """Only the longest suffix that fits is looked at."""
    for size in range(min(7, len(word)), 0, -1):
        end = word[-size:]
        if end in suffixes:
            stem = word[:-size]
            return stem + suffixes[end] if when(stem, end) else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and what is not in a to z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in kinds(word[: -len(e)])), "")
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and short_end(word)):
                word += "e"
            elif doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, STEP_2, lambda s, _: measure(s) > 0)
    word = _longest(word, STEP_3, lambda s, _: measure(s) > 0)
    word = _longest(word, dict.fromkeys(STEP_4, ""), lambda s, e: measure(s) > 1 and (e != "ion" or s.endswith(("s", "t"))))
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if measure(word) > 1 and word.endswith("ll") else word
