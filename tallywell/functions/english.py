"""English words: stop words, and stems by the public Snowball rules for English ("Porter 2"), word by word."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

# The stop words of English full text search.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)

# Words with a stem of their own, and words that are whole once their s is gone.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
WHOLE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# Endings and what takes their place, by step.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "logi": "log",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

V, C = "[aeiouy]", "[^aeiouy]"
EARLY = "(?:gener|commun|arsen)"
#: What stands before an ending in the first or the second region matches these. Y is a y that counts as a consonant.
R1 = f"(?:{EARLY}|(?!{EARLY}){C}*{V}+{C})"
IN_1, IN_2, BEYOND_1 = (re.compile(r) for r in (R1, f"{R1}{C}*{V}+{C}", f"{R1}."))
SHORT = re.compile(f"(?:^{V}{C}|{C}{V}[^aeiouywxY])$")


Rule = Callable[[str], str | None]


def longest(w: str, rules: dict[str, Rule]) -> str:
    """What the rule of the longest ending makes of what stands before it; w if there is none, or if the rule gives nothing."""
    for ending in sorted(rules, key=len, reverse=True):
        if w.endswith(ending):
            made = rules[ending](w[: len(w) - len(ending)])
            return w if made is None else made
    return w


def in_region(region: re.Pattern[str], by: str = "") -> Rule:
    return lambda x: x + by if region.match(x) else None


def short_of_ies(x: str) -> str:
    return x + ("i" if len(x) > 1 else "ie")


def mended(x: str) -> str | None:
    """A word that has lost its -ed or -ing; nothing if no vowel is left."""
    if not re.search(V, x):
        return None
    if x.endswith(("at", "bl", "iz")):
        return x + "e"
    if x.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return x[:-1]
    return x + "e" if SHORT.search(x) and not BEYOND_1.match(x) else x


PLURAL: dict[str, Rule] = {"sses": lambda x: x + "ss", "ied": short_of_ies, "ies": short_of_ies, "us": lambda x: None, "ss": lambda x: None, "s": lambda x: x if re.search(f"{V}.+$", x) else None}
PAST: dict[str, Rule] = {"eed": in_region(IN_1, "ee"), "eedly": in_region(IN_1, "ee"), "ed": mended, "edly": mended, "ing": mended, "ingly": mended}
LONG: dict[str, Rule] = {**{k: in_region(IN_1, v) for k, v in SECOND.items()}, "li": lambda x: x if IN_1.match(x) and x[-1] in "cdeghkmnrt" else None}
LONGER: dict[str, Rule] = {**{k: in_region(IN_1, v) for k, v in THIRD.items()}, "ative": in_region(IN_2)}
LAST: dict[str, Rule] = {**{k: in_region(IN_2) for k in FOURTH}, "ion": lambda x: x if IN_2.match(x) and x[-1] in "st" else None}


def without_end(w: str) -> str:
    x = w[:-1]
    if w.endswith("e"):
        return x if IN_2.match(x) or (IN_1.match(x) and not SHORT.search(x)) else w
    return x if w.endswith("ll") and IN_2.match(x) else w


@lru_cache(maxsize=200_000)
def stem_of(word: str) -> str:
    """The stem of a lower-cased word without apostrophes. Words of one or two letters are their own stems; so are words without an English ending."""
    if len(word) <= 2 or word in INVARIANT:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub("([aeiouy])y", r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    w = longest(w, PLURAL)
    if w in WHOLE:
        return w
    w = re.sub(f"(.{C})[yY]$", r"\1i", longest(w, PAST))
    return without_end(longest(longest(longest(w, LONG), LONGER), LAST)).lower()
