"""Text analysis: words, stop words and stems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A number, or a letter with what follows; ``'`` and ``_`` join two parts.
WORD = r"[\p{N}]+|\p{L}[\p{L}\p{N}]*(?:['_][\p{L}\p{N}]+)*"
_PY_WORD = re.compile(r"[^\W\d_](?:[^\W_])*(?:['_][^\W_]+)*|\d+")
#: Shorter words are not indexed.
LEAST = 2

# The English stop words.
STOP_WORDS = frozenset(
    """about ain't all also am an and any anybody anyhow anyone anything anyway anyways anywhere are aren't as at be because
    been being both but by can can't cannot cant could couldn't did didn't do does doesn't doing don't done each either else
    etc ever every for from get gets getting got gotten had hadn't has hasn't have haven't having he he's her here here's hers
    herself him himself his how i'd i'll i'm i've ie if in into is isn't it it'd it'll it's its itself just let's like mainly
    many may maybe me might more much my myself new no non none not nothing now of off ok okay on only or other others ought
    our ours ourselves out per same shall she she's she'll should shouldn't so some somebody somehow someone something sometime
    sometimes somewhat somewhere such th than that that's thats the their theirs them themselves then there there's these they
    they'd they'll they're they've this those though through thru to too until unto up upon us very was wasn't we we'd we'll
    we're we've were weren't what what's when where where's whether which while who who's whoever whom whose why will with
    within without won't would wouldn't yes yet you you'd you'll you're you've your yours yourself yourselves""".split()
)


def words(text: str) -> list[str]:
    return _PY_WORD.findall(text.lower())


def tokens_sql(text: str) -> str:
    """SQL for the array of a text's words in lower case, in order."""
    pattern = WORD.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract_all(lower({text}), '{pattern}', 0)"


# -- stems: suffix stripping after Porter (1980) ------------------------------------------------------------------

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _pattern(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        vowel = c in "aeiou" or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _pattern(word).count("vc")


def _short(word: str) -> bool:
    return _pattern(word)[-3:] == "cvc" and word[-1] not in "wxy"


_ENDS = {id(table): tuple(table) for table in (_STEP2, _STEP3, _STEP4)}


def _longest(word: str, table) -> str | None:
    if not word.endswith(_ENDS[id(table)]):
        return None
    return max((s for s in table if word.endswith(s)), key=len, default=None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case; words of fewer than three letters, or with other letters, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if cut is not None and "v" in _pattern(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _pattern(w)[-2:] == "cc" and w[-1] == w[-2]:
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems_of(query: str, filter_stop_words: bool = False) -> list[str]:
    """The distinct stems of a query's words of two letters or more, in order."""
    found = [w for w in words(query) if len(w) >= LEAST and not (filter_stop_words and w in STOP_WORDS)]
    return list(dict.fromkeys(map(stem, found)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrays of words to the sorted distinct stems of those that are indexed."""
    for part in parts:
        yield part.map(lambda ws: None if ws is None else sorted({stem(w) for w in ws if len(w) >= LEAST and w not in STOP_WORDS}))


def stems_column(text: Column) -> Column:
    """The distinct indexed stems of a text; a null text has none."""
    return F.coalesce(stem_udf(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))), F.array().cast("array<string>"))
