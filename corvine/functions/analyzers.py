"""Lexemes of text: a plain analyzer in expressions, and an English one with stop words and stemming."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[a-z0-9_](?:[a-z0-9_./:-]*[a-z0-9_])?"


def simple_tokens(text: Column) -> Column:
    """Lower-case tokens with inner punctuation kept, so that identifiers stay whole; null text gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


# Common English words that are no search terms.
STOP_WORDS = frozenset(
    "a about after all also am an and any are as at be because been before being but by can could did do does doing down during each few for"
    " from further had has have having he her here him his how i if in into is it its just me more most my no nor not now of off on once only"
    " or other our out over own same she should so some such than that the their them then there these they this those through to too under"
    " until up very was we were what when where which while who whom why will with you your".split()
)
VOWELS = "aeiou"


def _measure(w: str) -> int:
    kinds = "".join("v" if c in VOWELS or (c == "y" and i and w[i - 1] not in VOWELS) else "c" for i, c in enumerate(w))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", kinds)))


def _has_vowel(w: str) -> bool:
    return any(c in VOWELS or (c == "y" and i) for i, c in enumerate(w))


def _short(w: str) -> bool:
    return len(w) >= 3 and w[-1] not in "wxy" + VOWELS and w[-2] in VOWELS + "y" and w[-3] not in VOWELS


# Suffixes and their replacements of the published suffix-stripping algorithm of 1980, steps 2 to 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Stem of an English word; words with anything but letters stay as they are."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in VOWELS + "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


WORD = re.compile(r"[a-z0-9]+")


def english_lexemes(text: str | None) -> list[str]:
    return [stem(w) for w in WORD.findall((text or "").lower()) if w not in STOP_WORDS]


@F.pandas_udf(T.ArrayType(T.StringType()))
def english_tokens(text: pd.Series) -> pd.Series:
    """Stems without stop words, in order; null text gives none."""
    return text.map(english_lexemes)


def postings(df: DataFrame, id_col: str, fields: dict[str, str], analyzer=simple_tokens) -> DataFrame:
    """lexeme, id, weight (A, B, C), positions: an inverted table over weighted fields."""
    parts = None
    for weight, c in fields.items():
        p = df.select(F.col(id_col).alias("id"), F.lit(weight).alias("weight"), F.posexplode(analyzer(F.col(c))).alias("pos", "lexeme"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("lexeme", "id", "weight").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
