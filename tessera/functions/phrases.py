"""Phrase and fact matching in answers, over token arrays.

Each function takes tokens or stems as arrays, so it works with plain tokens in built-in functions and
with stems from stem_tokens alike.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stems import stem
from .text import let, tokens

# Words that negate, and words without content.
NEGATIONS = {"en": ["not", "no", "never", "none", "neither", "nor", "cannot"], "ru": ["не", "ни", "нет", "никогда", "нельзя"]}
STOPWORDS = {
    "en": (
        "a an the and or of to in on at for is are was were be been being it its this that these those as by with from into per than then there their they you your we our us he she his her him "
        "which who whom what when where how not no if so such can may will would should could must has have had do does did about over under between any all each other some more most also"
    ).split(),
    "ru": (
        "и в во на с со по из от к ко для о об обо не ни что это как так его её их мы вы они он она оно был была было были есть будет будут может могут также при без до за под над между через или "
        "а но то же ли бы уже ещё все весь вся всё который которая которое которые этот эта эти тот та те"
    ).split(),
}
FACT_THRESHOLD = 0.8


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(words: pd.Series, lang: pd.Series) -> pd.Series:
    """The stem of each token, by language; Arrow batches, each distinct word stemmed once."""
    return pd.Series([None if w is None else [stem(x, k or "") for x in w] for w, k in zip(words, lang, strict=True)])


def phrase_at(words: Column, phrase: Column, raw: Column | None = None, lang: str = "en") -> Column:
    """Whether the phrase stands in the words as a whole; with raw tokens, not behind a negation by one or two."""
    neg = F.array(*[F.lit(w) for w in NEGATIONS[lang]])

    def within(w: Column, p: Column, r: Column | None) -> Column:
        n = F.size(p)
        starts = F.when((n > 0) & (n <= F.size(w)), F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        if r is None:
            return F.exists(starts, lambda i: F.slice(w, i, n) == p)
        return F.exists(starts, lambda i: (F.slice(w, i, n) == p) & ~F.arrays_overlap(F.slice(r, F.greatest(i - 2, F.lit(1)), F.least(i - 1, F.lit(2))), neg))

    if raw is None:
        return let(F.struct(words.alias("w"), phrase.alias("p")), lambda x: within(x["w"], x["p"], None))
    return let(F.struct(words.alias("w"), phrase.alias("p"), raw.alias("r")), lambda x: within(x["w"], x["p"], x["r"]))


def content_words(text: Column, lang: str = "en") -> Column:
    """Tokens after digits and letters are parted, without words of no content and single letters."""
    parted = F.regexp_replace(text, r"([0-9])([A-Za-z])|([A-Za-z])([0-9])", "$1$3 $2$4")
    stop = F.array(*[F.lit(w) for w in STOPWORDS[lang]])
    return F.filter(tokens(parted), lambda t: ((F.length(t) > 1) | t.rlike("^[0-9]+$")) & ~F.array_contains(stop, t))


def share_present(words: Column, fact: Column) -> Column:
    """The share of the fact's words that are among the words; 0 if either is empty."""

    def share(w: Column, f: Column) -> Column:
        hits = F.size(F.filter(f, lambda t: F.array_contains(w, t)))
        return F.when((F.size(f) > 0) & (F.size(w) > 0), hits / F.size(f)).otherwise(F.lit(0.0))

    return let(F.struct(words.alias("w"), fact.alias("f")), lambda x: share(x["w"], x["f"]))


def negation_parity(words: Column, lang: str = "en") -> Column:
    neg = F.array(*[F.lit(w) for w in NEGATIONS[lang]])
    return F.size(F.filter(words, lambda t: F.array_contains(neg, t))) % 2


def fact_covered(answer: Column, fact: Column, lang: str = "en") -> Column:
    """Whether the answer has 0.8 of the fact's content words and is negated as often, modulo 2."""
    same = negation_parity(tokens(answer), lang) == negation_parity(tokens(fact), lang)
    return same & (share_present(content_words(answer, lang), content_words(fact, lang)) >= FACT_THRESHOLD)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def lead_paragraph(answer: Column) -> Column:
    """The first paragraph that is not blank."""
    parts = F.filter(F.transform(F.split(answer, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def first_place(words: Column, phrases: Column) -> Column:
    """The number of words up to the end of the earliest of the phrases (arrays of tokens); one more than all if none."""

    def place(w: Column, ps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)))
        end = lambda p: F.coalesce(F.array_min(F.filter(starts, lambda i: F.slice(w, i, F.size(p)) == p)) + F.size(p) - 1, F.size(w) + 1)
        return F.coalesce(F.array_min(F.transform(F.filter(ps, lambda p: F.size(p) > 0), end)), F.size(w) + 1)

    return let(F.struct(words.alias("w"), phrases.alias("p")), lambda x: place(x["w"], x["p"]))


def currency_state(answer: Column, current: Column, stale: Column, control: Column) -> Column:
    """current, stale, hedged or missing by what the lead paragraph says; phrases are arrays of texts."""
    def state(w: Column, cur: Column, old: Column) -> Column:
        has = lambda ps: F.exists(ps, lambda p: phrase_at(w, p, w))
        first = F.when(~control & (first_place(w, cur) < first_place(w, old)), "current").otherwise("hedged")
        return F.when(has(cur) & has(old), first).when(has(cur), "current").when(has(old), "stale").otherwise("missing")

    parts = F.struct(tokens(lead_paragraph(answer)).alias("w"), F.transform(current, tokens).alias("cur"), F.transform(stale, tokens).alias("old"))
    return let(parts, lambda x: state(x["w"], x["cur"], x["old"]))
