"""Text columns: let-bindings, token maps, phrase replacement, normalising."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def literal_map(mapping: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def spaced(text: str | Column) -> Column:
    """Tokens framed by two blanks each, so every token owns its own borders."""
    return F.concat(F.lit(" "), F.replace(F.trim(c(text)), F.lit(" "), F.lit("  ")), F.lit(" "))


def unspaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def replace_phrases(text: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace whole-token phrases, longest first, in single-spaced text.

    The phrases are one literal array that a fold walks, so the plan stays small
    however long the list is.
    """
    ordered = sorted(mapping.items(), key=lambda kv: len(kv[0]), reverse=True)
    pairs = F.array(*[F.struct(F.lit(_frame(a)).alias("a"), F.lit(_frame(b)).alias("b")) for a, b in ordered])
    return unspaced(F.aggregate(pairs, spaced(text), lambda s, p: F.replace(s, p["a"], p["b"])))


def _frame(phrase: str) -> str:
    return " " + "  ".join(phrase.lower().split()) + " "


def squeeze_runs(text: str | Column) -> Column:
    """Three or more of one character become two."""
    return F.regexp_replace(c(text), r"(.)\1{2,}", "$1$1")


def one_space(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact matching-blocks ratio for pairs that a join has already narrowed."""
    from difflib import SequenceMatcher
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def token_map(text: str | Column, mapping: Mapping[str, str], keep_after: Sequence[str] = (),
              keep_tokens: Sequence[str] = (), unknown: Callable[[Column], Column] | None = None) -> Column:
    """Map tokens one by one; ``keep_tokens`` stay after a ``keep_after`` token, ``unknown`` may map the others."""
    m = literal_map(mapping)

    def walk(tokens: Column) -> Column:
        def one(t, i):
            new = F.coalesce(F.try_element_at(m, t), unknown(t), t) if unknown else F.coalesce(F.try_element_at(m, t), t)
            if not keep_tokens:
                return new
            before = F.get(tokens, i - 1)
            return F.when(t.isin(*keep_tokens) & (i > 0) & before.isin(*keep_after), t).otherwise(new)
        return F.array_join(F.transform(tokens, one), " ")

    return let(F.split(c(text), " "), walk)


def edit_ratio(a: Column, b: Column) -> Column:
    """Share of letters that stand in both words when an inserted or missing letter costs one and a changed one two."""
    return ratio_of(F.levenshtein(a, b), a, b)


def ratio_of(distance: Column, a: Column, b: Column) -> Column:
    """:func:`edit_ratio` of two words whose edit distance is known."""
    return 1 - (2 * distance - F.abs(F.length(a) - F.length(b))) / (F.length(a) + F.length(b))


def soundex_like(text: str | Column) -> Column:
    """Four-character sound code in which vowels, h and w separate equal codes."""
    s = F.regexp_replace(F.lower(c(text)), "[^a-z]", "")
    codes = F.translate(s, "aeiouyhwbfpvcgjkqsxzdtlmnr", "00000000111122222222334556")
    collapsed = F.regexp_replace(codes, r"(.)\1+", "$1")
    rest = F.replace(F.substring(collapsed, F.lit(2), F.length(collapsed)), F.lit("0"), F.lit(""))
    return F.when(s == "", "").otherwise(F.substring(F.concat(F.upper(F.substring(s, 1, 1)), rest, F.lit("000")), 1, 4))
