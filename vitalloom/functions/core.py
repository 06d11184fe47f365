"""Column helpers shared by all operators: severities, pairs, time, blanks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severity order.
SEVERITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
VETO_SEVERITIES = ("critical", "high")


def c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lookup(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Literal map lookup; keys outside the map give ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c(col))
    return found if default is None else F.coalesce(found, F.lit(default))


def normal_severity(col: str | Column) -> Column:
    """Lower-case severity; blank, null and unknown values become ``medium``."""
    s = F.lower(F.trim(c(col)))
    return F.when(s.isin(*SEVERITY_RANK), s).otherwise("medium")


def severity_rank(col: str | Column) -> Column:
    return lookup(F.lower(F.trim(c(col))), SEVERITY_RANK, SEVERITY_RANK["medium"])


def rank_severity(rank: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), c(rank).cast("int") + 1)


def pair_low(a: str | Column, b: str | Column) -> Column:
    return F.least(F.lower(F.trim(c(a))), F.lower(F.trim(c(b))))


def pair_high(a: str | Column, b: str | Column) -> Column:
    return F.greatest(F.lower(F.trim(c(a))), F.lower(F.trim(c(b))))


def as_time(value: str | dt.datetime) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)


def ts(value: str | dt.datetime) -> Column:
    """Zone-less timestamp literal: folds to a constant, so scans can push it down."""
    return F.lit(as_time(value).isoformat(sep=" ")).cast(T.TimestampNTZType())


def ts_plus(value: str | dt.datetime, **delta: float) -> Column:
    return ts(as_time(value) + dt.timedelta(**delta))


def seconds(col: str | Column) -> Column:
    """Seconds since the epoch (double) of a timestamp with or without zone."""
    return F.unix_micros(c(col).cast("timestamp")) / F.lit(1_000_000.0)


def micros(col: str | Column) -> Column:
    return F.unix_micros(c(col).cast("timestamp"))


def round_double(col: str | Column, digits: int) -> Column:
    """A double rounded as it is stored, half away from zero. Spark's ``round`` takes the shortest decimal form
    instead, and so rounds 1.005, which is stored as a little less, up."""
    scale = F.lit(10.0 ** digits)
    return F.round(c(col) * scale) / scale


def nonblank(col: str | Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(F.trim(c(col)), F.lit(""))


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A rule table held as literals. Bounded by the source code, so it is
    always safe to broadcast; tables that grow are never hinted."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))


# A word character in any script, the same in Java and RE2.
WORD = r"\p{L}\p{N}_"


def word_pattern(terms: Iterable[str]) -> str:
    """Regex true when any term occurs between non-word characters."""
    body = "|".join(_escape(t) for t in terms)
    return f"(?:^|[^{WORD}])(?:{body})(?:$|[^{WORD}])"


def substring_pattern(terms: Iterable[str]) -> str:
    return "(?:" + "|".join(_escape(t) for t in terms) + ")"


def _escape(term: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$*+?()[]{}|" else ch for ch in term)


def has_word(col: str | Column, terms: Iterable[str]) -> Column:
    return c(col).rlike(word_pattern(terms))


def has_text(col: str | Column, terms: Iterable[str]) -> Column:
    """Plain substring test for any of the terms."""
    return c(col).rlike(substring_pattern(terms))


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Ordered rules, first true one wins."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(default)


def with_lengths(rows: DataFrame, of: DataFrame, col: str, name: str) -> DataFrame:
    """Each row once for each distinct text length of ``of[col]``, in column ``name``.

    The lengths are a scalar subquery; nothing is collected while the query is built.
    """
    lengths = of.where(F.length(col) > 0).agg(F.array_sort(F.collect_set(F.length(col)))).scalar()
    return rows.withColumn(name, F.explode(lengths))
