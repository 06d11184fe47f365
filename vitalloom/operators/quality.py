"""Data quality: required columns, status domains, pair uniqueness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import pair_high, pair_low


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns the table lacks; reads the schema only."""
    have = set(df.columns)
    return [name for name in required if name not in have]


def table_report(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows and missing columns per table, as one union of counts."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(",".join(missing_columns(df, required.get(name, ())))).alias("missing"))
        out = row if out is None else out.unionByName(row)
    return out


def outside_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Count per value that the domain does not hold; nulls count too."""
    bad = ~F.col(column).isin(*domain) | F.col(column).isNull()
    return df.where(bad).groupBy(F.col(column).alias("bad_value")).agg(F.count("*").alias("n"))


def repeated_pairs(df: DataFrame, a: str, b: str, active: Column | None = None) -> DataFrame:
    """Unordered pairs that occur more than once among active rows."""
    rows = df if active is None else df.where(active)
    return (rows.groupBy(pair_low(F.col(a).cast("string"), F.col(b).cast("string")).alias("low"),
                         pair_high(F.col(a).cast("string"), F.col(b).cast("string")).alias("high"))
            .agg(F.count("*").alias("n")).where(F.col("n") > 1))
