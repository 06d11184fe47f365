"""Previous / next row of a key, safe for keys that hold much of the table.

A plain ``lag`` sorts all rows of one key in one task. Here each key is cut into
time slices: ``lag`` runs inside a slice, and only each slice's last (or first)
row travels on to the neighbouring slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    out: str,
    *,
    forward: bool = False,
    slice_by: Column | None = None,
) -> DataFrame:
    """Add struct column ``out`` with ``values`` of the previous (next) row.

    ``order`` starts with the time column and must be total within a key.
    ``slice_by`` defaults to the calendar day of that column; any expression
    that never falls along ``order`` will do.
    """
    day = slice_by if slice_by is not None else F.date_trunc("day", F.col(order[0]))
    rows = df.withColumn("__slice", day)
    payload = F.struct(*[F.col(v) for v in values])
    position = F.struct(*[F.col(o) for o in order])
    inside = W.partitionBy(*keys, "__slice").orderBy(*order)
    step = F.lead if forward else F.lag
    rows = rows.withColumn(out, step(payload).over(inside))

    edge = (F.min_by if forward else F.max_by)(payload, position)
    across = W.partitionBy(*keys).orderBy("__slice")
    edges = (
        df.withColumn("__slice", day)
        .groupBy(*keys, "__slice")
        .agg(edge.alias("__edge"))
        .withColumn("__edge", step("__edge").over(across))
        .where(F.col("__edge").isNotNull())
    )
    for k in (*keys, "__slice"):
        edges = edges.withColumnRenamed(k, f"__k_{k}")
    same = [rows[k].eqNullSafe(edges[f"__k_{k}"]) for k in (*keys, "__slice")]
    joined = rows.join(edges, same, "left")
    return joined.withColumn(out, F.coalesce(out, "__edge")).drop(
        "__slice", "__edge", *[f"__k_{k}" for k in (*keys, "__slice")]
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                slice_by: Column) -> DataFrame:
    """Running sum of ``value`` per key up to and with each row, sliced like
    :func:`neighbour`: sums inside a slice, plus the total of earlier slices."""
    rows = df.withColumns({"__slice": slice_by, "__v": value})
    totals = rows.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__total"))
    across = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("__before", F.sum("__total").over(across)).where("__before IS NOT NULL")
    for k in (*keys, "__slice"):
        base = base.withColumnRenamed(k, f"__k_{k}")
    inside = W.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(out, F.sum("__v").over(inside))
    same = [rows[k].eqNullSafe(base[f"__k_{k}"]) for k in (*keys, "__slice")]
    return rows.join(base, same, "left").withColumn(
        out, F.col(out) + F.coalesce("__before", F.lit(0))).drop(
        "__slice", "__v", "__total", "__before", *[f"__k_{k}" for k in (*keys, "__slice")])
