"""Entity dashboard and readiness packet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import completeness, severity_pivot, top_n_list


def dashboard(base: DataFrame, alerts: DataFrame, counts: DataFrame, rollup: DataFrame, *, entity: str, severity: str,
              message: Column, order: Sequence[Column], newest: int = 3) -> DataFrame:
    """One row per entity: alert counts by level, newest alerts, task counts, status.

    Every input is folded to one row per entity before it is joined.
    """
    levels = severity_pivot(alerts, [entity], severity)
    latest = top_n_list(alerts, [entity], order, message, newest, "newest_alerts")
    j = base.join(levels, entity, "left").join(latest, entity, "left").join(counts, entity, "left").join(rollup, entity, "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in [*levels.columns[1:], *[x for x in counts.columns if x != entity]]}
    return j.withColumns({**zero, "newest_alerts": F.coalesce("newest_alerts", F.array().cast("array<string>"))})


def readiness(base: DataFrame, missing: Mapping[str, Column]) -> DataFrame:
    """Readiness packet with its completeness score."""
    return base.withColumns(completeness(missing))
