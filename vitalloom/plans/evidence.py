"""Evidence review: score, gate and promote researched rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import merge_evidence, promotion_state, safety_gates, score_evidence
from ..operators.joins import without_equal_work


def review(evidence: DataFrame, decided: DataFrame, key: str, *, source: str, status: str, severity: str, context: Column,
           conditions: Column, summary: Sequence[Column], required: Sequence[str]) -> DataFrame:
    """Severity, confidence, gate outcome and next state of every key not yet decided.

    Three aggregates of one evidence table keyed alike, so they share its
    partitioning; nothing is gathered per key beyond its source names.
    """
    tried = evidence.groupBy(key).agg(F.collect_set(source).alias("tried"))
    scored = score_evidence(evidence, [key], source, severity).join(tried, key)
    merged = merge_evidence(evidence, [key], source, status, severity).select(key, "sources_checked")
    gated = safety_gates(scored, evidence=F.col("evidence_count") > 0, context=context, attempted=F.col("tried"), summary=summary,
                         conditions=conditions, severity=F.col("severity"), confidence=F.col("confidence"), required=required)
    state = promotion_state(F.col("all_passed"), F.col("confidence"), F.col("severity"))
    out = gated.join(merged, key, "left").select(key, "severity", "confidence", "evidence_count", "sources_checked",
                                                 "all_passed", state.alias("next_state"))
    return without_equal_work(out, decided, [key])
