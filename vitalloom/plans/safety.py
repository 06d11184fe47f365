"""Population safety check: findings of every entity and item in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import VETO_SEVERITIES, rank_severity, severity_rank
from ..operators.aggregates import escalate_by_votes
from ..operators.joins import (CONDITION_RULES, canonical_rules, condition_findings, duplicates_held, flagged_pairs_held, held_once,
                               renal_findings, without_recent)
from ..operators.windows import union_findings
from ..session import written

SHAPE = {"entity": "bigint", "item": "string", "type": "string", "severity": "string"}


def safety_findings(items: DataFrame, rules: DataFrame, votes: DataFrame, renal_rules: DataFrame, markers: DataFrame,
                    renal_flags: DataFrame, conditions: DataFrame, *, entity: str, ident: str, item: str, prescriber: str,
                    components: Column, condition: str, condition_rules: Sequence[tuple] = CONDITION_RULES,
                    renal_fallback: Sequence[str] = ()) -> DataFrame:
    """One row per finding (entity, item, type, severity).

    Interactions escalate by votes; duplicates, overlaps, marker bands and
    condition rules are added. All branches read the distinct items of each entity from one exchange by entity, and
    nothing that grows with the items is dealt or written again. An entity's items are met by rules, counts and windows,
    never as pairs of a large group. Votes are set against the rules, which are written, as are the marker rules:
    Spark then knows that they are small where they are.
    """
    held = held_once(items, entity, item, prescriber)
    learned = escalate_by_votes(canonical_rules(rules).withColumnsRenamed({"low": "drug_a", "high": "drug_b"}), votes, "drug_a",
                                "drug_b", "severity", "outcome").select(F.col("drug_a").alias("low"), F.col("drug_b").alias("high"), "learned_severity")
    interactions = flagged_pairs_held(held, written(learned, "pair-rules"), entity, item).select(
        F.col(entity).alias("entity"), F.concat_ws("+", "low", "high").alias("item"), F.lit("drug_interaction").alias("type"),
        F.col("learned_severity").alias("severity"))
    doubles = duplicates_held(held, entity, item, components).select(
        F.col(entity).alias("entity"), F.col(item).alias("item"), F.col("finding").alias("type"), "severity")
    each = held.select(entity, f"held.{item}")
    renal = renal_findings(each, written(renal_rules, "marker-rules"), markers, renal_flags, entity=entity, item=item,
                           fallback=renal_fallback).select(
        F.col(entity).alias("entity"), F.col(item).alias("item"), F.col("finding").alias("type"), "severity")
    cond = condition_findings(each.join(conditions, entity), item, condition, [entity, item], condition_rules).select(
        F.col(entity).alias("entity"), F.col(item).alias("item"), F.col("rule").alias("type"), "severity")
    return union_findings(SHAPE, interactions, doubles, renal, cond)


def safety_summary(findings: DataFrame) -> DataFrame:
    """Worst severity, finding count and veto flag per entity, in one pass."""
    return findings.groupBy("entity").agg(
        rank_severity(F.max(severity_rank("severity"))).alias("max_severity"), F.count("*").alias("findings")).withColumn(
        "requires_veto", F.col("max_severity").isin(*VETO_SEVERITIES))


def alerts_to_raise(summary: DataFrame, context: DataFrame, keys: Sequence[str], time: str, within_seconds: float) -> DataFrame:
    """The summary with ``alert``: veto-worthy, and no equal alert of the key within the window before.

    The summary (one row per entity) is written once, since the window needs it on both sides.
    """
    known = written(summary.join(context, "entity"), "safety-summary")
    due = known.where("requires_veto")
    flagged = without_recent(due, due, [*keys, "max_severity"], time, time, within_seconds, ident="entity", flag="__seen")
    calm = known.where(~F.col("requires_veto")).withColumn("__seen", F.lit(True))
    return flagged.unionByName(calm).withColumn("alert", ~F.col("__seen")).drop("__seen")
