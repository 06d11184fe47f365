"""Aggregations: counts, escalation, evidence scoring, completeness, rollups.

Everything folds map-side first; lists kept per entity are cut to their fixed
length before they are gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import (SEVERITY_RANK, c, first_match, normal_severity, pair_high, pair_low, rank_severity,
                              severity_rank)


def top_n_list(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, n: int,
               out: str) -> DataFrame:
    """The first ``n`` values per key as a list: cut by rank first, then gathered."""
    w = W.partitionBy(*keys).orderBy(*order)
    cut = df.select(*keys, value.alias("__v"), F.row_number().over(w).alias("__rn")).where(F.col("__rn") <= n)
    return cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__rn", "__v"))).alias("__l")).select(
        *keys, F.col("__l.__v").alias(out))


def filtered_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(cond).alias(n) for n, cond in conditions.items()])


def count_and_latest(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(time).alias("latest"))


def status_histogram(df: DataFrame, keys: Sequence[str], status: Column, default: str = "unknown") -> DataFrame:
    return df.groupBy(*keys, F.coalesce(status, F.lit(default)).alias("status")).agg(F.count("*").alias("n"))


def alert_level(severity: str | Column) -> Column:
    """Severity of an alert with colour names folded in."""
    s = F.lower(F.coalesce(c(severity), F.lit("medium")))
    return F.when(s == "red", "critical").when(s.isin("critical", "high", "low"), s).otherwise("medium")


def severity_pivot(df: DataFrame, keys: Sequence[str], severity: str | Column) -> DataFrame:
    level = alert_level(severity)
    return df.groupBy(*keys).agg(*[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low")])


def worst_severity(df: DataFrame, keys: Sequence[str], severity: str, out: str = "max_severity") -> DataFrame:
    return df.groupBy(*keys).agg(rank_severity(F.max(severity_rank(severity))).alias(out))


# Votes needed, and the share of vetoes among decisive votes.
MIN_VOTES, VETO_SHARE = 3, 0.8


def escalate_by_votes(pairs: DataFrame, votes: DataFrame, a: str, b: str, severity: str, outcome: str, *,
                      min_votes: int = MIN_VOTES, share: float = VETO_SHARE) -> DataFrame:
    """Raise a pair to critical when enough votes mostly veto it; never lower it."""
    o = F.lower(F.col(outcome))
    tally = (votes.groupBy(pair_low(a, b).alias("low"), pair_high(a, b).alias("high"))
             .agg(F.count("*").alias("votes"), F.count_if(o == "approved").alias("approved"),
                  F.count_if(o == "vetoed").alias("vetoed"))
             .where((F.col("votes") >= min_votes) & (F.col("vetoed") > F.col("approved"))
                    & (F.col("vetoed") / (F.col("vetoed") + F.col("approved")) >= share))
             .select("low", "high", F.lit(True).alias("__raised")))
    keyed = pairs.withColumns({"low": pair_low(a, b), "high": pair_high(a, b)})
    base = F.coalesce(normal_severity(severity), F.lit("none"))
    base = F.when(F.col(severity).isNull(), "none").otherwise(base)
    return keyed.join(tally, ["low", "high"], "left").withColumns({
        "learned_severity": F.when(F.col("__raised").isNotNull(), "critical").otherwise(base),
        "learned": F.col("__raised").isNotNull() & (base != "critical"),
    }).drop("__raised", "low", "high")


# --- evidence ------------------------------------------------------------------

# Confidence bounds by kind of evidence.
DIRECT_FLOOR, LITERATURE_FLOOR, NO_EVIDENCE_CAP, UNRATED_PRIOR = 0.88, 0.70, 0.55, 0.60
MIN_CONFIDENCE, RECHECK_HOURS = 0.75, 168
REQUIRED_SOURCES = ("local_drug_interactions", "rxnav", "openfda")


def merge_evidence(evidence: DataFrame, keys: Sequence[str], source: str, status: str, severity: str) -> DataFrame:
    """Strongest severity among ``ok`` sources, and all their names."""
    ok = evidence.where(F.col(status) == "ok")
    return ok.groupBy(*keys).agg(
        rank_severity(F.max(severity_rank(F.coalesce(severity, F.lit("medium"))))).alias("severity"),
        F.array_sort(F.collect_set(source)).alias("sources_checked"))


def verify_rules(rules: DataFrame, evidence: DataFrame, keys: Sequence[str], source: str, status: str,
                 pieces: str, confidence: str, direct: Sequence[str], literature: Sequence[str]) -> DataFrame:
    """Confidence and verification state of each rule from its evidence rows."""
    has = F.coalesce(F.col(pieces), F.lit(0)) > 0
    seen = evidence.groupBy(*keys).agg(
        F.bool_or(F.col(source).isin(*direct) & (F.col(status) == "ok") & has).alias("__direct"),
        F.bool_or(F.col(source).isin(*literature) & has).alias("__lit"))
    joined = rules.join(seen, list(keys), "left")
    direct_ok, lit_ok = F.coalesce("__direct", F.lit(False)), F.coalesce("__lit", F.lit(False))
    prior = F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(UNRATED_PRIOR))
    score = (F.when(direct_ok, F.greatest(prior, F.lit(DIRECT_FLOOR)))
             .when(lit_ok, F.greatest(prior, F.lit(LITERATURE_FLOOR)))
             .otherwise(F.least(prior, F.lit(NO_EVIDENCE_CAP))))
    return joined.withColumns({
        "confidence_score": F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2),
        "verification_status": F.when(direct_ok, "live_verified").otherwise("review_required"),
        "reason": F.when(direct_ok, "direct_live_evidence").when(lit_ok, "literature_only_needs_review")
        .otherwise("no_external_confirmation"),
    }).drop("__direct", "__lit")


def score_evidence(evidence: DataFrame, keys: Sequence[str], source: str, severity: str,
                   literature: Sequence[str] = ("pubmed",)) -> DataFrame:
    """Severity, confidence and count of the evidence of each key."""
    worst = F.max(F.when(~F.col(source).isin(*literature), severity_rank(severity)))
    agg = evidence.groupBy(*keys).agg(
        F.count("*").alias("evidence_count"), F.count_if(~F.col(source).isin(*literature)).alias("__firm"),
        F.coalesce(worst, F.lit(0)).alias("__rank"))
    raw = F.least(F.lit(0.95), F.lit(0.35) + F.col("__firm") * 0.2 + F.col("evidence_count") * 0.1)
    conf = F.when(F.col("__rank") == 0, F.least(raw, F.lit(0.45))).otherwise(raw)
    return agg.select(*keys, "evidence_count", rank_severity("__rank").alias("severity"),
                      F.round(conf, 2).alias("confidence"))


def safety_gates(df: DataFrame, *, evidence: Column, context: Column, attempted: Column, summary: Sequence[Column],
                 conditions: Column, severity: Column, confidence: Column, safety: Column | None = None,
                 required: Sequence[str] = REQUIRED_SOURCES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Eight boolean gates and their conjunction."""
    filled = F.lit(True)
    for s in summary:
        filled = filled & (F.coalesce(s, F.lit("")) != "")
    needed = F.array(*[F.lit(s) for s in required])
    critic = evidence | (~severity.isin("high", "critical") & (confidence <= 0.5))
    gates = {
        "evidence": evidence, "context": context,
        "tool_ledger": F.size(F.array_except(needed, attempted)) == 0,
        "three_part_summary": filled, "contraindications": conditions, "critic": critic,
        "safety": safety if safety is not None else F.lit(True), "confidence_gate": confidence >= min_confidence,
    }
    gates = {n: F.coalesce(g, F.lit(False)) for n, g in gates.items()}
    everything = F.lit(True)
    for g in gates.values():
        everything = everything & g
    return df.withColumns({**gates, "all_passed": everything})


def promotion_state(all_passed: Column, confidence: Column, severity: Column, *,
                    min_confidence: float = MIN_CONFIDENCE, human: Sequence[str] = ("critical",),
                    auto: Sequence[str] = ("high",)) -> Column:
    """Where a researched rule goes next."""
    return first_match([
        (~F.coalesce(all_passed, F.lit(False)), "gates_failed"),
        (confidence < min_confidence, "low_confidence"),
        (severity == "none", "no_interaction"),
        (severity.isin(*human), "pending_human_approval"),
        (severity.isin(*auto), "pending_veto"),
    ], "severity_not_promotable")


# --- completeness ----------------------------------------------------------------

# Issue and penalty, in report order; band floors.
CARD_PENALTIES = (
    ("missing_caregiver_contacts", 25), ("missing_doctor_phone", 15), ("missing_hospital_map", 15),
    ("missing_hospital_phone", 10), ("missing_patient_location", 20), ("missing_active_medications", 10),
    ("missing_recent_medication_log", 5),
)
CARD_BANDS = ((85, "ready"), (60, "usable_needs_review"))


def completeness(missing: Mapping[str, Column]) -> dict[str, Column]:
    """Score, band and issue list from ``issue -> is missing`` columns."""
    score = F.lit(100)
    issues = []
    for issue, penalty in CARD_PENALTIES:
        gone = F.coalesce(missing[issue], F.lit(True))
        score = score - F.when(gone, penalty).otherwise(0)
        issues.append(F.when(gone, issue))
    score = F.least(F.greatest(score, F.lit(0)), F.lit(100))
    band = first_match([(score >= floor, name) for floor, name in CARD_BANDS], "incomplete")
    return {"score": score, "band": band, "issues": F.array_compact(F.array(*issues))}


# --- status rollup ------------------------------------------------------------------

def adherence_snapshot(matched: DataFrame, logs: DataFrame, keys: Sequence[str], dose: str, value: str, log_time: str,
                       as_of: Column) -> DataFrame:
    """Per (entity, day): doses scheduled, taken, missed, pending, and the reporting gap.

    ``matched`` is the outcome of the one-to-one dose match; any matched event
    other than ``missed`` counts as taken.
    """
    v = F.lower(F.col(value))
    late = F.col(dose) < as_of - F.expr("INTERVAL 24 HOURS")
    per_dose = matched.groupBy(*keys).agg(
        F.count("*").alias("total_scheduled"), F.count_if(v.isNotNull() & (v != "missed")).alias("taken"),
        F.count_if(v == "missed").alias("missed"), F.count_if(v.isNull()).alias("pending"),
        F.bool_or(v.isNull() & late).alias("gap_detected"),
        F.min(F.when((F.col(dose) > as_of) & (F.to_date(dose) == F.to_date(as_of)), F.col(dose))).alias("next_dose"))
    reported = logs.groupBy(*keys).agg(F.max(log_time).alias("last_reported"))
    return per_dose.join(reported, list(keys), "left").withColumn(
        "confidence", F.when(F.col("last_reported").isNotNull(), 0.9).otherwise(0.78))


ROLLUP_CONFIDENCE = {f"{n}/{a}": round((0.55 + n * 0.08 + a) / 2, 2) for n in range(5) for a in (0.5, 0.78, 0.9)}


def care_rollup(base: DataFrame, entity: str, alerts: DataFrame, *, severity: str, message: str, order: Sequence[Column],
                vitals_critical: str, labs_out: str, active: str, vitals: str, labs: str, gap: str, missed: str,
                scheduled: str, adherence_confidence: str, has_adherence: str) -> DataFrame:
    """Red / yellow / green with the first three items of each kind.

    ``base`` has one row per entity with the pre-aggregated columns named by the
    other arguments; ``alerts`` are the open alerts.
    """
    sev = F.lower(F.col(severity))
    kind = F.when(sev.isin("critical", "high", "red"), "c").when(sev.isin("advisory", "medium", "yellow"), "a")
    urgent = top_n_list(alerts.where(kind == "c"), [entity], order, F.col(message), 3, "__crit")
    watch = top_n_list(alerts.where(kind == "a"), [entity], order, F.col(message), 3, "__att")
    count = alerts.groupBy(entity).agg(F.count("*").alias("open_alerts"))
    empty = F.array().cast("array<string>")
    j = base.join(urgent, entity, "left").join(watch, entity, "left").join(count, entity, "left")
    crit = F.slice(F.concat(F.coalesce("__crit", empty), F.array_compact(F.array(
        F.when(F.col(gap), "A medication reporting gap was detected."),
        F.when(F.col(vitals_critical), "A recent vital reading is critical.")))), 1, 3)
    att = F.slice(F.concat(F.coalesce("__att", empty), F.array_compact(F.array(
        F.when(F.col(missed) >= 2, "Two or more medication doses were missed."),
        F.when(F.col(labs_out), "A recent lab result is out of range.")))), 1, 3)
    n = sum([(F.coalesce(x, F.lit(False))).cast("int") for x in (
        F.col(active) > 0, F.col(vitals) > 0, F.col(labs) > 0, F.col("open_alerts") > 0,
        F.col(has_adherence) & (F.col(scheduled) > 0))], F.lit(0))
    second = F.when(F.col(has_adherence), F.coalesce(F.nullif(adherence_confidence, F.lit(0.0)), F.lit(0.5))).otherwise(0.5)
    first = F.lit(0.55) + F.least(n, F.lit(4)) * 0.08
    # The usual values are rounded once, on their exact binary value; others by Spark.
    key = F.concat(F.least(n, F.lit(4)).cast("string"), F.lit("/"), second.cast("string"))
    conf = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLLUP_CONFIDENCE.items() for x in kv]), key),
                      F.round((first + second) / 2, 2))
    return (j.withColumns({"critical_items": crit, "attention_items": att})
            .withColumns({
                "status": F.when(F.size("critical_items") > 0, "red").when(F.size("attention_items") > 0, "yellow")
                .otherwise("green"),
                "confidence": F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))})
            .select(entity, "status", "critical_items", "attention_items", "confidence"))


def first_non_null(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """First non-blank value of each column along ``order``: plain aggregates, no sort."""
    def usable(n):
        col = F.col(n)
        return F.when(col.isNotNull() & (col.cast("string") != ""), F.col(order))
    return df.groupBy(*keys).agg(*[F.min_by(n, usable(n)).alias(n) for n in columns])


# --- vectors -----------------------------------------------------------------------

def label_centroids(df: DataFrame, label: str, vector: str, dimensions: int) -> DataFrame:
    """Unit-length mean vector per label.

    One average per dimension keeps a single row per label and task in the
    shuffle, where exploding would multiply the table by its dimension.
    """
    means = df.groupBy(label).agg(*[F.avg(F.get(F.col(vector), i)).alias(f"__d{i}") for i in range(dimensions)])
    vec = F.array(*[F.col(f"__d{i}") for i in range(dimensions)])
    named = means.select(label, vec.alias("__v"))
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return named.withColumn("__n", norm).select(
        label, F.when(F.col("__n") > 0, F.transform("__v", lambda x: x / F.col("__n"))).otherwise(F.col("__v"))
        .alias("centroid"))


def with_unclear(centroids: DataFrame, label: str, name, dimensions: int) -> DataFrame:
    """Centroids plus the all-zero row that stands for unclear input."""
    zero = centroids.sparkSession.range(1).select(
        F.lit(name).cast(centroids.schema[label].dataType).alias(label),
        F.array_repeat(F.lit(0.0), dimensions).alias("centroid"))
    return centroids.unionByName(zero)


def cosine(a: str | Column, b: str | Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda s, v: s + v)
    x, y = c(a), c(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def unit(v: str | Column) -> Column:
    """Vector scaled to length one; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c(v), lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def nearest_label(df: DataFrame, centroids: DataFrame, label: str, vector: str, keys: Sequence[str], *, thresholds: Mapping | None = None,
                  default_threshold: float = 0.55, blocked: Sequence = (), block: int = 256) -> DataFrame:
    """Best label by cosine, ``unknown`` under the label's threshold; ``keys`` name a row.

    Unit centroids travel in blocks of about ``block`` labels. A vector meets every
    block by an equality join, keeps its best label of each, then the best of all,
    so no number of labels is too many.
    """
    wanted = centroids.where(~F.col(label).isin(*blocked)) if blocked else centroids
    blocks = wanted.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int")).scalar()
    number = wanted.select(F.col(label), unit("centroid").alias("__u")).withColumn("__no", F.pmod(F.xxhash64(label), blocks).cast("int"))
    packed = number.groupBy("__no").agg(F.collect_list(F.struct(label, "__u")).alias("__cents"))
    one = df.select(*keys, unit(vector).alias("__v")).withColumn("__no", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def scored(x: Column) -> Column:
        dot = F.aggregate(F.zip_with("__v", x["__u"], lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
        return F.struct(dot.alias("score"), (-x[label] if _numeric(centroids, label) else x[label]).alias("neg"), x[label].alias("label"))

    best = one.join(packed, "__no").select(*keys, F.array_max(F.transform("__cents", scored)).alias("__b")).groupBy(*keys).agg(F.max("__b").alias("__best"))
    limit = F.lit(default_threshold)
    for name, value in (thresholds or {}).items():
        limit = F.when(F.col("__best.label") == name, value).otherwise(limit)
    known = F.col("__best.score") >= limit
    return df.join(best, list(keys), "left").withColumns({
        "score": F.col("__best.score"),
        "predicted": F.when(known, F.col("__best.label").cast("string")).otherwise("unknown"),
    }).drop("__best")


def _numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint", "float", "double")


# --- doses ---------------------------------------------------------------------------

# Doses per day by frequency word; limit factors.
TIMES_PER_DAY = {"od": 1, "qd": 1, "once daily": 1, "daily": 1, "bd": 2, "bid": 2, "twice daily": 2, "tds": 3,
                 "tid": 3, "three times daily": 3, "qid": 4, "four times daily": 4, "hs": 1, "night": 1,
                 "sos": 0, "prn": 0}
DAILY_FACTOR, DOSE_FACTOR = 4, 3.0


def times_per_day(frequency: str | Column) -> Column:
    f = F.lower(F.trim(F.coalesce(c(frequency), F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIMES_PER_DAY.items() for x in kv]), f), F.lit(1))


def suspicious_dose(dose: str | Column, frequency: str | Column, common_doses: str | Column) -> Column:
    """Not positive, or a daily total beyond what the usual doses explain."""
    limit = F.array_max(c(common_doses)) * DAILY_FACTOR * DOSE_FACTOR
    return (c(dose) <= 0) | F.coalesce(c(dose) * times_per_day(frequency) > limit, F.lit(False))


# Weights of the four parts and the two floors.
RECORD_WEIGHTS = {"drug_name": 0.4, "dose_amount": 0.2, "dose_unit": 0.2, "frequency": 0.2}
RECORD_FLOOR, NAME_FLOOR = 0.85, 0.80


def record_confidence(name: Column, name_conf: Column, dose: Column, dose_conf: Column, unit: Column, unit_conf: Column,
                      freq: Column, freq_conf: Column, suspicious: Column) -> dict[str, Column]:
    """Weighted confidence, unresolved fields and the resulting status."""
    open_dose = dose.isNull() | (dose_conf < 1.0)
    complete = (F.coalesce(name, F.lit("")) != "") & dose.isNotNull() & (F.coalesce(unit, F.lit("")) != "") \
        & (F.coalesce(freq, F.lit("")) != "")
    unresolved = F.array_compact(F.array(
        F.when((F.coalesce(name, F.lit("")) == "") | (name_conf < NAME_FLOOR), "drug_name"),
        F.when(open_dose | (complete & F.coalesce(suspicious, F.lit(False))), "dose_amount"),
        F.when(F.coalesce(unit, F.lit("")) == "", "dose_unit"),
        F.when(F.coalesce(freq, F.lit("")) == "", "frequency")))
    conf = F.round(name_conf * RECORD_WEIGHTS["drug_name"] + dose_conf * RECORD_WEIGHTS["dose_amount"]
                   + unit_conf * RECORD_WEIGHTS["dose_unit"] + freq_conf * RECORD_WEIGHTS["frequency"], 3)
    status = F.when((F.size(unresolved) == 0) & (conf >= RECORD_FLOOR), "interaction_pending").otherwise("suspicious")
    return {"confidence": conf, "unresolved": unresolved, "status": status}


# --- agreement of two classifiers ------------------------------------------------------

def shadow_sample(key: str | Column, percent: int) -> Column:
    """Repeatable sample by integer key: the same rows every time."""
    return F.pmod(c(key).cast("bigint"), F.lit(100)) < percent


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts with each first label's agreement rate."""
    conf = df.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count("*").alias("n"))
    per = W.partitionBy("label_a")
    same = F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).over(per)
    return conf.withColumn("agreement", F.round(same / F.sum("n").over(per), 4))


def context_flags(*, has_items: Column, repeated: Column, marker: Column, renal_relevant: Column, conditions: Column,
                  allergy: Column, abnormal_labs: Column, both_bleeding: Column) -> Column:
    """Sorted flag list ``category:state`` of one entity and pair of items."""
    renal = F.exists(conditions, lambda x: x.rlike("kidney|renal|ckd"))
    flags = F.array(
        F.when(~has_items, "medication_history:missing"),
        F.when(has_items & repeated, "duplicate_therapy:risk"),
        F.when(marker.isNull() & renal_relevant, "renal:missing"),
        F.when(marker < 30.0, "renal:risk"),
        F.when(F.size(conditions) == 0, "medical_history:missing"),
        F.when(renal, "renal:risk"),
        F.when(F.exists(conditions, lambda x: x.rlike("liver|hepatic")), "liver:risk"),
        F.when(F.exists(conditions, lambda x: x.contains("diabetes")), "diabetes:present"),
        F.when(F.exists(conditions, lambda x: x.rlike("hypertension|blood pressure") | (F.trim(x) == "bp")),
               "blood_pressure:present"),
        F.when(allergy, "allergy:risk"), F.when(abnormal_labs, "abnormal_labs:risk"),
        F.when(both_bleeding, "bleeding:risk"))
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


assert set(SEVERITY_RANK) == {"none", "low", "medium", "high", "critical"}
