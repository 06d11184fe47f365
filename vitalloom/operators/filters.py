"""Projections, filters and row predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, first_match, has_word, with_lengths, nonblank, seconds, substring_pattern, ts, ts_plus

# Fixed values -------------------------------------------------------------
# Vital thresholds that age and condition may shift.
VITAL_RULES = {
    "bp": {"critical": (180, 120), "advisory": (140, 90)},
    "glucose": {"critical_high": 250, "critical_low": 70, "advisory_high": 180},
    "pulse": {"critical_high": 120, "critical_high_older": 115, "critical_low": 50,
              "advisory_high": 100, "advisory_low": 60},
    "spo2": {"critical_low": 90, "advisory_low": 95, "advisory_low_copd": 92},
    "temperature": {"critical_high": 39.0, "critical_high_older": 38.8, "advisory_high": 38.0},
}
# Lowest and highest value a lab result can have.
PHYSICAL_LIMITS = {
    "creatinine": (0.1, 30.0),
    "glucose": (10.0, 800.0),
    "hba1c": (3.0, 20.0),
    "sodium": (100.0, 180.0),
    "potassium": (1.5, 9.0),
    "wbc": (0.1, 100.0),
    "platelets": (5.0, 1500.0),
    "tsh": (0.001, 100.0),
    "cholesterol": (50.0, 700.0),
}
# Hours of the day per bucket, both ends included; night wraps.
HOUR_BUCKETS = {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 21), "night": (22, 5)}
# --------------------------------------------------------------------------


def status_in(col: str | Column, statuses: Iterable[str]) -> Column:
    return F.lower(c(col)).isin(*[s.lower() for s in statuses])


def in_range(col: str | Column, start=None, end=None) -> Column:
    """Half-open ``[start, end)``; a missing bound is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c(col) >= ts(start))
    if end is not None:
        cond = cond & (c(col) < ts(end))
    return cond


def look_ahead(col: str | Column, as_of, *, open_start: bool = False, closed_end: bool = False,
               **span) -> Column:
    """``[as_of, as_of+span)``, or ``(as_of, as_of+span]`` for reminders."""
    lower = c(col) > ts(as_of) if open_start else c(col) >= ts(as_of)
    upper = c(col) <= ts_plus(as_of, **span) if closed_end else c(col) < ts_plus(as_of, **span)
    return lower & upper


def fresh(col: str | Column, as_of, **span) -> Column:
    """Newer than ``as_of - span``."""
    return c(col) > ts_plus(as_of, **{k: -v for k, v in span.items()})


def lookup_by_prefix(df: DataFrame, probes: DataFrame, key: str, probe: str, order: str) -> DataFrame:
    """Best row per probe: exact match first, else newest prefix match; flags ambiguity.

    Probes are cut to their own lengths and matched by equality on that prefix,
    a cut for each distinct length, so no nested loop runs.
    """
    wanted = probes.select(F.col(probe).alias("__probe")).distinct()
    keyed = (with_lengths(df, probes, probe, "__len").where(F.col("__len") <= F.length(key))
             .withColumn("__cut", F.substring(F.col(key), F.lit(1), F.col("__len"))).drop("__len"))
    hits = keyed.join(wanted, F.col("__cut") == F.col("__probe")).drop("__cut")
    rank = F.struct((F.col(key) == F.col("__probe")).cast("int"), F.col(order), F.col(key))
    return (hits.groupBy(F.col("__probe").alias(probe))
            .agg(F.max_by(F.struct(*df.columns), rank).alias("__row"),
                 F.max((F.col(key) == F.col("__probe")).cast("int")).alias("__exact"),
                 F.count("*").alias("__n"))
            .select(probe, "__row.*", (F.col("__exact") == 1).alias("exact"),
                    (F.col("__n") > 1).alias("ambiguous")))


def lifecycle_state(used_at: str | Column, expires_at: str | Column, as_of) -> Column:
    return (F.when(c(used_at).isNotNull(), "used")
            .when(c(expires_at) < ts(as_of), "expired").otherwise("valid"))


def range_severity(test: str | Column, value: str | Column, low: str | Column, high: str | Column,
                   critical_tests: Sequence[str] = ("spo2", "blood_pressure_systolic")) -> Column:
    """``normal`` in range or without one; outside it critical for the listed tests."""
    out = (c(value) < c(low)) | (c(value) > c(high))
    worst = F.when(F.lower(c(test)).isin(*critical_tests), "critical").otherwise("advisory")
    return F.when(F.coalesce(out, F.lit(False)), worst).otherwise("normal")


def vital_severity(test: str | Column, value: str | Column, secondary: str | Column | None = None,
                   older: Column | None = None, copd: Column | None = None) -> Column:
    """Severity from fixed thresholds, shifted for age 65+ and for COPD."""
    t, v = c(test), c(value)
    s = F.lit(None).cast("double") if secondary is None else c(secondary)
    older = F.coalesce(older, F.lit(False)) if older is not None else F.lit(False)
    copd = F.coalesce(copd, F.lit(False)) if copd is not None else F.lit(False)
    bp, gl, pu, ox, te = (VITAL_RULES[k] for k in ("bp", "glucose", "pulse", "spo2", "temperature"))
    rules = [
        ((t == "bp") & s.isNotNull() & ((v >= bp["critical"][0]) | (s >= bp["critical"][1])), "critical"),
        ((t == "bp") & s.isNotNull() & ((v >= bp["advisory"][0]) | (s >= bp["advisory"][1])), "advisory"),
        ((t == "glucose") & ((v >= gl["critical_high"]) | (v < gl["critical_low"])), "critical"),
        ((t == "glucose") & (v >= gl["advisory_high"]), "advisory"),
        ((t == "pulse") & ((v >= F.when(older, pu["critical_high_older"]).otherwise(pu["critical_high"]))
                           | (v < pu["critical_low"])), "critical"),
        ((t == "pulse") & ((v >= pu["advisory_high"]) | (v < pu["advisory_low"])), "advisory"),
        ((t == "spo2") & (v < ox["critical_low"]), "critical"),
        ((t == "spo2") & (v < F.when(copd, ox["advisory_low_copd"]).otherwise(ox["advisory_low"])), "advisory"),
        ((t == "temperature") & (v >= F.when(older, F.lit(te["critical_high_older"]))
                                 .otherwise(F.lit(te["critical_high"]))), "critical"),
        ((t == "temperature") & (v >= te["advisory_high"]), "advisory"),
    ]
    return first_match(rules, "normal")


# Plausible ranges of counts by the unit they are given in.
UNIT_LIMITS = (("wbc", "/cumm", 1000, 50000), ("platelets", "lakh", 0.5, 10),
               ("platelets", "cumm", 50000, 1000000))
# Lab names the record knows.
KNOWN_LABS = (
    "creatinine", "glucose", "hba1c", "free_t3", "free_t4", "hemoglobin", "sodium", "potassium",
    "wbc", "platelets", "tsh", "cholesterol", "pulse", "spo2", "temperature",
    "blood_pressure_systolic", "blood_pressure_diastolic", "estimated_average_glucose",
    "neutrophils", "lymphocytes", "eosinophils", "monocytes", "basophils", "rbc", "hematocrit",
    "mcv", "mch", "mchc", "rdw", "hdl_cholesterol", "ldl_cholesterol", "vldl_cholesterol",
    "triglycerides", "cholesterol_hdl_ratio", "blood_urea", "egfr", "bun_creatinine_ratio",
    "bilirubin", "sgot_ast", "sgpt_alt", "alkaline_phosphatase", "total_protein", "albumin",
    "globulin", "albumin_globulin_ratio",
)


def physical_limit_ok(test: str | Column, value: str | Column,
                      limits: Mapping[str, tuple[float, float]] = PHYSICAL_LIMITS) -> Column:
    """Within the limits kept for exactly this test name; other tests pass."""
    t, v = c(test), c(value)
    rules = [(t == name, v.between(low, high)) for name, (low, high) in limits.items()]
    return F.coalesce(first_match(rules, F.lit(True)), F.lit(False))


def plausible_lab(test: str | Column, value: str | Column, unit: str | Column | None = None,
                  limits: Mapping[str, tuple[float, float]] = PHYSICAL_LIMITS,
                  known: Sequence[str] = KNOWN_LABS) -> Column:
    """A known lab name whose value fits its unit's range, else its physical limits."""
    t, v = F.lower(F.trim(c(test))), c(value).cast("double")
    u = F.lower(F.coalesce(c(unit), F.lit(""))) if unit is not None else F.lit("")
    rules = [((t == n) & u.contains(w), v.between(lo, hi)) for n, w, lo, hi in UNIT_LIMITS]
    named = known_lab(t, known)
    rules += [(t.contains(n), v.between(lo, hi) & named) for n, (lo, hi) in limits.items()]
    return F.coalesce(first_match(rules, named), F.lit(False))


def known_lab(test: str | Column, names: Sequence[str] = KNOWN_LABS) -> Column:
    return c(test).rlike(substring_pattern(names))


def include_exclude(columns: Sequence[str | Column], include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Rows with an include term and no exclude term: words on word bounds,
    phrases as substrings, over all columns joined."""
    text = F.lower(F.concat_ws(" ", *[c(x) for x in columns]))
    def hit(terms):
        words = [t.lower() for t in terms if " " not in t]
        phrases = [t.lower() for t in terms if " " in t]
        cond = F.lit(False)
        if words:
            cond = cond | has_word(text, words)
        if phrases:
            cond = cond | text.rlike(substring_pattern(phrases))
        return cond
    return (hit(include) if include else F.lit(True)) & (~hit(exclude) if exclude else F.lit(True))


def category(columns: Sequence[str | Column], terms: Sequence[str], yes: str, no: str) -> Column:
    """Two-way split by word match over the joined columns."""
    return F.when(has_word(F.lower(F.concat_ws(" ", *[c(x) for x in columns])), terms), yes).otherwise(no)


# Texts that are instructions rather than item names.
INSTRUCTION_PHRASES = ("do not exceed", "after food", "before food", "with food", "empty stomach",
                       "review after", "follow up", "avoid heavy")
INSTRUCTION_PREFIXES = ("do not ", "avoid ", "follow ", "review ")


def researchable_name(name: str | Column, phrases: Sequence[str] = INSTRUCTION_PHRASES,
                      prefixes: Sequence[str] = INSTRUCTION_PREFIXES) -> Column:
    """At least three characters, a run of three letters, not an instruction."""
    n = F.lower(F.trim(c(name)))
    bad = n.isin(*phrases)
    for p in prefixes:
        bad = bad | n.startswith(p)
    return F.coalesce((F.length(n) >= 3) & n.rlike("[a-z]{3}") & ~bad, F.lit(False))


def hour_bucket(hour: str | Column) -> Column:
    h = c(hour)
    return (F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon")
            .when(h.between(18, 21), "evening").otherwise("night"))


def hour_in_bucket(hour: str | Column, bucket: str | Column) -> Column:
    h, b = c(hour), c(bucket)
    cond = F.lit(False)
    for name, (start, end) in HOUR_BUCKETS.items():
        inside = h.between(start, end) if start <= end else (h >= start) | (h <= end)
        cond = cond | ((b == name) & inside)
    return cond


def minute_of_day(hhmm: str | Column) -> Column:
    parts = F.split(c(hhmm), ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def scheduled_in_bucket(items: DataFrame, times: str, bucket: Column, as_of_col: str, is_now: Column,
                        keys: Sequence[str]) -> DataFrame:
    """Items with a dose in the bucket (or within two hours for ``is_now``), and the
    next such dose of the day. Works inside each row's own array, without a shuffle."""
    now_min = F.hour(as_of_col) * 60 + F.minute(as_of_col)
    now_sec = now_min * 60 + F.second(as_of_col)
    mins = F.transform(F.col(times), lambda t: minute_of_day(t))
    match = F.filter(mins, lambda m: F.when(is_now, F.abs(m * 60 - now_sec) <= 7200)
                     .otherwise(hour_in_bucket(F.floor(m / 60), bucket)))
    out = items.withColumn("__hit", match).where(F.size("__hit") > 0)
    future = F.array_min(F.filter("__hit", lambda m: m * 60 >= now_sec))
    label = F.when(future.isNotNull(), F.concat(
        F.lpad(F.floor(future / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((future % 60).cast("string"), 2, "0")))
    return out.select(*keys, label.alias("next_dose"), F.size("__hit").alias("matched"))


def due_now(times: str | Column, minute: Column, within: int = 30) -> Column:
    """Any scheduled time within ``within`` minutes around the clock."""
    def near(t):
        gap = F.abs(minute_of_day(t) - minute)
        return F.least(gap, 1440 - gap) <= within
    return F.coalesce(F.exists(c(times), near), F.lit(False))


def coalesce_blank(*cols: str | Column) -> Column:
    """First non-blank text."""
    return F.coalesce(*[nonblank(x) for x in cols])
