"""Joins: rule pairs, suppression windows, as-of, containment, distance, tolerance.

No operator here forms the pairs of a group. Rule joins start from the rules,
suppression joins from per-bucket bounds, containment joins from equal pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import c, with_lengths, micros, normal_severity, pair_high, pair_low, severity_rank
from ..functions.neighbours import neighbour, running_sum
from ..session import written
from .containment import held_names

# --- unordered rule pairs ----------------------------------------------------


def canonical_rules(rules: DataFrame, a: str = "drug_a", b: str = "drug_b", severity: str = "severity",
                    payload: Sequence[str] = ()) -> DataFrame:
    """One row per unordered pair (``low``, ``high``): the strongest severity. No component pairs with itself."""
    keyed = rules.select(pair_low(a, b).alias("low"), pair_high(a, b).alias("high"),
                         normal_severity(severity).alias("severity"), *payload)
    row = F.struct("severity", *payload)
    return (keyed.where("low <> '' AND high <> '' AND low <> high").groupBy("low", "high")
            .agg(F.max_by(row, F.struct(severity_rank("severity"), *payload)).alias("__r"))
            .select("low", "high", "__r.*"))


def match_pairs(pairs: DataFrame, rules: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """Rule of each pair, either way round, by one equality join."""
    keyed = pairs.withColumns({"low": pair_low(a, b), "high": pair_high(a, b)})
    return keyed.join(rules, ["low", "high"], how)


def flagged_pairs(items: DataFrame, rules: DataFrame, entity: str, component: str) -> DataFrame:
    """Rule-flagged component pairs inside each entity, each pair once.

    ``rules`` come from :func:`canonical_rules`. Each distinct component of an
    entity is the lower one of its pairs and goes the shorter of two ways: it opens
    the rules that name it first, and the other component is looked up by (entity,
    component); or, where the entity holds no more components than that, it meets
    those and the pair is looked up in the rules. So a row costs the smaller of the
    two counts: neither many rules of a component nor many components of an entity
    multiply. Nothing is gathered per entity or per component. The components held
    and the rules are written once, since each is read several times.
    """
    held = written(items.select(F.col(entity), F.lower(F.trim(F.col(component))).alias("low")).where(
        F.col(entity).isNotNull() & F.col("low").isNotNull()).distinct(), "held-components")
    return _two_ways(held, written(rules, "pair-rules"), entity)


def _two_ways(held: DataFrame, rules: DataFrame, entity: str) -> DataFrame:
    """Pairs of :func:`flagged_pairs` for ``held`` (entity, low), which is read several times, as ``rules`` are."""
    rest = [x for x in rules.columns if x not in ("low", "high")]
    others = held.withColumnRenamed("low", "high")
    opens = rules.groupBy("low").agg(F.count("*").alias("__rules"))
    holds = held.groupBy(entity).agg(F.count("*").alias("__held")).where("__held > 1")
    sized = held.join(opens, "low").join(holds, entity)
    by_rule = (sized.where("__rules < __held").select(entity, "low").join(rules, "low")
               .join(others, [entity, "high"], "left_semi"))
    by_pair = (sized.where("__rules >= __held").select(entity, "low").join(others, entity).where("low < high")
               .join(rules, ["low", "high"]))
    return by_rule.select(entity, "low", "high", *rest).unionByName(by_pair.select(entity, "low", "high", *rest))


#: Components of an entity up to which each meets the others straight away.
FEW = 32


def held_once(items: DataFrame, entity: str, item: str, prescriber: str) -> DataFrame:
    """(entity, ``held``): one row per entity and distinct item, ``held`` being (item, n, n_rx, ...): its rows and those with
    a prescriber.

    Rows are dealt by the entity alone, once: grouping by the entity and more, and joins on the entity, go on from there.
    ``any_value`` and a condition that always holds keep Spark from moving a reader's filters and columns below that
    exchange, so all readers of one plan share it.
    """
    rows = items.where(F.col(entity).isNotNull()).select(entity, item, _has_rx(prescriber).alias("__rx")).repartition(entity)
    held = F.struct(item, F.count("*").alias("n"), F.sum("__rx").alias("n_rx"), F.any_value("__rx").alias("__any"))
    return rows.groupBy(entity, item).agg(held.alias("held")).where("held.n > 0").select(entity, "held")


def flagged_pairs_held(held: DataFrame, rules: DataFrame, entity: str, item: str) -> DataFrame:
    """:func:`flagged_pairs` for rows of :func:`held_once`, which are not dealt again.

    In an entity of ``FEW`` components at most, each meets those after it in order. Others go the two ways of
    :func:`flagged_pairs`.
    """
    rest, own = [x for x in rules.columns if x not in ("low", "high")], W.partitionBy(entity)
    low = held.select(entity, F.lower(F.trim(F.col(f"held.{item}"))).alias("low")).where("low IS NOT NULL").distinct()
    sized = low.withColumn("__held", F.count("*").over(own))
    after = F.collect_list("low").over(own.orderBy("low").rowsBetween(1, FEW))
    few = (sized.where(F.col("__held").between(2, FEW)).withColumn("high", after)
           .select(entity, "low", F.explode("high").alias("high")).join(rules, ["low", "high"]))
    many = sized.where(F.col("__held") > FEW).select(entity, "low")
    return few.select(entity, "low", "high", *rest).unionByName(_two_ways(many, rules, entity))


def _has_rx(prescriber: str) -> Column:
    return (F.trim(F.coalesce(F.col(prescriber).cast("string"), F.lit(""))) != "").cast("int")


def duplicates_held(held: DataFrame, entity: str, item: str, components: Column) -> DataFrame:
    """(entity, item, finding, severity): the distinct findings of :func:`duplicate_or_overlap` for rows of :func:`held_once`.

    A component is shared if the least and the greatest item that have it in the entity differ. Of an item's rows those
    without a prescriber are ``high`` if one row has it, those with one if two have it.
    """
    own, n, n_rx = W.partitionBy(entity, "__part"), F.col("n"), F.col("n_rx")
    parts = held.select(entity, "held.*").where(F.col(item).isNotNull()).withColumn("__part", F.explode_outer(F.array_distinct(components)))
    shared = F.col("__part").isNotNull() & (F.min(item).over(own) != F.max(item).over(own))
    found = parts.withColumn("__shared", shared).groupBy(entity, item).agg(
        F.max("n").alias("n"), F.max("n_rx").alias("n_rx"), F.bool_or("__shared").alias("__shared")).where("n > 1 OR __shared")
    high = F.when((n > 1) & (n_rx > 0), "high")
    medium = F.when((n == 1) | (n_rx < 2), "medium")
    return found.select(entity, item, F.when(n > 1, "duplicate").otherwise("overlap").alias("finding"),
                        F.explode(F.array_compact(F.array(high, medium))).alias("severity"))


def duplicate_or_overlap(items: DataFrame, entity: str, ident: str, item: str, prescriber: str,
                         components: Column) -> DataFrame:
    """Per item row: is the same item held again by the entity, or one sharing a
    component? ``high`` only for the same item with a prescriber on the other row.

    ``components`` is an array that depends on the item only. Counts per
    (entity, item) and bounds per (entity, component) answer this without
    comparing rows with rows; rows without a finding drop out before the last join.
    """
    rows = items.withColumns({"__rx": _has_rx(prescriber), "__parts": F.array_distinct(components)})
    same = rows.groupBy(entity, item).agg(F.count("*").alias("__n"), F.sum("__rx").alias("__n_rx"),
                                          F.any_value("__parts").alias("__parts"))
    parts = same.select(entity, item, F.explode("__parts").alias("__part"))
    shared = (parts.groupBy(entity, "__part").agg(F.min(item).alias("__lo"), F.max(item).alias("__hi"))
              .where(F.col("__lo") != F.col("__hi")).select(entity, "__part"))
    overlap = (parts.join(shared, [entity, "__part"]).groupBy(entity, item)
               .agg(F.array_sort(F.collect_set("__part")).alias("shared_components")))
    found = same.drop("__parts").join(overlap, [entity, item], "left").where("__n > 1 OR shared_components IS NOT NULL")
    dup = F.col("__n") > 1
    return rows.select(entity, ident, item, "__rx").join(found, [entity, item]).select(
        entity, ident, item,
        F.when(dup, "duplicate").otherwise("overlap").alias("finding"),
        F.when(dup & (F.col("__n_rx") - F.col("__rx") > 0), "high").otherwise("medium").alias("severity"),
        (F.col("__n") - 1).alias("duplicates"),
        F.coalesce("shared_components", F.array().cast("array<string>")).alias("shared_components"))


# --- suppression of recent repeats --------------------------------------------


def without_recent(rows: DataFrame, history: DataFrame, keys: Sequence[str], time: str, history_time: str,
                   within_seconds: float, *, ident: str | None = None, history_ident: str | None = None,
                   flag: str | None = None) -> DataFrame:
    """Rows with no equal-key history row in the last ``within_seconds``.

    Keys compare null-safe. With ``ident`` both sides are one table and a row's
    own entry and later ties do not count. History folds to its earliest and
    latest time per (key, bucket of that width): a row only has to look at its
    own bucket's earliest and the bucket before's latest. With ``flag`` all rows
    stay and a boolean column tells which are repeats.
    """
    width = int(within_seconds * 1_000_000)
    tie = ident is not None
    own = F.struct(micros(time).alias("t"), (c(ident) if tie else F.lit(0)).alias("i"))
    past = F.struct(micros(history_time).alias("t"), (c(history_ident or ident) if tie else F.lit(0)).alias("i"))
    null_safe = [F.struct(F.col(k).isNull().alias("n"), F.col(k).alias("v")) for k in keys]
    hist = (history.select(F.struct(*null_safe).alias("__k"), past.alias("__p"))
            .groupBy("__k", F.floor(F.col("__p.t") / width).alias("__b"))
            .agg(F.min("__p").alias("__first"), F.max("__p").alias("__last")))
    base = rows.withColumns({"__k": F.struct(*null_safe), "__own": own})
    base = base.withColumn("__b", F.floor(F.col("__own.t") / width))
    here = hist.select("__k", "__b", "__first")
    before = hist.select("__k", (F.col("__b") + 1).alias("__b"), "__last")
    seen = base.join(here, ["__k", "__b"], "left").join(before, ["__k", "__b"], "left")
    earlier = F.col("__first") < F.col("__own") if tie else F.col("__first.t") <= F.col("__own.t")
    recent = F.coalesce(earlier, F.lit(False)) | F.coalesce(
        F.col("__last.t") > F.col("__own.t") - width, F.lit(False))
    extra = ["__k", "__own", "__b", "__first", "__last"]
    if flag:
        return seen.withColumn(flag, recent).drop(*extra)
    return seen.where(~recent).drop(*extra)


def without_equal_work(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anti-join on earlier equal work."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def seen_since(rows: DataFrame, log: DataFrame, keys: Sequence[str], log_time: str, since: Column,
               flag: str) -> DataFrame:
    """Existence flag: the key was logged after ``since``."""
    recent = log.where(c(log_time) > since).select(*keys).distinct().withColumn(flag, F.lit(True))
    return rows.join(recent, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


# --- previous and nearest -----------------------------------------------------


def previous_value(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   out: str = "previous", slice_by: Column | None = None) -> DataFrame:
    """Latest earlier value of the same keys."""
    return (neighbour(rows, keys, order, [value], "__prev", slice_by=slice_by)
            .withColumn(out, F.col("__prev")[value]).drop("__prev"))


EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = F.radians(c(lat2) - c(lat1)), F.radians(c(lon2) - c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _cell(lat, lon, side_km: float) -> list[Column]:
    la, lo = F.radians(c(lat)), F.radians(c(lon))
    axes = [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]
    return [F.floor(a * EARTH_KM / side_km) for a in axes]


def nearest_within(points: DataFrame, places: DataFrame, ident: str, lat: str, lon: str, place: str,
                   place_lat: str, place_lon: str, radius_km: float = 7.0,
                   levels: Sequence[float] = (1 / 16, 1 / 4, 1.0)) -> DataFrame:
    """Nearest place of each point within the radius, null when there is none.

    Cells are cubes on the globe, so they work at every latitude. Places equal in
    position fold to one, and so do points. A point settles on the finest grid
    that holds a place closer than the cell side; only the rest go coarser.
    """
    spots = (places.groupBy(F.col(place_lat).alias("__plat"), F.col(place_lon).alias("__plon"))
             .agg(F.min(place).alias("__place")))
    todo = points.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).distinct()
    near = [F.array(*[F.lit(d) for d in (-1, 0, 1)])] * 3
    found = None
    for share in levels:
        side = radius_km * share
        x, y, z = _cell("__plat", "__plon", side)
        around = spots.select(
            "*", F.explode(F.transform(near[0], lambda d: x + d)).alias("__x")).select(
            "*", F.explode(F.transform(near[1], lambda d: y + d)).alias("__y")).select(
            "*", F.explode(F.transform(near[2], lambda d: z + d)).alias("__z"))
        x2, y2, z2 = _cell("__lat", "__lon", side)
        keyed = todo.withColumns({"__x": x2, "__y": y2, "__z": z2})
        km = haversine_km("__lat", "__lon", "__plat", "__plon")
        best = (keyed.join(around, ["__x", "__y", "__z"]).withColumn("__km", km).where(F.col("__km") <= side)
                .groupBy("__lat", "__lon")
                .agg(F.min(F.struct("__km", "__place")).alias("__best")))
        found = best if found is None else found.unionByName(best)
        todo = todo.join(best, ["__lat", "__lon"], "left_anti")
    out = points.join(found, (points[lat] == found["__lat"]) & (points[lon] == found["__lon"]), "left")
    return out.select(*[points[x] for x in points.columns], F.col("__best.__place").alias("nearest"),
                      F.col("__best.__km").alias("distance_km"))


# --- containment ----------------------------------------------------------------


def contained_names(rows: DataFrame, names: DataFrame, text: str, name: str, *, cap: int | None = None) -> DataFrame:
    """Rows × names where the lower-case name occurs in the text, longest first.

    Distinct texts are cut into pieces as long as the names are and matched by
    equality, so no nested loop runs. ``cap`` is the reference's top-k report.
    """
    vocab = names.withColumn("__n", F.lower(F.trim(F.col(name)))).where("__n <> ''")
    low = F.lower(F.trim(F.col(text)))
    texts = rows.select(low.alias("__t")).distinct()
    sized = with_lengths(texts, vocab, "__n", "__len").where(F.col("__len") <= F.length("__t"))
    starts = F.sequence(F.lit(1), F.length("__t") - F.col("__len") + 1)
    cut = sized.select("__t", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("__t", i, F.col("__len"))))).alias("__n"))
    hits = cut.join(vocab, "__n").withColumn(
        "match", F.when(F.col("__t") == F.col("__n"), "equal")
        .when(F.array_contains(F.split(F.replace("__t", F.lit("+"), F.lit(" ")), " +"), F.col("__n")), "token")
        .otherwise("substring"))
    if cap is not None:
        w = W.partitionBy("__t").orderBy(F.length("__n").desc(), "__n")
        hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return rows.withColumn("__t", low).join(hits.drop("__n"), "__t").drop("__t")


def by_alias(names: DataFrame, formulary: DataFrame, raw: str, canonical: str, aliases: str, uses: str,
             last_used: str) -> DataFrame:
    """Canonical name whose own name or alias equals the raw one, the most used first.

    The alias lists are exploded and reduced to one winner per alias once.
    """
    every = F.array_distinct(F.concat(F.array(F.lower(canonical)), F.transform(aliases, lambda x: F.lower(x))))
    best = (formulary.select(F.explode(every).alias("__alias"), canonical, uses, last_used)
            .groupBy("__alias").agg(F.max_by(canonical, F.struct(uses, last_used, canonical)).alias("canonical")))
    return names.join(best, F.lower(F.trim(F.col(raw))) == F.col("__alias"), "left").drop("__alias")


def herb_matches(pairs: DataFrame, herbs: DataFrame, a: str, b: str, *, loose: bool = False) -> DataFrame:
    """Herb/drug rule of a pair in either role, one rule kept; ``loose`` accepts a
    rule that names only one side."""
    if not loose:
        rules = canonical_rules(herbs, "herb_name", "drug_name", "severity")
        return match_pairs(pairs, rules, a, b, "left").drop("low", "high")
    row = F.struct("herb_name", "drug_name", "severity")
    named = herbs.select(F.explode(F.array_distinct(F.array(F.lower("herb_name"), F.lower("drug_name")))).alias("__n"),
                         row.alias("__r")).groupBy("__n").agg(F.min("__r").alias("__r"))
    one = named.select(F.col("__n").alias("__na"), F.col("__r").alias("__ra"))
    two = named.select(F.col("__n").alias("__nb"), F.col("__r").alias("__rb"))
    return (pairs.join(one, F.lower(F.col(a)) == F.col("__na"), "left")
            .join(two, F.lower(F.col(b)) == F.col("__nb"), "left")
            .withColumn("severity", F.coalesce(F.least("__ra", "__rb")["severity"]))
            .drop("__na", "__nb", "__ra", "__rb"))


# --- thresholds and conditions ----------------------------------------------------

# Items cleared by the kidney and the bands used when no rule exists.
RENAL_FALLBACK_ITEMS = ("metformin", "furosemide", "digoxin")
RENAL_BANDS = {"critical": 30.0, "warning": 45.0, "advisory": 60.0}


def renal_findings(items: DataFrame, rules: DataFrame, markers: DataFrame, conditions: DataFrame, *, entity: str,
                   item: str, marker: str = "egfr", fallback: Sequence[str] = RENAL_FALLBACK_ITEMS) -> DataFrame:
    """Marker bands per item.

    ``rules`` are (item, advisory_egfr, warning_egfr, critical_egfr,
    default_severity) already matched to items; ``markers`` hold the latest value
    per entity; ``conditions`` flag entities with a renal condition.
    """
    named = items.join(rules.withColumn("__rule", F.lit(True)), item, "left")
    on_list = F.lower(F.col(item)).isin(*fallback)
    joined = (named.join(markers, entity, "left").join(conditions, entity, "left")
              .withColumn("__renal", F.coalesce("has_renal", F.lit(False)))
              .withColumn("__known", F.col("__rule").isNotNull() | on_list))
    m = F.col(marker)
    crit = F.coalesce("critical_egfr", F.lit(RENAL_BANDS["critical"]))
    warn = F.coalesce("warning_egfr", F.lit(RENAL_BANDS["warning"]))
    adv = F.coalesce("advisory_egfr", F.lit(RENAL_BANDS["advisory"]))
    default = F.coalesce(normal_severity("default_severity"), F.lit("medium"))
    default = F.when(F.col("__rule").isNull(), F.lit("high")).otherwise(default)
    relevant = F.col("__known") | F.col("__renal")
    band = F.when(F.col("__known") & (m < crit), "critical").when(F.col("__known") & (m < warn), "high") \
        .when(F.col("__known") & (m < adv), default)
    kind = (F.when(m.isNull() & relevant, "renal_context_missing")
            .when(band.isNotNull(), "renal_clearance_warning")
            .when(F.col("__renal") & (m < 60), "renal_condition_context"))
    severity = (F.when(kind == "renal_context_missing", "high").when(kind == "renal_clearance_warning", band)
                .when(kind == "renal_condition_context", "medium"))
    return (joined.withColumns({"finding": kind, "severity": severity}).where("finding IS NOT NULL")
            .select(entity, item, "finding", "severity"))


# Items, condition substrings, severity. Allergy is handled apart.
CONDITION_RULES = (
    ("condition_rule", ("metformin",), ("kidney", "renal"), "high"),
    ("bleeding_condition_rule", ("warfarin", "aspirin", "clopidogrel", "apixaban", "rivaroxaban", "dabigatran",
                                 "heparin", "ibuprofen", "diclofenac", "naproxen"), ("bleed", "ulcer"), "high"),
    ("fall_risk_condition_rule", ("amlodipine", "telmisartan", "ramipril", "metoprolol", "furosemide",
                                  "ivabradine"), ("fall", "dizziness", "syncope"), "medium"),
    ("liver_condition_rule", ("atorvastatin", "rosuvastatin", "simvastatin", "methotrexate", "isoniazid",
                              "valproate"), ("liver", "hepatic"), "high"),
    ("pregnancy_condition_rule", ("warfarin", "telmisartan", "ramipril", "isotretinoin", "methotrexate"),
     ("pregnan",), "critical"),
    ("dehydration_condition_rule", ("furosemide",), ("dehydration",), "medium"),
)


def condition_findings(rows: DataFrame, item: str, condition: str, keys: Sequence[str],
                       rules: Sequence[tuple] = CONDITION_RULES, allergy: bool = True) -> DataFrame:
    """Findings for rows of (item, condition text): the rule list is a literal, so
    each row is tested in place, without a join."""
    i, text = F.lower(F.col(item)), F.lower(F.col(condition))
    made = []
    for name, items, needles, severity in rules:
        hit = i.isin(*items)
        any_needle = F.lit(False)
        for n in needles:
            any_needle = any_needle | text.contains(n)
        made.append(F.when(hit & any_needle, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))))
    if allergy:
        made.append(F.when(text.contains("allerg") & text.contains(i),
                           F.struct(F.lit("allergy_condition_rule").alias("rule"), F.lit("critical").alias("severity"))))
    return (rows.select(*keys, F.explode(F.array_compact(F.array(*made))).alias("__f"))
            .select(*keys, "__f.rule", "__f.severity").distinct())


# --- one-to-one tolerance join -------------------------------------------------------


def match_doses(doses: DataFrame, logs: DataFrame, keys: Sequence[str], dose_time: str, log_time: str,
                log_id: str, log_value: str, tolerance_seconds: int = 3 * 3600) -> DataFrame:
    """Greedy one-to-one match of expected doses and logs of the same keys.

    Doses take turns in time order; each takes the newest unused log within the
    tolerance. ``keys`` must hold the day, so a key has a handful of doses. Pairs
    come from buckets as wide as the tolerance, a dose keeps only as many newest
    candidates as its key has doses (no more can ever be reached), and the fold
    runs inside Spark's ``aggregate``.
    """
    width = tolerance_seconds * 1_000_000
    d = doses.withColumn("__d", micros(dose_time))
    d = d.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                                  lambda o: F.floor(F.col("__d") / width) + o)))
    log = logs.select(*keys, micros(log_time).alias("__l"), F.col(log_id).alias("__id"),
                      F.col(log_value).alias("__v"), F.floor(micros(log_time) / width).alias("__b"))
    counts = doses.groupBy(*keys).agg(F.countDistinct(dose_time).alias("__doses"))
    cand = (d.join(log, [*keys, "__b"]).where(F.abs(F.col("__d") - F.col("__l")) <= width)
            .join(counts, list(keys)))
    w = W.partitionBy(*keys, "__d").orderBy(F.col("__l").desc(), F.col("__id").desc())
    cand = cand.withColumn("__rn", F.row_number().over(w)).where("__rn <= __doses")
    per_dose = cand.groupBy(*keys, "__d").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("__l")).alias("s"), F.negative("__id").alias("n"), "__id", "__l", "__v"))).alias("__c"))
    per_key = per_dose.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__d", "__c"))).alias("__doses"))
    id_type = logs.schema[log_id].dataType.simpleString()
    v_type = logs.schema[log_value].dataType.simpleString()
    start = F.lit(None).cast(f"array<struct<d:bigint,id:{id_type},l:bigint,v:{v_type}>>")
    start = F.coalesce(start, F.array().cast(f"array<struct<d:bigint,id:{id_type},l:bigint,v:{v_type}>>"))

    def step(acc, dose):
        free = F.filter(dose["__c"], lambda x: ~F.exists(acc, lambda used: used["id"] == x["__id"]))
        pick = F.get(free, 0)
        row = F.struct(dose["__d"].alias("d"), pick["__id"].alias("id"), pick["__l"].alias("l"), pick["__v"].alias("v"))
        return F.when(pick.isNotNull(), F.concat(acc, F.array(row))).otherwise(acc)

    taken = (per_key.select(*keys, F.explode(F.aggregate("__doses", start, step)).alias("__m"))
             .select(*keys, F.col("__m.d").alias("__d"), F.col("__m.id").alias("matched_id"),
                     F.col("__m.v").alias("matched_value")))
    return doses.withColumn("__d", micros(dose_time)).join(taken, [*keys, "__d"], "left").drop("__d")


# --- claims against the other party's words ---------------------------------------------


def claim_conflicts(messages: DataFrame, keys: Sequence[str], order: str, role: str, text: str, claimant: str,
                    other: str, rules: Sequence[tuple[str, str, str]], keep: int = 3) -> DataFrame:
    """Up to ``keep`` newest earlier messages of the other party that contradict a claim.

    ``rules`` are (type, claim regex, contradiction regex). Contradicting messages
    are numbered per (keys, type); a claim looks up the last numbers by equality.
    """
    low = F.lower(F.col(text))
    tag = F.array_compact(F.array(*[
        F.when(((F.col(role) == claimant) & low.rlike(claim)) | ((F.col(role) == other) & low.rlike(contra)),
               F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind")))
        for n, (kind, claim, contra) in enumerate(rules)]))
    said = (messages.select(*keys, order, role, F.explode(tag).alias("__t"))
            .select(*keys, order, role, "__t.n", "__t.kind"))
    group = [*keys, "n"]
    numbered = running_sum(said, group, [order], (F.col(role) == other).cast("int"), "__seq",
                           F.floor(F.col(order) / 1000))
    contra = numbered.where(F.col(role) == other).select(*group, "__seq", F.col(order).alias("contradicted_by"))
    claims = (numbered.where((F.col(role) == claimant) & (F.col("__seq") > 0))
              .withColumn("__last", F.col("__seq"))
              .withColumn("__seq", F.explode(F.sequence(F.greatest(F.col("__last") - (keep - 1), F.lit(1)), "__last"))))
    hits = claims.join(contra, [*group, "__seq"])
    w = W.partitionBy(*keys, order).orderBy(F.col("contradicted_by").desc(), "n")
    return (hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
            .select(*keys, F.col(order).alias("claimed_at"), "kind", "contradicted_by", "rank"))


@dataclass(frozen=True)
class Tier:
    """A step of name resolution: ``key`` of the table equals the name, or also stands ``inside`` it, or ``either`` in the other."""

    table: DataFrame
    key: str
    value: str
    confidence: float
    label: str
    match: str = "equal"


# Fixed value: amounts that are no part of a name.
STRENGTH = r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|units?)\b"


def without_strength(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), STRENGTH, ""), r"^[ .:\-]+|[ .:\-]+$", "")


def first_tier(names: DataFrame, tiers: Sequence[Tier], raw: str, default_confidence: float = 0.5) -> DataFrame:
    """Resolve distinct names by tiers; the first tier that hits wins, else the raw name at ``default_confidence``.

    Inside a tier the longest key wins, then the smaller one. Names inside names meet by rare pieces.
    """
    distinct = names.select(F.lower(F.trim(F.col(raw))).alias("__raw")).distinct()
    picks, out = [], distinct
    for n, tier in enumerate(tiers):
        known = tier.table.select(F.lower(F.trim(F.col(tier.key))).alias("__key"), F.col(tier.value).alias("__v")).where("__key <> ''").groupBy("__key").agg(F.min("__v").alias("__v"))
        if tier.match == "equal":
            pairs = distinct.join(known, distinct["__raw"] == known["__key"])
        else:
            pairs = held_names(known, distinct, "__key", "__raw")
            if tier.match == "either":
                pairs = pairs.unionByName(held_names(distinct, known, "__raw", "__key"))
            pairs = pairs.join(known, "__key")
        one = pairs.groupBy("__raw").agg(F.min(F.struct(F.negative(F.length("__key")).alias("n"), "__key", "__v")).alias("__b")).select("__raw", F.col("__b.__v").alias(f"__v{n}"))
        out = out.join(one, "__raw", "left")
        picks.append(F.when(F.col(f"__v{n}").isNotNull(), F.struct(
            F.col(f"__v{n}").alias("name"), F.lit(tier.confidence).alias("confidence"), F.lit(tier.label).alias("tier"))))
    rest = F.struct(F.col("__raw").alias("name"), F.lit(default_confidence).alias("confidence"),
                    F.lit("raw").alias("tier"))
    done = out.withColumn("__r", F.coalesce(*picks, rest)).select("__raw", "__r.*")
    return names.withColumn("__raw", F.lower(F.trim(F.col(raw)))).join(done, "__raw").drop("__raw")
