"""Aggregations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import lookup, ts
from ..operators import aggregates as a
from ..operators import joins as j
from ..registry import Tables, query, sql_values
from .joins import DOSES_SQL, ITEMS_CTE, RULES_CTE, SEV, dose_logs, expected_doses, held_items, part_rules
from .records import EVENTS_AS_OF, ORDERS_AS_OF

PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "advisory", "5-LOW": "low"}
PRIORITY_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'advisory' "
                "WHEN '5-LOW' THEN 'low' ELSE 'odd' END")


def alerts(t: Tables):
    """Orders read as alerts of a customer."""
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", F.coalesce(
        lookup("o_orderpriority", PRIORITY_SEVERITY), F.lit("odd")).alias("severity"))


@query("a1_filtered_count", """
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_totalprice > 300000) AS review
FROM orders GROUP BY 1""")
def a1(t: Tables):
    return a.filtered_counts(t.orders, ["o_custkey"], {"pending": F.col("o_orderstatus") == "P",
                                                       "review": F.col("o_totalprice") > 300000})


@query("a2_count_and_latest", f"""
SELECT user_id, event_type, count(*) AS n, max(ts) AS latest FROM events
WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1, 2""")
def a2(t: Tables):
    rows = t.events.where((F.col("ts") > ts("2024-01-13 00:00:00")) & (F.col("ts") <= ts(EVENTS_AS_OF)))
    return a.count_and_latest(rows, ["user_id", "event_type"], "ts")


@query("a3_status_histogram", """
SELECT o_orderpriority, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def a3(t: Tables):
    return a.status_histogram(t.orders, ["o_orderpriority"], F.nullif(F.col("o_orderstatus"), F.lit("P")))


@query("a4_severity_pivot", f"""
SELECT o_custkey, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high,
  count(*) FILTER (s NOT IN ('critical', 'high', 'low')) AS medium, count(*) FILTER (s = 'low') AS low
FROM (SELECT o_custkey, {PRIORITY_SQL} AS s FROM orders) GROUP BY 1""")
def a4(t: Tables):
    return a.severity_pivot(alerts(t), ["o_custkey"], "severity")


@query("a5_worst_severity", f"""
SELECT o_custkey, (['low','medium','high','critical'])[max(CASE s WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END)] AS max_severity
FROM (SELECT o_custkey, {PRIORITY_SQL} AS s FROM orders) GROUP BY 1""")
def a5(t: Tables):
    return a.worst_severity(alerts(t), ["o_custkey"], "severity")


@query("a6_vote_escalation", """
WITH p AS (SELECT DISTINCT user_id % 40 AS a, user_id % 7 AS b, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS severity FROM events),
v AS (SELECT 'x' || (user_id % 40) AS a, 'y' || (user_id % 7) AS b, CASE WHEN event_type IN ('click', 'view') AND user_id % 4 <> 0 THEN 'vetoed' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'approved' ELSE 'other' END AS o FROM events),
t AS (SELECT a, b, count(*) AS n, count(*) FILTER (o = 'approved') AS ap, count(*) FILTER (o = 'vetoed') AS ve FROM v GROUP BY 1, 2)
SELECT 'y' || p.b AS a, 'X' || p.a AS b, coalesce(severity, 'none') AS base,
  CASE WHEN n >= 3 AND ve > ap AND ve / (ve + ap) >= 0.8 THEN 'critical' ELSE coalesce(severity, 'none') END AS learned_severity
FROM p LEFT JOIN t ON t.a = 'x' || p.a AND t.b = 'y' || p.b""")
def a6(t: Tables):
    u = F.col("user_id")
    x, y = F.concat(F.lit("x"), (u % 40).cast("string")), F.concat(F.lit("y"), (u % 7).cast("string"))
    votes = t.events.select(x.alias("a"), y.alias("b"), F.when(
        F.col("event_type").isin("click", "view") & (u % 4 != 0), "vetoed").when(
        (F.col("event_type") == "error") & (u % 2 == 0), "approved").otherwise("other").alias("outcome"))
    pairs = t.events.select(y.alias("a"), F.upper(x).alias("b"), F.when(u % 3 == 0, "high").when(
        u % 3 == 1, "low").alias("severity")).distinct()
    return a.escalate_by_votes(pairs, votes, "a", "b", "severity", "outcome").select(
        "a", "b", F.coalesce("severity", F.lit("none")).alias("base"), "learned_severity")


ADHERENCE_AS_OF = "2024-01-20 12:00:00"
ADHERENCE_SQL = f"""
m AS (SELECT d.user_id, d.day, d.dose_at, any_value(x.kind) AS kind FROM doses d LEFT JOIN (
   SELECT user_id, dose_at, arg_max(CASE WHEN event_type = 'error' THEN 'missed' ELSE event_type END, ts) AS kind FROM doses JOIN events e USING (user_id)
   WHERE e.ts::DATE = day AND e.ts BETWEEN dose_at - INTERVAL 3 HOUR AND dose_at + INTERVAL 3 HOUR GROUP BY 1, 2) x USING (user_id, dose_at) GROUP BY ALL),
adh AS (SELECT user_id, day, count(*) AS total_scheduled, count(*) FILTER (kind <> 'missed') AS taken, count(*) FILTER (kind = 'missed') AS missed,
   count(*) FILTER (kind IS NULL) AS pending, bool_or(kind IS NULL AND dose_at < TIMESTAMP '{ADHERENCE_AS_OF}' - INTERVAL 24 HOUR) AS gap_detected,
   min(CASE WHEN dose_at > TIMESTAMP '{ADHERENCE_AS_OF}' AND day = DATE '{ADHERENCE_AS_OF[:10]}' THEN dose_at END) AS next_dose FROM m GROUP BY 1, 2)"""


def adherence(t: Tables):
    logs = dose_logs(t).withColumn("kind", F.when(F.col("event_type") == "error", "missed").otherwise(F.col("event_type")))
    matched = j.match_doses(expected_doses(t), logs, ["user_id", "day"], "dose_at", "ts", "event_id", "kind")
    return a.adherence_snapshot(matched, logs, ["user_id", "day"], "dose_at", "matched_value", "ts", ts(ADHERENCE_AS_OF))


@query("a7_adherence_snapshot", f"""
WITH {DOSES_SQL}, {ADHERENCE_SQL}
SELECT user_id, day::VARCHAR AS day, total_scheduled, taken, missed, pending, gap_detected, coalesce(strftime(next_dose, '%H:%M'), '') AS next_dose,
  0.9::DOUBLE AS confidence FROM adh""")
def a7(t: Tables):
    return adherence(t).select("user_id", F.col("day").cast("string").alias("day"), "total_scheduled", "taken", "missed", "pending",
                               "gap_detected", F.coalesce(F.date_format("next_dose", "HH:mm"), F.lit("")).alias("next_dose"), "confidence")


SOURCES = {"view": "rxnav", "click": "openfda", "error": "pubmed", "purchase": "local_drug_interactions", "signup": "herb_checker"}
SOURCE_SQL = ("CASE event_type WHEN 'view' THEN 'rxnav' WHEN 'click' THEN 'openfda' WHEN 'error' THEN 'pubmed' "
              "WHEN 'purchase' THEN 'local_drug_interactions' ELSE 'herb_checker' END")
EV_SQL = f"""
ev AS (SELECT user_id * 40 + CAST(floor(value) AS BIGINT) % 40 AS rule_id, {SOURCE_SQL} AS source, CASE WHEN event_id % 4 = 0 THEN 'no_data' ELSE 'ok' END AS status,
  (['none','low','medium','high','critical'])[event_id % 5 + 1] AS severity, event_id % 5 AS rank, event_id % 3 AS pieces FROM events)"""


def evidence(t: Tables):
    """Events read as evidence rows of a rule."""
    return t.events.select(
        (F.col("user_id") * 40 + F.floor("value") % 40).alias("rule_id"), lookup("event_type", SOURCES).alias("source"),
        F.when(F.col("event_id") % 4 == 0, "no_data").otherwise("ok").alias("status"),
        F.element_at(F.array(*[F.lit(s) for s in ("none", "low", "medium", "high", "critical")]),
                     (F.col("event_id") % 5 + 1).cast("int")).alias("severity"),
        (F.col("event_id") % 3).alias("pieces"))


@query("a8_evidence_merge", f"""
WITH {EV_SQL} SELECT rule_id, (['none','low','medium','high','critical'])[max(rank) + 1] AS severity,
  string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ev WHERE status = 'ok' GROUP BY 1""")
def a8(t: Tables):
    out = a.merge_evidence(evidence(t), ["rule_id"], "source", "status", "severity")
    return out.select("rule_id", "severity", F.array_join("sources_checked", ",").alias("sources"))


VERIFY_SQL = f"""
WITH {EV_SQL}, s AS (SELECT rule_id, bool_or(source IN ('rxnav', 'openfda') AND status = 'ok' AND pieces > 0) AS d,
  bool_or(source = 'pubmed' AND pieces > 0) AS l FROM ev GROUP BY 1),
r AS (SELECT DISTINCT rule_id, CASE rule_id % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 ELSE 0.72 END AS prior FROM ev)
SELECT rule_id, CASE WHEN d THEN greatest(prior, 0.88) WHEN l THEN greatest(prior, 0.70) ELSE least(prior, 0.55) END::DOUBLE AS confidence_score,
  CASE WHEN d THEN 'live_verified' ELSE 'review_required' END AS verification_status,
  CASE WHEN d THEN 'direct_live_evidence' WHEN l THEN 'literature_only_needs_review' ELSE 'no_external_confirmation' END AS reason FROM r JOIN s USING (rule_id)"""


@query("a9_rule_verification", VERIFY_SQL)
def a9(t: Tables):
    ev = evidence(t)
    k = F.col("rule_id") % 4
    rules = ev.select("rule_id").distinct().withColumn(
        "prior", F.when(k == 1, 0.5).when(k == 2, 0.9).when(k == 3, 0.72))
    return a.verify_rules(rules, ev, ["rule_id"], "source", "status", "pieces", "prior", ["rxnav", "openfda"], ["pubmed"]).select(
        "rule_id", "confidence_score", "verification_status", "reason")


SCORE_CTE = """
sc AS (SELECT rule_id, count(*) AS n, count(*) FILTER (source <> 'pubmed') AS firm, coalesce(max(rank) FILTER (source <> 'pubmed'), 0) AS rank,
   list(DISTINCT source) AS sources FROM ev GROUP BY 1),
scored AS (SELECT rule_id, n AS evidence_count, rank, (['none','low','medium','high','critical'])[rank + 1] AS severity, sources,
   round(least(CASE WHEN rank = 0 THEN 0.45 ELSE 0.95 END, 0.35::DOUBLE + firm * 0.2::DOUBLE + n * 0.1::DOUBLE), 2) AS confidence FROM sc)"""


@query("a10_evidence_score", f"WITH {EV_SQL}, {SCORE_CTE} SELECT rule_id, evidence_count, severity, confidence FROM scored")
def a10(t: Tables):
    return a.score_evidence(evidence(t), ["rule_id"], "source", "severity")


REQUIRED_TWO = ("rxnav", "openfda")


def gated(t: Tables):
    ev = evidence(t)
    tried = ev.groupBy("rule_id").agg(F.collect_set("source").alias("tried"))
    scored = a.score_evidence(ev, ["rule_id"], "source", "severity").join(tried, "rule_id")
    return a.safety_gates(
        scored, evidence=F.col("evidence_count") > 0, context=F.col("rule_id") % 9 != 0, attempted=F.col("tried"),
        summary=[F.lit("risk"), F.when(F.col("rule_id") % 11 != 0, "why"), F.lit("do")], conditions=F.col("rule_id") % 7 != 0,
        severity=F.col("severity"), confidence=F.col("confidence"), required=REQUIRED_TWO)


GATES_SQL = f"""
WITH {EV_SQL}, {SCORE_CTE},
g AS (SELECT rule_id, severity, confidence, evidence_count > 0 AS evidence, rule_id % 9 <> 0 AS context,
  list_contains(sources, 'rxnav') AND list_contains(sources, 'openfda') AS tool_ledger, rule_id % 11 <> 0 AS three_part_summary,
  rule_id % 7 <> 0 AS contraindications, TRUE AS critic, confidence >= 0.75 AS confidence_gate FROM scored),
gates AS (SELECT *, evidence AND context AND tool_ledger AND three_part_summary AND contraindications AND critic AND confidence_gate AS all_passed FROM g)"""


@query("a11_safety_gates", f"{GATES_SQL} SELECT rule_id, context, tool_ledger, three_part_summary, contraindications, critic, confidence_gate, all_passed FROM gates")
def a11(t: Tables):
    return gated(t).select("rule_id", "context", "tool_ledger", "three_part_summary", "contraindications", "critic",
                           "confidence_gate", "all_passed")


@query("a12_promotion_split", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'gates_failed' WHEN conf < 0.75 THEN 'low_confidence' WHEN p = '5-LOW' THEN 'no_interaction'
  WHEN p = '1-URGENT' THEN 'pending_human_approval' WHEN p = '2-HIGH' THEN 'pending_veto' ELSE 'severity_not_promotable' END AS state
FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_totalprice / 500000 AS conf FROM orders) o
WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderpriority = o.p)""")
def a12(t: Tables):
    sev = F.coalesce(lookup("o_orderpriority", {"1-URGENT": "critical", "2-HIGH": "high", "5-LOW": "none"}), F.lit("medium"))
    decided = t.orders.where("o_orderstatus = 'F'")
    todo = j.without_equal_work(t.orders, decided, ["o_custkey", "o_orderpriority"])
    return todo.select("o_orderkey", a.promotion_state(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 500000, sev).alias("state"))


def card_columns():
    k = F.col("c_custkey")
    return {"missing_caregiver_contacts": k % 2 == 0, "missing_doctor_phone": k % 3 == 0, "missing_hospital_map": k % 5 == 0,
            "missing_hospital_phone": k % 7 == 0, "missing_patient_location": F.col("c_nationkey") < 5,
            "missing_active_medications": F.col("n").isNull(), "missing_recent_medication_log": F.coalesce("n", F.lit(0)) < 8}


CARD_SQL = """
SELECT c_custkey, 100 - 25 * (c_custkey % 2 = 0)::INT - 15 * (c_custkey % 3 = 0)::INT - 15 * (c_custkey % 5 = 0)::INT - 10 * (c_custkey % 7 = 0)::INT
  - 20 * (c_nationkey < 5)::INT - 10 * (n IS NULL)::INT - 5 * (coalesce(n, 0) < 8)::INT AS score,
  array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'missing_caregiver_contacts' END, CASE WHEN c_custkey % 3 = 0 THEN 'missing_doctor_phone' END,
   CASE WHEN c_custkey % 5 = 0 THEN 'missing_hospital_map' END, CASE WHEN c_custkey % 7 = 0 THEN 'missing_hospital_phone' END,
   CASE WHEN c_nationkey < 5 THEN 'missing_patient_location' END, CASE WHEN n IS NULL THEN 'missing_active_medications' END,
   CASE WHEN coalesce(n, 0) < 8 THEN 'missing_recent_medication_log' END], lambda x: x IS NOT NULL), ',') AS issues
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


@query("a13_completeness_score", f"""
SELECT c_custkey, score, issues, CASE WHEN score >= 85 THEN 'ready' WHEN score >= 60 THEN 'usable_needs_review' ELSE 'incomplete' END AS band FROM ({CARD_SQL})""")
def a13(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    cols = a.completeness(card_columns())
    return t.customer.join(n, "c_custkey", "left").select(
        "c_custkey", cols["score"].alias("score"), F.array_join(cols["issues"], ",").alias("issues"), cols["band"].alias("band"))


def rollup_base(t: Tables):
    """One row per customer with the pre-aggregates the status rollup needs."""
    lines = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count_if(F.col("o_totalprice") > 490000).alias("labs_bad"),
        F.count("*").alias("labs"))
    ev = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").alias("vitals"), F.max("value").alias("peak"))
    adh = adherence(t).where(F.col("day") == F.lit("2024-01-20").cast("date")).select(
        F.col("user_id").alias("c_custkey"), "gap_detected", "missed", "total_scheduled", F.col("confidence").alias("adh_conf"))
    j_ = t.customer.select("c_custkey").join(lines, "c_custkey", "left").join(ev, "c_custkey", "left").join(adh, "c_custkey", "left")
    return j_.select(
        "c_custkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("active", "labs", "vitals", "missed", "total_scheduled")],
        F.coalesce(F.col("labs_bad") > 0, F.lit(False)).alias("labs_out"), F.coalesce(F.col("peak") > 250, F.lit(False)).alias("vital_crit"),
        F.coalesce("gap_detected", F.lit(False)).alias("gap"), F.coalesce("adh_conf", F.lit(0.0)).alias("adh_conf"),
        F.col("adh_conf").isNotNull().alias("has_adh"))


def rollup(t: Tables):
    al = alerts(t).where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= ts(ORDERS_AS_OF))).select(
        F.col("o_custkey").alias("c_custkey"), "severity", "o_orderdate", "o_orderkey",
        F.concat(F.lit("alert "), F.col("o_orderkey").cast("string")).alias("message"))
    return a.care_rollup(rollup_base(t), "c_custkey", al, severity="severity", message="message",
                         order=[F.col("o_orderdate").desc(), F.col("o_orderkey")], vitals_critical="vital_crit",
                         labs_out="labs_out", active="active", vitals="vitals", labs="labs", gap="gap", missed="missed",
                         scheduled="total_scheduled", adherence_confidence="adh_conf", has_adherence="has_adh")


ROLLUP_CTES = f"""
{DOSES_SQL}, {ADHERENCE_SQL},
al AS (SELECT o_custkey, o_orderkey, o_orderdate, {PRIORITY_SQL} AS s FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}'),
rk AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, s IN ('critical', 'high') ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM al WHERE s IN ('critical', 'high', 'advisory')),
li AS (SELECT o_custkey, list('alert ' || o_orderkey ORDER BY rn) FILTER (s <> 'advisory') AS crit, list('alert ' || o_orderkey ORDER BY rn) FILTER (s = 'advisory') AS att FROM rk WHERE rn <= 3 GROUP BY 1),
o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_totalprice > 490000) AS bad, count(*) AS labs FROM orders GROUP BY 1),
e AS (SELECT user_id, count(*) AS vitals, max(value) AS peak FROM events GROUP BY 1),
t AS (SELECT user_id, gap_detected, missed, total_scheduled FROM adh WHERE day = DATE '2024-01-20'),
oa AS (SELECT o_custkey, count(*) AS open_alerts FROM al GROUP BY 1),
x AS (SELECT c_custkey, list_filter([crit[1], crit[2], crit[3], CASE WHEN gap_detected THEN 'A medication reporting gap was detected.' END,
   CASE WHEN peak > 250 THEN 'A recent vital reading is critical.' END], lambda v: v IS NOT NULL)[1:3] AS c,
   list_filter([att[1], att[2], att[3], CASE WHEN missed >= 2 THEN 'Two or more medication doses were missed.' END,
   CASE WHEN bad > 0 THEN 'A recent lab result is out of range.' END], lambda v: v IS NOT NULL)[1:3] AS a,
   coalesce(active > 0, FALSE)::INT + coalesce(vitals > 0, FALSE)::INT + coalesce(labs > 0, FALSE)::INT + coalesce(open_alerts > 0, FALSE)::INT + coalesce(total_scheduled > 0, FALSE)::INT AS n,
   CASE WHEN total_scheduled IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS ac
   FROM customer LEFT JOIN li ON li.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN e ON e.user_id = c_custkey LEFT JOIN t ON t.user_id = c_custkey
   LEFT JOIN oa ON oa.o_custkey = c_custkey),
roll AS (SELECT c_custkey, CASE WHEN len(c) > 0 THEN 'red' WHEN len(a) > 0 THEN 'yellow' ELSE 'green' END AS status, array_to_string(c, '; ') AS critical_items,
   array_to_string(a, '; ') AS attention_items, cf.v AS confidence FROM x JOIN (SELECT * FROM {sql_values([(n, a_, round(v * 100)) for n in range(5) for a_ in (0.5, 0.9) for v in [a.ROLLUP_CONFIDENCE[f'{n}/{a_}']]], 'cf(k, ac, v)')}) cf ON cf.k = least(x.n, 4) AND cf.ac = x.ac)"""


@query("a14_status_rollup", f"WITH {ROLLUP_CTES} SELECT * FROM roll")
def a14(t: Tables):
    return rollup(t).select("c_custkey", "status", F.array_join("critical_items", "; ").alias("critical_items"),
                            F.array_join("attention_items", "; ").alias("attention_items"),
                            F.round(F.col("confidence") * 100).cast("bigint").alias("confidence"))


def brief(t: Tables):
    """One row per customer: counts of two days, upcoming rows, approvals, rollup."""
    o, day = t.orders, F.to_date("o_orderdate")
    counts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("active_items"),
        F.count_if(day == F.lit("1998-06-01").cast("date")).alias("today_log"),
        F.count_if(day == F.lit("1998-05-31").cast("date")).alias("yesterday_log"),
        F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("pending_approvals"),
        F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)).alias("awaiting_review"),
        F.count_if((F.col("o_orderdate") >= ts(ORDERS_AS_OF)) & (F.col("o_orderdate") < ts("1998-06-15"))).alias("appointments"),
        F.count_if((F.col("o_orderdate") >= ts(ORDERS_AS_OF)) & (F.col("o_orderdate") < ts("1998-06-08"))).alias("visits"))
    ad = adherence(t)
    days = ad.groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.sum(F.when(F.col("day") == F.lit("2024-01-20").cast("date"), F.col("taken"))).alias("taken_today"),
        F.sum(F.when(F.col("day") == F.lit("2024-01-19").cast("date"), F.col("taken"))).alias("taken_yesterday"))
    names = ("active_items", "today_log", "yesterday_log", "pending_approvals", "awaiting_review", "appointments", "visits",
             "taken_today", "taken_yesterday")
    out = (t.customer.select("c_custkey", F.col("c_name").alias("name")).join(counts, "c_custkey", "left").join(days, "c_custkey", "left")
           .join(rollup(t).select("c_custkey", "status"), "c_custkey", "left"))
    return out.select("c_custkey", "name", "status", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


BRIEF_SQL = f"""
WITH {ROLLUP_CTES},
k AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS active_items, count(*) FILTER (o_orderdate::DATE = DATE '1998-06-01') AS today_log,
  count(*) FILTER (o_orderdate::DATE = DATE '1998-05-31') AS yesterday_log, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS pending_approvals,
  count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) AS awaiting_review,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-06-15') AS appointments,
  count(*) FILTER (o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-06-08') AS visits FROM orders GROUP BY 1),
d AS (SELECT user_id, sum(taken) FILTER (day = DATE '2024-01-20') AS taken_today, sum(taken) FILTER (day = DATE '2024-01-19') AS taken_yesterday FROM adh GROUP BY 1)
SELECT c_custkey, c_name AS name, status, coalesce(active_items, 0) AS active_items, coalesce(today_log, 0) AS today_log, coalesce(yesterday_log, 0) AS yesterday_log,
  coalesce(pending_approvals, 0) AS pending_approvals, coalesce(awaiting_review, 0) AS awaiting_review, coalesce(appointments, 0) AS appointments,
  coalesce(visits, 0) AS visits, coalesce(taken_today, 0)::BIGINT AS taken_today, coalesce(taken_yesterday, 0)::BIGINT AS taken_yesterday
FROM customer JOIN roll USING (c_custkey) LEFT JOIN k ON k.o_custkey = c_custkey LEFT JOIN d ON d.user_id = c_custkey"""


@query("a15_wide_daily_brief", BRIEF_SQL)
def a15(t: Tables):
    return brief(t)


@query("a16_active_entities", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def a16(t: Tables):
    return t.orders.where("o_orderstatus = 'O'").select("o_custkey").distinct()


@query("a17_first_non_null", """
SELECT source, coalesce(first(lang ORDER BY doc_id) FILTER (doc_id % 5 = 4), '') AS doctor, coalesce(first(n_chars ORDER BY doc_id) FILTER (n_chars > 3000), -1) AS big
FROM documents GROUP BY 1""")
def a17(t: Tables):
    pieces = t.documents.select("source", "doc_id", F.when(F.col("doc_id") % 5 == 4, F.col("lang")).otherwise("").alias("doctor"),
                                F.when(F.col("n_chars") > 3000, F.col("n_chars")).alias("big"))
    return a.first_non_null(pieces, ["source"], "doc_id", ["doctor", "big"]).select(
        "source", F.coalesce("doctor", F.lit("")).alias("doctor"), F.coalesce("big", F.lit(-1)).alias("big"))


CENTROID_CTES = """
u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1),
cent AS (SELECT label, pos, v / norm AS v FROM m JOIN n USING (label))"""


@query("a18_label_centroids", f"""
WITH {CENTROID_CTES} SELECT label, pos, round(v, 5) AS v FROM cent
UNION ALL SELECT -1, unnest(range(1, 65)), 0.0""")
def a18(t: Tables):
    cents = a.with_unclear(a.label_centroids(t.embeddings, "label", "embedding", 64), "label", -1, 64)
    return cents.select("label", F.posexplode("centroid").alias("pos", "v")).select(
        "label", (F.col("pos") + 1).alias("pos"), F.round("v", 5).alias("v"))


@query("a19_delivery_totals", """
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type = 'view') AS suppressed FROM events GROUP BY 1""")
def a19(t: Tables):
    kind = F.col("event_type")
    return a.filtered_counts(t.events, ["user_id"], {"total": F.lit(True), "sent": kind == "purchase", "failed": kind == "error",
                                                     "suppressed": kind == "view"})


FREQS = ["OD", "BD", "tid", "four times daily", "SOS", "weekly"]


@query("a20_dose_range", f"""
SELECT l_orderkey, l_linenumber, l_partkey, dose <= 0 OR dose * n > greatest(p_size, p_size * 2) * 4 * 3 AS suspicious
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 4 - 8 AS dose, ([1, 2, 3, 4, 0, 1])[l_suppkey % 6 + 1] AS n FROM lineitem)
JOIN part ON p_partkey = l_partkey""")
def a20(t: Tables):
    formulary = t.part.select(F.col("p_partkey").alias("l_partkey"), F.array(F.col("p_size"), F.col("p_size") * 2).cast("array<double>").alias("doses"))
    freq = F.element_at(F.array(*[F.lit(x) for x in FREQS]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 4 - 8).alias("dose"), freq.alias("freq")) \
        .join(formulary, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey",
                                             a.suspicious_dose("dose", "freq", "doses").alias("suspicious"))


@query("a22_shadow_agreement", """
WITH s AS (SELECT event_type AS a, CASE WHEN value > 120 THEN 'error' WHEN event_id % 3 = 0 THEN event_type ELSE 'view' END AS b FROM events WHERE event_id % 100 < 30),
k AS (SELECT a, b, count(*) AS n FROM s GROUP BY 1, 2)
SELECT a AS label_a, b AS label_b, n, round(sum(CASE WHEN a = b THEN n ELSE 0 END) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a), 4) AS agreement FROM k""")
def a22(t: Tables):
    second = F.when(F.col("value") > 120, "error").when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("view")
    rows = t.events.where(a.shadow_sample("event_id", 30)).select("event_type", second.alias("second"))
    return a.agreement(rows, "event_type", "second")


@query("j22_context_flags", """
WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS items, count(*) - count(DISTINCT o_orderpriority) > 12 AS rep, max(o_totalprice) > 490000 AS labs,
   min(o_totalprice) / 1000 AS egfr FROM orders GROUP BY 1)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter([
  CASE WHEN coalesce(items, 0) = 0 THEN 'medication_history:missing' END, CASE WHEN coalesce(items, 0) > 0 AND rep THEN 'duplicate_therapy:risk' END,
  CASE WHEN egfr IS NULL AND c_nationkey % 2 = 0 THEN 'renal:missing' END, CASE WHEN egfr < 30 THEN 'renal:risk' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'medical_history:missing' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'renal:risk' END,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'liver:risk' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'diabetes:present' END,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'blood_pressure:present' END, CASE WHEN c_custkey % 10 = 0 THEN 'allergy:risk' END,
  CASE WHEN labs THEN 'abnormal_labs:risk' END, CASE WHEN c_custkey % 13 = 0 THEN 'bleeding:risk' END], lambda x: x IS NOT NULL))), ',') AS flags
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def j22(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("items"), (F.count("*") - F.countDistinct("o_orderpriority") > 12).alias("rep"),
        (F.max("o_totalprice") > 490000).alias("labs"), (F.min("o_totalprice") / 1000).alias("egfr"))
    cond = F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<string>")).otherwise(F.array(F.coalesce(lookup(
        "c_mktsegment", {"MACHINERY": "chronic kidney disease", "HOUSEHOLD": "fatty liver", "FURNITURE": "type 2 diabetes",
                         "AUTOMOBILE": "bp"}), F.lit("none known"))))
    j_ = t.customer.join(o, "c_custkey", "left").withColumn("conds", cond)
    flags = a.context_flags(
        has_items=F.coalesce(F.col("items") > 0, F.lit(False)), repeated=F.coalesce("rep", F.lit(False)), marker=F.col("egfr"),
        renal_relevant=F.col("c_nationkey") % 2 == 0, conditions=F.col("conds"), allergy=F.col("c_custkey") % 10 == 0,
        abnormal_labs=F.coalesce("labs", F.lit(False)), both_bleeding=F.col("c_custkey") % 13 == 0)
    return j_.select("c_custkey", F.array_join(flags, ",").alias("flags"))


@query("p1_lite_flagged_entities", f"""
WITH {RULES_CTE}, {ITEMS_CTE}
SELECT a.l_orderkey, {SEV}[max(rank)] AS max_severity FROM rules JOIN items a ON a.p_name = low
JOIN items b ON b.l_orderkey = a.l_orderkey AND b.p_name = high GROUP BY 1""")
def p1_lite(t: Tables):
    flagged = j.flagged_pairs(held_items(t), j.canonical_rules(part_rules(t)), "l_orderkey", "p_name")
    return a.worst_severity(flagged, ["l_orderkey"], "severity")
