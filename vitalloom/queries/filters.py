"""Filters and row predicates on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import lookup, round_double, ts
from ..operators import filters as f
from ..registry import Tables, query, sql_literal
from ..sources.snapshots import append_note
from ..sources.tables import json_equals
from .records import EVENTS_AS_OF, ORDERS_AS_OF


@query("b1_status_filter", "SELECT event_id, user_id FROM events WHERE lower(event_type) IN ('error', 'purchase')")
def b1(t: Tables):
    return t.events.where(f.status_in("event_type", ["Error", "PURCHASE"])).select("event_id", "user_id")


@query("b2_optional_range", """
SELECT o_orderkey, 'both' AS bounds FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1997-04-01'
UNION ALL SELECT o_orderkey, 'end' FROM orders WHERE o_orderdate < '1995-06-01'
UNION ALL SELECT o_orderkey, 'none' FROM orders""")
def b2(t: Tables):
    def part(label, start, end):
        return t.orders.where(f.in_range("o_orderdate", start, end)).select("o_orderkey", F.lit(label).alias("bounds"))
    return part("both", "1997-01-01", "1997-04-01").unionByName(part("end", None, "1995-06-01")) \
        .unionByName(part("none", None, None))


@query("b3_look_ahead", f"""
SELECT o_orderkey, 'query' AS use FROM orders WHERE o_orderstatus IN ('O', 'F')
  AND o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' AND o_orderdate < TIMESTAMP '{ORDERS_AS_OF}' + INTERVAL 14 DAY
UNION ALL SELECT o_orderkey, 'reminder' FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')
  AND o_orderdate > TIMESTAMP '{ORDERS_AS_OF}' AND o_orderdate <= TIMESTAMP '{ORDERS_AS_OF}' + INTERVAL 72 HOUR""")
def b3(t: Tables):
    q = t.orders.where(F.col("o_orderstatus").isin("O", "F") & f.look_ahead("o_orderdate", ORDERS_AS_OF, days=14))
    r = t.orders.where(F.col("o_orderstatus").isin("O", "F", "P") & f.look_ahead(
        "o_orderdate", ORDERS_AS_OF, open_start=True, closed_end=True, hours=72))
    return q.select("o_orderkey", F.lit("query").alias("use")).unionByName(
        r.select("o_orderkey", F.lit("reminder").alias("use")))


@query("b4_freshness", f"""
SELECT event_id, CASE WHEN ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 6 HOUR THEN 'cache'
  WHEN ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR THEN 'audit' ELSE 'stale' END AS freshness
FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}'""")
def b4(t: Tables):
    return t.events.where(F.col("ts") <= ts(EVENTS_AS_OF)).select("event_id", F.when(
        f.fresh("ts", EVENTS_AS_OF, hours=6), "cache").when(
        f.fresh("ts", EVENTS_AS_OF, hours=24), "audit").otherwise("stale").alias("freshness"))


@query("b5_key_or_prefix", """
WITH p AS (SELECT DISTINCT substr(c_name, 1, 14 + c_custkey % 5) AS probe FROM customer),
h AS (SELECT probe, c_custkey, c_name, c_name = probe AS exact FROM p JOIN customer ON starts_with(c_name, probe))
SELECT probe, arg_max(c_custkey, (exact::INT) * 10000000000 + c_custkey) AS c_custkey,
       bool_or(exact) AS exact, count(*) > 1 AS ambiguous FROM h GROUP BY 1""")
def b5(t: Tables):
    probes = t.customer.select(
        F.substring("c_name", F.lit(1), (14 + F.col("c_custkey") % 5).cast("int")).alias("probe"))
    base = t.customer.select("c_custkey", "c_name")
    return f.lookup_by_prefix(base, probes, "c_name", "probe", "c_custkey").select(
        "probe", "c_custkey", "exact", "ambiguous")


@query("b6_json_predicate", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '9'")
def b6(t: Tables):
    return t.events.where(json_equals("props", "k", "9")).select("event_id")


@query("b7_blank_coalesce", """
SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END), ''), nullif(trim(source), ''), 'none') AS label
FROM documents""")
def b7(t: Tables):
    maybe = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("lang"))
    return t.documents.select("doc_id", f.coalesce_blank(maybe, "source", F.lit("none")).alias("label"))


@query("b8_append_note", """
SELECT o_orderkey, CASE WHEN nw = '' THEN old WHEN old = '' THEN nw ELSE old || chr(10) || nw END AS notes
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS old,
             CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS nw FROM orders)""")
def b8(t: Tables):
    k = F.col("o_orderkey")
    old = F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    new = F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", append_note(old, new).alias("notes"))


@query("b9_lifecycle_state", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'used' WHEN o_orderdate < TIMESTAMP '{ORDERS_AS_OF}' THEN 'expired'
  ELSE 'valid' END AS state FROM orders""")
def b9(t: Tables):
    used = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return t.orders.select("o_orderkey", f.lifecycle_state(used, "o_orderdate", ORDERS_AS_OF).alias("state"))


@query("b10_range_severity", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < lo OR l_quantity > hi
   THEN CASE WHEN l_returnflag = 'R' THEN 'critical' ELSE 'advisory' END ELSE 'normal' END AS severity
FROM (SELECT *, CASE WHEN l_suppkey % 4 <> 0 THEN 5.0 END AS lo, CASE WHEN l_suppkey % 3 <> 0 THEN 45.0 END AS hi FROM lineitem)""")
def b10(t: Tables):
    low, high = F.when(F.col("l_suppkey") % 4 != 0, 5.0), F.when(F.col("l_suppkey") % 3 != 0, 45.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", f.range_severity(
        "l_returnflag", "l_quantity", low, high, ["r"]).alias("severity"))


VITALS = {"view": "pulse", "click": "spo2", "error": "glucose", "purchase": "temperature", "signup": "bp"}


def vitals(t: Tables):
    """Events read as vital signs in their usual ranges."""
    test = lookup("event_type", VITALS)
    v = F.col("value")
    value = (F.when(test == "pulse", round_double(v + 40, 2)).when(test == "spo2", round_double(80 + v / 10, 2))
             .when(test == "glucose", round_double(v * 5, 2)).when(test == "temperature", round_double(35 + v / 20, 2))
             .otherwise(round_double(100 + v, 2)))
    return t.events.select("event_id", "user_id", "ts", test.alias("test"), value.alias("reading"),
                           round_double(60 + v / 2, 2).alias("secondary"), (F.col("user_id") % 2 == 0).alias("older"),
                           (F.col("user_id") % 3 == 0).alias("copd"))


VITALS_SQL = """
SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'pulse' WHEN 'click' THEN 'spo2' WHEN 'error' THEN 'glucose'
    WHEN 'purchase' THEN 'temperature' ELSE 'bp' END AS test,
  CASE event_type WHEN 'view' THEN round(value + 40, 2) WHEN 'click' THEN round(80 + value / 10, 2)
    WHEN 'error' THEN round(value * 5, 2) WHEN 'purchase' THEN round(35 + value / 20, 2) ELSE round(100 + value, 2) END AS reading,
  round(60 + value / 2, 2) AS secondary, user_id % 2 = 0 AS older, user_id % 3 = 0 AS copd FROM events"""


@query("b11_vital_severity", f"""
SELECT event_id, test, CASE
  WHEN test = 'bp' THEN CASE WHEN reading >= 180 OR secondary >= 120 THEN 'critical' WHEN reading >= 140 OR secondary >= 90 THEN 'advisory' ELSE 'normal' END
  WHEN test = 'glucose' THEN CASE WHEN reading >= 250 OR reading < 70 THEN 'critical' WHEN reading >= 180 THEN 'advisory' ELSE 'normal' END
  WHEN test = 'pulse' THEN CASE WHEN reading >= (CASE WHEN older THEN 115 ELSE 120 END) OR reading < 50 THEN 'critical'
     WHEN reading >= 100 OR reading < 60 THEN 'advisory' ELSE 'normal' END
  WHEN test = 'spo2' THEN CASE WHEN reading < 90 THEN 'critical' WHEN reading < (CASE WHEN copd THEN 92 ELSE 95 END) THEN 'advisory' ELSE 'normal' END
  ELSE CASE WHEN reading >= (CASE WHEN older THEN 38.8 ELSE 39.0 END) THEN 'critical' WHEN reading >= 38.0 THEN 'advisory' ELSE 'normal' END
  END AS severity FROM ({VITALS_SQL})""")
def b11(t: Tables):
    return vitals(t).select("event_id", "test", f.vital_severity(
        "test", "reading", "secondary", F.col("older"), F.col("copd")).alias("severity"))


LAB_NAMES = ["wbc", "platelets", "creatinine", "serum glucose", "ldl_cholesterol", "mystery", "potassium", "albumin"]


@query("b12_plausible_lab", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN test = 'wbc' AND unit = '/cumm' THEN v BETWEEN 1000 AND 50000
   WHEN test = 'platelets' AND contains(unit, 'lakh') THEN v BETWEEN 0.5 AND 10
   WHEN test = 'platelets' AND contains(unit, 'cumm') THEN v BETWEEN 50000 AND 1000000
   WHEN contains(test, 'creatinine') THEN v BETWEEN 0.1 AND 30 WHEN contains(test, 'glucose') THEN v BETWEEN 10 AND 800
   WHEN contains(test, 'potassium') THEN v BETWEEN 1.5 AND 9 WHEN contains(test, 'wbc') THEN v BETWEEN 0.1 AND 100
   WHEN contains(test, 'platelets') THEN v BETWEEN 5 AND 1500 WHEN contains(test, 'cholesterol') THEN v BETWEEN 50 AND 700
   ELSE test <> 'mystery' END AS plausible
FROM (SELECT l_orderkey, l_linenumber, ({LAB_NAMES}::VARCHAR[])[l_partkey % 8 + 1] AS test,
  CASE l_suppkey % 3 WHEN 0 THEN '/cumm' WHEN 1 THEN 'lakh' ELSE '' END AS unit, l_quantity AS v FROM lineitem)""")
def b12(t: Tables):
    test = F.element_at(F.array(*[F.lit(n) for n in LAB_NAMES]), (F.col("l_partkey") % 8 + 1).cast("int"))
    unit = F.when(F.col("l_suppkey") % 3 == 0, "/cumm").when(F.col("l_suppkey") % 3 == 1, "lakh").otherwise("")
    return t.lineitem.select("l_orderkey", "l_linenumber", f.plausible_lab(test, "l_quantity", unit).alias("plausible"))


@query("b13_include_exclude", r"""
SELECT doc_id FROM documents WHERE (regexp_matches(lower(text || ' ' || source), '(^|[^\p{L}\p{N}_])(anea|ofth)($|[^\p{L}\p{N}_])')
  OR contains(lower(text || ' ' || source), 'of the'))
  AND NOT regexp_matches(lower(text || ' ' || source), '(^|[^\p{L}\p{N}_])(thorn|thing|edble)($|[^\p{L}\p{N}_])')""")
def b13(t: Tables):
    return t.documents.where(f.include_exclude(["text", "source"], ["anea", "ofth", "of the"],
                                               ["thorn", "thing", "edble"])).select("doc_id")


@query("b14_category_split", r"""
SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), '(^|[^\p{L}\p{N}_])(bolt|gear|promo)($|[^\p{L}\p{N}_])')
  THEN 'test' ELSE 'visit' END AS kind FROM part""")
def b14(t: Tables):
    return t.part.select("p_partkey", f.category(["p_name", "p_type"], ["bolt", "gear", "promo"], "test", "visit").alias("kind"))


@query("b15_researchable_name", """
SELECT p_partkey, n AS name, length(n) >= 3 AND regexp_matches(n, '[a-z]{3}') AND n NOT IN ('after food')
   AND NOT starts_with(n, 'avoid ') AS ok
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'avoid ' || p_name WHEN 1 THEN substr(p_name, 1, 2)
   WHEN 2 THEN 'after food' WHEN 3 THEN p_partkey::VARCHAR ELSE p_name END AS n FROM part)""")
def b15(t: Tables):
    k = F.col("p_partkey") % 5
    name = (F.when(k == 0, F.concat(F.lit("avoid "), "p_name")).when(k == 1, F.substring("p_name", 1, 2))
            .when(k == 2, "after food").when(k == 3, F.col("p_partkey").cast("string")).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", name.alias("name")).withColumn("ok", f.researchable_name("name"))


SCHEDULES = [["08:30"], ["08:30", "20:30"], ["08:30", "14:30", "20:30"], ["22:00"], []]
BUCKETS = ["morning", "afternoon", "evening", "night"]


def schedule_col(key):
    return F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in SCHEDULES]),
                        (key % 5 + 1).cast("int"))


SCHEDULE_SQL = f"({sql_literal(SCHEDULES)})[user_id % 5 + 1]"


@query("b16_time_bucket", f"""
WITH e AS (SELECT event_id, ts, user_id % 7 = 0 AS is_now, ({BUCKETS}::VARCHAR[])[event_id % 4 + 1] AS bucket,
   unnest({SCHEDULE_SQL}) AS hhmm FROM events),
m AS (SELECT *, (substr(hhmm, 1, 2)::INT) * 60 + substr(hhmm, 4, 2)::INT AS mins,
   hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS now_sec FROM e),
h AS (SELECT * FROM m WHERE CASE WHEN is_now THEN abs(mins * 60 - now_sec) <= 7200
   ELSE (CASE WHEN mins / 60 >= 6 AND mins / 60 < 12 THEN 'morning' WHEN mins / 60 >= 12 AND mins / 60 < 18 THEN 'afternoon'
     WHEN mins / 60 >= 18 AND mins / 60 < 22 THEN 'evening' ELSE 'night' END) = bucket END)
SELECT event_id, coalesce(min(CASE WHEN mins * 60 >= now_sec THEN hhmm END), '') AS next_dose, count(*) AS matched FROM h GROUP BY 1""")
def b16(t: Tables):
    rows = t.events.select("event_id", "ts", schedule_col(F.col("user_id")).alias("times"),
                           (F.col("user_id") % 7 == 0).alias("is_now"),
                           F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), (F.col("event_id") % 4 + 1).cast("int")).alias("bucket"))
    return f.scheduled_in_bucket(rows, "times", F.col("bucket"), "ts", F.col("is_now"), ["event_id"]) \
        .withColumn("next_dose", F.coalesce("next_dose", F.lit("")))


@query("b17_due_now", f"""
SELECT event_id, coalesce((SELECT bool_or(least(abs(m - n), 1440 - abs(m - n)) <= 30) FROM (SELECT
   (substr(x, 1, 2)::INT) * 60 + substr(x, 4, 2)::INT AS m, hour(e.ts) * 60 + minute(e.ts) AS n
   FROM (SELECT unnest({SCHEDULE_SQL.replace('user_id', 'e.user_id')}) AS x))), FALSE) AS due FROM events e""")
def b17(t: Tables):
    return t.events.select("event_id", f.due_now(schedule_col(F.col("user_id")),
                                                 F.hour("ts") * 60 + F.minute("ts")).alias("due"))
