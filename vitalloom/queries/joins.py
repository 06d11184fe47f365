"""Joins on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import small_table, ts
from ..operators import joins as j
from ..operators.filters import hour_bucket  # noqa: F401  (re-exported for notebooks)
from ..registry import Tables, query, sql_values
from .filters import SCHEDULES, schedule_col
from .records import EVENTS_AS_OF, ORDERS_AS_OF


@query("j1_left_join_chain", """
SELECT s_suppkey, n.n_name AS nation, r.r_name AS region, s2.n_name AS neighbour
FROM supplier LEFT JOIN nation n ON s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN nation s2 ON s2.n_nationkey = n.n_nationkey + 5""")
def j1(t: Tables):
    n, n2 = t.nation.alias("n"), t.nation.alias("n2")
    return (t.supplier.join(n, F.col("s_nationkey") == F.col("n.n_nationkey"), "left")
            .join(t.region, F.col("n.n_regionkey") == F.col("r_regionkey"), "left")
            .join(n2, F.col("n2.n_nationkey") == F.col("n.n_nationkey") + 5, "left")
            .select("s_suppkey", F.col("n.n_name").alias("nation"), F.col("r_name").alias("region"),
                    F.col("n2.n_name").alias("neighbour")))


ROLE_RANK = [("BUILDING", 1), ("MACHINERY", 2), ("HOUSEHOLD", 3)]


@query("j2_dimension_join", f"""
SELECT o_orderkey, c_name, rank FROM orders JOIN customer ON o_custkey = c_custkey
JOIN {sql_values(ROLE_RANK, 'r(role, rank)')} ON c_mktsegment = role WHERE o_orderstatus = 'P'""")
def j2(t: Tables):
    roles = small_table(t.spark, ROLE_RANK, "role string, rank int")
    return (t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(roles, F.col("c_mktsegment") == F.col("role")).select("o_orderkey", "c_name", "rank"))


@query("j3_name_fallback", f"""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'visitor ' || o_orderkey END, c_name, '') AS visitor
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 3000
WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}'""")
def j3(t: Tables):
    own = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("visitor "), F.col("o_orderkey").cast("string")))
    return (t.orders.where(F.col("o_orderdate") >= ts(ORDERS_AS_OF))
            .join(t.customer.where("c_acctbal > 3000"), F.col("o_custkey") == F.col("c_custkey"), "left")
            .select("o_orderkey", F.coalesce(own, "c_name", F.lit("")).alias("visitor")))


def part_rules(t: Tables):
    """Interaction rules between part names: a part and the part after it."""
    a = t.part.select(
        F.col("p_partkey"), F.col("p_name").alias("drug_a"),
        F.element_at(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]),
                     (F.col("p_size") % 4 + 1).cast("int")).alias("severity"))
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_name").alias("drug_b"))
    return a.join(b, "p_partkey").where(F.lower("drug_a") != F.lower("drug_b")).drop("p_partkey")


def held_items(t: Tables):
    """Items per entity: order lines with part names."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey")


SEV = "(['low','medium','high','critical'])"
RULES_CTE = """
rules AS (SELECT least(a.p_name, b.p_name) AS low, greatest(a.p_name, b.p_name) AS high, max(a.p_size % 4 + 1) AS rank
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_name <> b.p_name GROUP BY 1, 2)"""
ITEMS_CTE = "items AS (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("j4_unordered_pair_rule", f"""
WITH {RULES_CTE}
SELECT l_orderkey, l_linenumber, a.p_name AS item_a, b.p_name AS item_b, {SEV}[rank] AS severity
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey
JOIN rules ON low = least(a.p_name, b.p_name) AND high = greatest(a.p_name, b.p_name)""")
def j4(t: Tables):
    names = t.part.select("p_partkey", "p_name")
    pairs = (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
             .join(names.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item_a")), "l_partkey")
             .join(names.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("item_b")), "l_suppkey"))
    return j.match_pairs(pairs, j.canonical_rules(part_rules(t)), "item_a", "item_b").select(
        "l_orderkey", "l_linenumber", "item_a", "item_b", "severity")


@query("j5_entity_pair_rule", f"""
WITH {RULES_CTE}, {ITEMS_CTE}
SELECT a.l_orderkey, low, high, {SEV}[rank] AS severity FROM rules JOIN items a ON a.p_name = low
JOIN items b ON b.l_orderkey = a.l_orderkey AND b.p_name = high""")
def j5(t: Tables):
    return j.flagged_pairs(held_items(t), j.canonical_rules(part_rules(t)), "l_orderkey", "p_name")


@query("j6_alias_join", """
WITH f AS (SELECT p_partkey, p_name, p_type, p_brand, p_size FROM part),
e AS (SELECT p_name AS canonical, p_size, p_partkey, unnest([lower(p_name), lower(p_type), lower(p_brand)]) AS alias FROM f),
best AS (SELECT alias, arg_max(canonical, p_size::BIGINT * 100000000 + p_partkey) AS canonical FROM e GROUP BY 1)
SELECT p_partkey, canonical FROM part JOIN best ON alias = CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE lower(p_name) END""")
def j6(t: Tables):
    formulary = t.part.select("p_name", F.array(F.upper("p_type"), "p_brand").alias("aliases"), "p_size",
                              F.col("p_partkey").alias("used"))
    raw = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
                        .otherwise(F.upper("p_name")).alias("raw"))
    return j.by_alias(raw, formulary, "raw", "p_name", "aliases", "p_size", "used").select("p_partkey", "canonical")


TERMS = [("small ring", 60.0, 45.0, 30.0), ("ring", 55.0, 40.0, 25.0), ("bolt", 50.0, 35.0, 20.0), ("old", 60.0, 45.0, 30.0),
         ("ear", 58.0, 44.0, 28.0), ("red", 61.0, 46.0, 31.0)]


@query("j7_containment_join", f"""
SELECT p_partkey, term, match, rank FROM (SELECT p_partkey, term,
  CASE WHEN n = term THEN 'equal' WHEN list_contains(string_split(n, ' '), term) THEN 'token' ELSE 'substring' END AS match,
  row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, term) AS rank
  FROM (SELECT p_partkey, lower(p_name) AS n FROM part) JOIN {sql_values([(x[0],) for x in TERMS], 'v(term)')} ON contains(n, term))
WHERE rank <= 10""")
def j7(t: Tables):
    names = small_table(t.spark, [(x[0],) for x in TERMS], "term string")
    return j.contained_names(t.part.select("p_partkey", "p_name"), names, "p_name", "term", cap=10) \
        .select("p_partkey", "term", "match", "rank")


@query("j8_threshold_bands", f"""
WITH rules AS (SELECT p_name, adv, warn, crit FROM (SELECT DISTINCT p_name FROM part) JOIN {sql_values(TERMS, 'v(term, adv, warn, crit)')}
   ON contains(lower(p_name), term)),
i AS (SELECT DISTINCT l_suppkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
x AS (SELECT l_suppkey, p_name, CASE WHEN s_nationkey % 6 <> 0 THEN s_acctbal / 120 END AS egfr, s_nationkey % 5 = 0 AS renal,
   adv IS NOT NULL AS known, p_name = 'hot gear' AS fb, coalesce(adv, 60) AS adv, coalesce(warn, 45) AS warn, coalesce(crit, 30) AS crit,
   CASE WHEN adv IS NULL THEN 'high' ELSE 'medium' END AS dflt
   FROM i JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN rules USING (p_name)),
y AS (SELECT *, CASE WHEN (known OR fb) AND egfr < crit THEN 'critical' WHEN (known OR fb) AND egfr < warn THEN 'high'
   WHEN (known OR fb) AND egfr < adv THEN dflt END AS band FROM x),
z AS (SELECT *, CASE WHEN egfr IS NULL AND (known OR fb OR renal) THEN 'renal_context_missing' WHEN band IS NOT NULL THEN 'renal_clearance_warning'
   WHEN renal AND egfr < 60 THEN 'renal_condition_context' END AS finding FROM y)
SELECT l_suppkey, p_name, finding, CASE finding WHEN 'renal_context_missing' THEN 'high' WHEN 'renal_clearance_warning' THEN band
  ELSE 'medium' END AS severity FROM z WHERE finding IS NOT NULL""")
def j8(t: Tables):
    terms = small_table(t.spark, TERMS, "term string, advisory_egfr double, warning_egfr double, critical_egfr double")
    names = t.part.select("p_name").distinct()
    rules = j.contained_names(names, terms, "p_name", "term").select(
        "p_name", "advisory_egfr", "warning_egfr", "critical_egfr", F.lit("medium").alias("default_severity"))
    items = held_items(t).select("l_suppkey", "p_name").distinct()
    markers = t.supplier.where("s_nationkey % 6 <> 0").select(F.col("s_suppkey").alias("l_suppkey"),
                                                              (F.col("s_acctbal") / 120).alias("egfr"))
    cond = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 5 == 0).alias("has_renal"))
    return j.renal_findings(items, rules, markers, cond, entity="l_suppkey", item="p_name", fallback=["hot gear"])


CONDITION_ITEMS = ["metformin", "warfarin", "amlodipine", "atorvastatin", "furosemide", "ibuprofen"]
CONDITIONS = ["chronic kidney disease", "stomach ulcer", "fall last year", "fatty liver", "pregnancy", "severe dehydration",
              "allergy to ibuprofen", "none"]


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


@query("j9_condition_rules", f"""
WITH x AS (SELECT doc_id, item, text || ' ' || cond AS txt FROM (SELECT doc_id, ({CONDITION_ITEMS}::VARCHAR[])[doc_id % 6 + 1] AS item,
  lower(text) AS text, ({CONDITIONS}::VARCHAR[])[(doc_id // 6) % 8 + 1] AS cond FROM documents)),
r AS (SELECT * FROM {sql_values([(n, i, s, sev) for n, items, subs, sev in j.CONDITION_RULES for i in items for s in subs], 'r(rule, item, needle, severity)')})
SELECT DISTINCT doc_id, rule, severity FROM x JOIN r ON r.item = x.item AND contains(txt, needle)
UNION ALL SELECT doc_id, 'allergy_condition_rule', 'critical' FROM x WHERE contains(txt, 'allerg') AND contains(txt, item)""")
def j9(t: Tables):
    rows = t.documents.select("doc_id", _pick(CONDITION_ITEMS, F.col("doc_id")).alias("item"),
                              F.concat_ws(" ", "text", _pick(CONDITIONS, F.floor(F.col("doc_id") / 6))).alias("cond"))
    return j.condition_findings(rows, "item", "cond", ["doc_id"])


@query("j10_duplicate_overlap", """
WITH i AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, p_name, string_split(p_name, ' ') AS parts, row_number() OVER () AS id,
  CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 1 END AS rx FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT a.id, count(*) AS duplicates, bool_or(b.rx = 1) AS rx FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.p_name = b.p_name AND a.id <> b.id GROUP BY 1),
o AS (SELECT a.id, list_sort(list_distinct(flatten(list(list_intersect(a.parts, b.parts))))) AS shared FROM i a JOIN i b
   ON a.l_orderkey = b.l_orderkey AND a.p_name <> b.p_name GROUP BY 1)
SELECT l_orderkey, l_linenumber, p_name, CASE WHEN d.id IS NOT NULL THEN 'duplicate' ELSE 'overlap' END AS finding,
  CASE WHEN d.rx THEN 'high' ELSE 'medium' END AS severity, coalesce(duplicates, 0) AS duplicates, coalesce(array_to_string(shared, '|'), '') AS shared
FROM i LEFT JOIN d USING (id) LEFT JOIN o USING (id) WHERE d.id IS NOT NULL OR len(shared) > 0""")
def j10(t: Tables):
    rows = held_items(t).withColumn("rx", F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise("dr"))
    out = j.duplicate_or_overlap(rows, "l_orderkey", "l_linenumber", "p_name", "rx", F.split("p_name", " "))
    return out.withColumn("shared", F.array_join("shared_components", "|")).drop("shared_components")


@query("j11_earlier_work", """
SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (
  SELECT 1 FROM orders d WHERE d.o_orderstatus = 'F' AND d.o_custkey = o.o_custkey AND d.o_orderpriority = o.o_orderpriority)""")
def j11(t: Tables):
    return j.without_equal_work(t.orders.where("o_orderstatus = 'O'"), t.orders.where("o_orderstatus = 'F'"),
                                ["o_custkey", "o_orderpriority"]).select("o_orderkey")


@query("j12_recent_duplicate", """
SELECT event_id FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS dose FROM events) n WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS dose FROM events) h
  WHERE h.user_id = n.user_id AND h.event_type = n.event_type AND h.dose IS NOT DISTINCT FROM n.dose
  AND h.ts > n.ts - INTERVAL 24 HOUR AND (h.ts < n.ts OR (h.ts = n.ts AND h.event_id < n.event_id)))""")
def j12(t: Tables):
    rows = t.events.withColumn("dose", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5))
    return j.without_recent(rows, rows, ["user_id", "event_type", "dose"], "ts", "ts", 24 * 3600,
                            ident="event_id").select("event_id")


@query("j13_recent_flag", f"""
SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase'
  AND ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS notified FROM events""")
def j13(t: Tables):
    log = t.events.where((F.col("event_type") == "purchase") & (F.col("ts") <= ts(EVENTS_AS_OF)))
    return j.seen_since(t.events.select("user_id").distinct(), log, ["user_id"], "ts",
                        ts("2024-01-18 00:00:00"), "notified")


def expected_doses(t: Tables):
    """Doses per (user, day the user was active) from the user's schedule."""
    days = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    return days.select("user_id", "day", F.explode(schedule_col(F.col("user_id"))).alias("hhmm")).select(
        "user_id", "day", F.to_timestamp(F.concat(F.col("day").cast("string"), F.lit(" "), "hhmm"),
                                         "yyyy-MM-dd HH:mm").alias("dose_at"))


def dose_logs(t: Tables):
    return t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")


DOSES_SQL = f"""
doses AS (SELECT user_id, day, (day::VARCHAR || ' ' || hhmm || ':00')::TIMESTAMP AS dose_at FROM (
  SELECT user_id, day, unnest(({[list(s) for s in SCHEDULES]}::VARCHAR[][])[user_id % 5 + 1]) AS hhmm
  FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)))"""


@query("j14_tolerance_match", f"""
WITH {DOSES_SQL}
SELECT user_id, dose_at, coalesce(arg_max(event_id, ts), -1) AS matched_id FROM doses LEFT JOIN events e USING (user_id)
WHERE FALSE GROUP BY ALL
UNION ALL SELECT d.user_id, d.dose_at, coalesce(m.event_id, -1) FROM doses d LEFT JOIN (
  SELECT user_id, dose_at, arg_max(event_id, ts) AS event_id FROM doses JOIN events e USING (user_id)
  WHERE e.ts::DATE = day AND e.ts BETWEEN dose_at - INTERVAL 3 HOUR AND dose_at + INTERVAL 3 HOUR GROUP BY 1, 2) m
  USING (user_id, dose_at)""")
def j14(t: Tables):
    out = j.match_doses(expected_doses(t), dose_logs(t), ["user_id", "day"], "dose_at", "ts", "event_id", "event_type")
    return out.select("user_id", F.col("dose_at").cast("timestamp_ntz").alias("dose_at"),
                      F.coalesce("matched_id", F.lit(-1)).alias("matched_id"))


@query("j15_previous_value", """
SELECT event_id, coalesce(lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), -1) AS previous FROM events""")
def j15(t: Tables):
    return j.previous_value(t.events, ["user_id", "event_type"], ["ts", "event_id"], "value").select(
        "event_id", F.coalesce("previous", F.lit(-1.0)).alias("previous"))


@query("j16_or_key_join", f"""
WITH {RULES_CTE}, named AS (SELECT n, max(rank) AS rank FROM (SELECT low AS n, rank FROM rules UNION ALL SELECT high, rank FROM rules) GROUP BY 1)
SELECT l_orderkey, l_linenumber, {SEV}[r.rank] AS severity, n1.n IS NOT NULL OR n2.n IS NOT NULL AS loose FROM lineitem
JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey
LEFT JOIN rules r ON low = least(a.p_name, b.p_name) AND high = greatest(a.p_name, b.p_name)
LEFT JOIN named n1 ON n1.n = a.p_name LEFT JOIN named n2 ON n2.n = b.p_name""")
def j16(t: Tables):
    names = t.part.select("p_partkey", "p_name")
    pairs = (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
             .join(names.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a")), "l_partkey")
             .join(names.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b")), "l_suppkey"))
    herbs = part_rules(t).withColumnsRenamed({"drug_a": "herb_name", "drug_b": "drug_name"})
    strict = j.herb_matches(pairs, herbs, "a", "b")
    both = j.herb_matches(strict.withColumnRenamed("severity", "strict"), herbs, "a", "b", loose=True)
    return both.select("l_orderkey", "l_linenumber", F.col("strict").alias("severity"),
                       F.col("severity").isNotNull().alias("loose"))


@query("j17_nearest_within_radius", """
WITH p AS (SELECT c_custkey, 28.0 + (c_custkey * 37 % 1000) / 2000.0 AS lat, 77.0 + (c_custkey * 91 % 1000) / 2000.0 AS lon FROM customer),
h AS (SELECT s_suppkey, 28.0 + (s_suppkey * 53 % 997) / 1994.0 AS plat, 77.0 + (s_suppkey * 29 % 997) / 1994.0 AS plon FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT c_custkey, s_suppkey,
  power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2) AS a FROM p, h))
SELECT p.c_custkey, coalesce(n.s_suppkey, -1) AS nearest, coalesce(round(n.km, 4), -1) AS km FROM p LEFT JOIN (
  SELECT c_custkey, arg_min(s_suppkey, km) AS s_suppkey, min(km) AS km FROM d WHERE km <= 7 GROUP BY 1) n USING (c_custkey)""")
def j17(t: Tables):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    pts = t.customer.select(k, (28.0 + (k * 37 % 1000) / 2000.0).alias("lat"), (77.0 + (k * 91 % 1000) / 2000.0).alias("lon"))
    places = t.supplier.select(s, (28.0 + (s * 53 % 997) / 1994.0).alias("plat"), (77.0 + (s * 29 % 997) / 1994.0).alias("plon"))
    return j.nearest_within(pts, places, "c_custkey", "lat", "lon", "s_suppkey", "plat", "plon").select(
        "c_custkey", F.coalesce("nearest", F.lit(-1)).alias("nearest"),
        F.coalesce(F.round("distance_km", 4), F.lit(-1.0)).alias("km"))


CONFLICT_RULES = [("medication", r"th.*on", r"\bis\b"), ("diet", r"the.*ing", r"\bof\b.*\bto\b"), ("symptom", r"der", r"und")]


@query("j20_claim_conflicts", f"""
WITH r AS (SELECT * FROM {sql_values([(i, k, a, b) for i, (k, a, b) in enumerate(CONFLICT_RULES)], 'r(n, kind, claim, contra)')}),
m AS (SELECT a.conv_id, a.turn AS claimed_at, r.n, r.kind, b.turn AS contradicted_by FROM conversations a JOIN r ON a.role = 'assistant' AND regexp_matches(lower(a.text), r.claim, 's')
  JOIN conversations b ON b.conv_id = a.conv_id AND b.role = 'user' AND b.turn < a.turn AND regexp_matches(lower(b.text), r.contra, 's'))
SELECT conv_id, claimed_at, kind, contradicted_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, claimed_at
  ORDER BY contradicted_by DESC, n) AS rank FROM m) WHERE rank <= 3""")
def j20(t: Tables):
    rules = [(k, f"(?s){a}", f"(?s){b}") for k, a, b in CONFLICT_RULES]
    return j.claim_conflicts(t.conversations, ["conv_id"], "turn", "role", "text", "assistant", "user", rules)


def _longest_sql(name: str, keys: str, hit: str) -> str:
    return f"{name} AS (SELECT raw, v FROM (SELECT raw, v, row_number() OVER (PARTITION BY raw ORDER BY length(k) DESC, k) AS n FROM d JOIN {keys} ON {hit}) WHERE n = 1)"


@query("j23_tiered_names", f"""
WITH raw AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'SMALL' WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_type || ' 5 mg' WHEN 4 THEN 'my ' || p_name || ' 40mg.'
  WHEN 5 THEN substr(p_name, 1, length(p_name) - 2) WHEN 6 THEN substr(p_name, 2, 1) ELSE 'zz ' || p_size END AS raw FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(raw), '\\b\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|g|ml|iu|units?)\\b', '', 'g'), '^[ .:-]+|[ .:-]+$', '', 'g') AS raw FROM raw),
d AS (SELECT DISTINCT raw FROM c), a AS (SELECT lower(p_type) AS k, min(p_brand) AS v FROM part GROUP BY 1), h AS (SELECT DISTINCT lower(p_name) AS k, lower(p_name) AS v FROM part),
r AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_size > 30 AND p_name NOT LIKE '% ring'), f AS (SELECT lower(p_brand) AS k, min(p_name) AS v FROM part GROUP BY 1),
{_longest_sql('am', 'a', 'contains(raw, k)')}, {_longest_sql('hm', 'h', 'contains(raw, k) OR contains(k, raw)')}
SELECT p_partkey, CASE WHEN am.v IS NOT NULL THEN am.v WHEN r.k IS NOT NULL THEN r.k WHEN f.v IS NOT NULL THEN f.v WHEN hm.v IS NOT NULL THEN hm.v ELSE c.raw END AS name,
  CASE WHEN am.v IS NOT NULL THEN 0.92 WHEN r.k IS NOT NULL THEN 0.88 WHEN f.v IS NOT NULL THEN 0.95 WHEN hm.v IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN am.v IS NOT NULL THEN 'alias' WHEN r.k IS NOT NULL THEN 'rule' WHEN f.v IS NOT NULL THEN 'formulary' WHEN hm.v IS NOT NULL THEN 'hint' ELSE 'raw' END AS tier
FROM c LEFT JOIN am ON am.raw = c.raw LEFT JOIN r ON r.k = c.raw LEFT JOIN f ON f.k = c.raw LEFT JOIN hm ON hm.raw = c.raw""".replace("\\\\", "\\"))
def j23(t: Tables):
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    raw = (F.when(k == 0, "SMALL").when(k == 1, name).when(k == 2, F.col("p_brand")).when(k == 3, F.concat("p_type", F.lit(" 5 mg"))).when(k == 4, F.concat(F.lit("my "), name, F.lit(" 40mg.")))
           .when(k == 5, F.substring(name, F.lit(1), F.length(name) - 2)).when(k == 6, F.substring(name, 2, 1)).otherwise(F.concat(F.lit("zz "), F.col("p_size").cast("string"))))
    rows = t.part.select("p_partkey", j.without_strength(raw).alias("raw"))
    named = t.part.withColumn("low", F.lower("p_name"))
    tiers = [j.Tier(t.part, "p_type", "p_brand", 0.92, "alias", "inside"), j.Tier(named.where("p_size > 30 AND p_name NOT LIKE '% ring'"), "p_name", "low", 0.88, "rule"),
             j.Tier(t.part, "p_brand", "p_name", 0.95, "formulary"), j.Tier(named, "p_name", "low", 0.80, "hint", "either")]
    return j.first_tier(rows, tiers, "raw").select("p_partkey", "name", "confidence", "tier")


@query("j24_source_preference", """
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'cached ' || c_custkey END, team.s_name, '') AS contact,
  CASE WHEN c_custkey % 3 = 0 THEN 'cache' WHEN team.s_name IS NOT NULL THEN 'team' ELSE 'none' END AS source
FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) team ON c_nationkey = s_nationkey""")
def j24(t: Tables):
    team = t.supplier.where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("team"))
    cached = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("cached "), F.col("c_custkey").cast("string")))
    return t.customer.join(team, "c_nationkey", "left").select(
        "c_custkey", F.coalesce(cached, "team", F.lit("")).alias("contact"),
        F.when(cached.isNotNull(), "cache").when(F.col("team").isNotNull(), "team").otherwise("none").alias("source"))
