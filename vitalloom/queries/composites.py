"""Composite jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import lookup, small_table
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators.documents import keep_words
from ..plans import dashboards, evidence, intake, safety
from ..registry import Tables, query, sql_literal, sql_values
from ..session import scratch
from ..sources.snapshots import upsert
from ..streaming import jobs, streams
from .aggregates import GATES_SQL, PRIORITY_SQL, ROLLUP_CTES, alerts, card_columns, rollup
from .aggregates import evidence as evidence_rows
from .extraction import A21_SQL, candidate_records, lab_sql, rx_sql, sql_clean
from .joins import RULES_CTE, TERMS, held_items, part_rules
from .texts import TYPED_SQL, type_sql, typed_documents

COND_BY_PRIORITY = {"1-URGENT": "chronic kidney disease", "2-HIGH": "stomach ulcer", "3-MEDIUM": "fall history", "5-LOW": "allergy to red bolt"}
COND_RULES = (("kidney_rule", ("hot gear", "cold plate"), ("kidney", "renal"), "high"), ("bleeding_rule", ("old bolt", "red ring"), ("bleed", "ulcer"), "high"),
              ("fall_rule", ("blue widget", "small gizmo"), ("fall",), "medium"))


def safety_inputs(t: Tables):
    terms = small_table(t.spark, TERMS, "term string, advisory_egfr double, warning_egfr double, critical_egfr double")
    renal = j.contained_names(t.part.select("p_name").distinct(), terms, "p_name", "term").select(
        "p_name", "advisory_egfr", "warning_egfr", "critical_egfr", F.lit("medium").alias("default_severity"))
    votes = part_rules(t).select("drug_a", "drug_b", F.when(F.col("severity").isin("low", "medium", "high"), "vetoed").otherwise("approved").alias("outcome"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return {
        "items": held_items(t).withColumn("rx", F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise("dr")), "rules": part_rules(t), "votes": votes,
        "renal_rules": renal,
        "markers": orders.where("o_totalprice > 50000").select("l_orderkey", (F.col("o_totalprice") / 5000).alias("egfr")),
        "renal_flags": orders.select("l_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("has_renal")),
        "conditions": orders.select("l_orderkey", F.coalesce(lookup("o_orderpriority", COND_BY_PRIORITY), F.lit("none")).alias("cond"))}


def findings(t: Tables):
    return safety.safety_findings(**safety_inputs(t), entity="l_orderkey", ident="l_linenumber", item="p_name", prescriber="rx",
                                  components=F.split("p_name", " "), condition="cond", condition_rules=COND_RULES)


COND_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in COND_BY_PRIORITY.items()) + " ELSE 'none' END"
FINDINGS_CTE = f"""
{RULES_CTE}, li AS (SELECT l_orderkey, l_suppkey, p_name, string_split(p_name, ' ') AS parts, row_number() OVER () AS id, l_suppkey % 4 <> 0 AS rx FROM lineitem JOIN part ON l_partkey = p_partkey),
it AS (SELECT DISTINCT l_orderkey, p_name FROM li),
vt AS (SELECT least(x.p_name, y.p_name) AS low, greatest(x.p_name, y.p_name) AS high, count(*) AS n, count(*) FILTER (x.p_size % 4 < 3) AS ve, count(*) FILTER (x.p_size % 4 = 3) AS ap
  FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1 WHERE x.p_name <> y.p_name GROUP BY 1, 2),
f1 AS (SELECT x.l_orderkey AS entity, r.low || '+' || r.high AS item, 'drug_interaction' AS type, CASE WHEN vt.n >= 3 AND ve > ap AND ve / (ve + ap) >= 0.8 THEN 'critical'
   ELSE (['low','medium','high','critical'])[rank] END AS severity FROM rules r JOIN it x ON x.p_name = r.low JOIN it y ON y.l_orderkey = x.l_orderkey AND y.p_name = r.high
   LEFT JOIN vt ON vt.low = r.low AND vt.high = r.high),
dp AS (SELECT a.id, bool_or(b.rx) AS rx FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.p_name = b.p_name AND a.id <> b.id GROUP BY 1),
ov AS (SELECT DISTINCT a.id FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.p_name <> b.p_name AND list_has_any(a.parts, b.parts)),
f2 AS (SELECT DISTINCT l_orderkey, p_name, CASE WHEN dp.id IS NOT NULL THEN 'duplicate' ELSE 'overlap' END, CASE WHEN dp.rx THEN 'high' ELSE 'medium' END
   FROM li LEFT JOIN dp USING (id) LEFT JOIN ov USING (id) WHERE dp.id IS NOT NULL OR ov.id IS NOT NULL),
rr AS (SELECT p_name, adv, warn, crit FROM (SELECT DISTINCT p_name FROM part) JOIN {sql_values(TERMS, 'v(term, adv, warn, crit)')} ON contains(lower(p_name), term)),
rx AS (SELECT l_orderkey, p_name, CASE WHEN o_totalprice > 50000 THEN o_totalprice / 5000 END AS egfr, o_orderpriority = '1-URGENT' AS renal, adv, warn, crit
   FROM it JOIN orders ON o_orderkey = l_orderkey LEFT JOIN rr USING (p_name)),
rb AS (SELECT *, CASE WHEN egfr < crit THEN 'critical' WHEN egfr < warn THEN 'high' WHEN egfr < adv THEN 'medium' END AS band FROM rx),
f3 AS (SELECT l_orderkey, p_name, CASE WHEN egfr IS NULL AND (adv IS NOT NULL OR renal) THEN 'renal_context_missing' WHEN band IS NOT NULL THEN 'renal_clearance_warning'
   WHEN renal AND egfr < 60 THEN 'renal_condition_context' END AS type, CASE WHEN egfr IS NULL THEN 'high' WHEN band IS NOT NULL THEN band ELSE 'medium' END FROM rb),
cd AS (SELECT it.*, {COND_CASE} AS cond FROM it JOIN orders ON o_orderkey = l_orderkey),
f4 AS (SELECT DISTINCT l_orderkey, p_name, rule, severity FROM cd JOIN {sql_values([(n, i, w, sv) for n, its, ws, sv in COND_RULES for i in its for w in ws], 'cr(rule, citem, needle, severity)')} ON citem = p_name AND contains(cond, needle)
   UNION SELECT l_orderkey, p_name, 'allergy_condition_rule', 'critical' FROM cd WHERE contains(cond, 'allerg') AND contains(cond, p_name)),
fs AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 WHERE type IS NOT NULL UNION ALL SELECT * FROM f4)"""


@query("p1_population_findings", f"WITH {FINDINGS_CTE} SELECT * FROM fs")
def p1_findings(t: Tables):
    return findings(t)


RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query("p1_population_safety", f"""
WITH {FINDINGS_CTE}, sm AS (SELECT entity, (['none','low','medium','high','critical'])[max({RANK}) + 1] AS max_severity, count(*) AS findings FROM fs GROUP BY 1),
du AS (SELECT sm.*, o_custkey, o_orderdate FROM sm JOIN orders ON o_orderkey = entity WHERE max_severity IN ('critical', 'high')),
ok AS (SELECT entity FROM du n WHERE NOT EXISTS (SELECT 1 FROM du h WHERE h.o_custkey = n.o_custkey AND h.max_severity = n.max_severity AND h.o_orderdate > n.o_orderdate - INTERVAL 30 DAY
   AND (h.o_orderdate < n.o_orderdate OR (h.o_orderdate = n.o_orderdate AND h.entity < n.entity))))
SELECT sm.entity, max_severity, findings, max_severity IN ('critical', 'high') AS requires_veto, ok.entity IS NOT NULL AS alert FROM sm LEFT JOIN ok USING (entity)""")
def p1(t: Tables):
    summary = safety.safety_summary(findings(t))
    context = t.orders.select(F.col("o_orderkey").alias("entity"), "o_custkey", "o_orderdate")
    out = safety.alerts_to_raise(summary, context, ["o_custkey"], "o_orderdate", 30 * 86400)
    return out.select("entity", "max_severity", "findings", "requires_veto", "alert")


@query("p2_candidate_intake", f"""
WITH {RULES_CTE}, cand AS ({A21_SQL}), hold AS (SELECT p_partkey, bool_or(rank IS NOT NULL) OR bool_or(p_retailprice < 950 AND p_size > 40) AS hold FROM part
   LEFT JOIN (SELECT low AS nm, rank FROM rules UNION ALL SELECT high, rank FROM rules) q ON nm = p_name GROUP BY 1)
SELECT cand.p_partkey, confidence, CASE WHEN status = 'suspicious' THEN 'suspicious' WHEN hold THEN 'veto_required' ELSE 'active' END AS final_status FROM cand JOIN hold USING (p_partkey)""")
def p2(t: Tables):
    rules = j.canonical_rules(part_rules(t))
    named = rules.select(F.explode(F.array("low", "high")).alias("p_name"), "severity").distinct()
    inter = t.part.select("p_partkey", "p_name").join(named, "p_name").select("p_partkey", F.lit("drug_interaction").alias("type"), "severity")
    price = t.part.where("p_retailprice < 950").select(
        "p_partkey", F.when(F.col("p_size") > 40, "renal_clearance_warning").otherwise("renal_context_missing").alias("type"), F.lit("high").alias("severity"))
    return intake.candidate_status(candidate_records(t), inter.unionByName(price), "p_partkey").select("p_partkey", "confidence", "final_status")


P3_BUDGET = 60


def _p3_cut(kind: str) -> str:
    from ..functions.core import substring_pattern
    return sql_literal(substring_pattern(keep_words(kind)))


_KINDS = ("prescription", "lab_report", "discharge_summary", "")
_KEEP_CASE = "CASE " + " ".join(f"WHEN document_type = '{k}' THEN regexp_matches(lower(x), {_p3_cut(k)})" for k in _KINDS[:-1]) + f" ELSE regexp_matches(lower(x), {_p3_cut('')}) END"
NEW_DOCS = f"""SELECT doc_id, source, {sql_clean('text')} AS text FROM (SELECT min(doc_id) AS doc_id, source, any_value(text) AS text FROM ({TYPED_SQL}) WHERE n_chars >= 400 GROUP BY source, sha256(text)) n
 WHERE NOT EXISTS (SELECT 1 FROM ({TYPED_SQL}) h WHERE h.n_chars < 400 AND h.source = n.source AND h.text = n.text)"""
P3_SQL = f"""
WITH nd AS MATERIALIZED ({NEW_DOCS}), ty AS ({type_sql('SELECT * FROM nd')}),
td AS MATERIALIZED (SELECT nd.*, CASE WHEN document_type = 'unknown' THEN 'general_note' ELSE document_type END AS document_type, type_confidence FROM nd JOIN ty USING (doc_id)),
sp AS (SELECT doc_id, document_type, text, list_filter(string_split(text, chr(10)), lambda x: {_KEEP_CASE}) AS kl, list_filter(string_split(text, chr(10)), lambda x: NOT ({_KEEP_CASE})) AS ol FROM td),
wc AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS total, len(list_filter(string_split_regex(array_to_string(kl, ' '), '\\s+'), lambda x: x <> '')) AS k FROM sp),
tr AS (SELECT doc_id, k >= {P3_BUDGET} OR total > least(total, {P3_BUDGET}) AS truncated FROM wc),
lb AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((test_name = 'glucose' AND value NOT BETWEEN 10 AND 800) OR (test_name = 'creatinine' AND value NOT BETWEEN 0.1 AND 30)
   OR (test_name = 'hba1c' AND value NOT BETWEEN 3 AND 20) OR (test_name = 'tsh' AND value NOT BETWEEN 0.001 AND 100)) AS errors FROM ({lab_sql("SELECT doc_id, text FROM td WHERE document_type = 'lab_report'")}) GROUP BY 1),
rx AS (SELECT doc_id, count(*) AS n, 0 AS errors FROM ({rx_sql("SELECT doc_id, text FROM td WHERE document_type = 'prescription'")}) GROUP BY 1),
fd AS (SELECT * FROM lb UNION ALL SELECT * FROM rx)
SELECT doc_id, document_type, truncated, coalesce(n, 0) AS extracted, CASE WHEN coalesce(errors, 0) > 0 THEN 'validation_errors' WHEN type_confidence < 0.7 THEN 'low_confidence'
  WHEN truncated THEN 'context_truncated' ELSE '' END AS review_reason FROM td JOIN tr USING (doc_id) LEFT JOIN fd USING (doc_id)""".replace("'\\\\s+'", "'\\s+'")


@query("p3_document_intake", P3_SQL)
def p3(t: Tables):
    docs = typed_documents(t)
    out = intake.intake(docs.where("n_chars >= 400"), docs.where("n_chars < 400"), owner="source", ident="doc_id", text="text", budget=P3_BUDGET)
    return out["documents"].select("doc_id", "document_type", "truncated", "extracted", "review_reason")


class _Streamed:
    """The tables of a folder, ``documents`` as a stream."""

    def __init__(self, t: Tables):
        self.documents = streams.table_stream(t.spark, t.sf_dir, "documents.parquet")


def _taken(t: Tables) -> str:
    """Folder of the tables that a streamed intake of all long documents has written."""
    folder = scratch(t.spark, "p3")
    jobs.intake_stream(typed_documents(_Streamed(t)).where("n_chars >= 400"), folder, owner="source", ident="doc_id", text="text", history=typed_documents(t).where("n_chars < 400"), budget=P3_BUDGET)
    return folder


TAKEN_SQL = f"nd AS MATERIALIZED ({NEW_DOCS}), ty AS ({type_sql('SELECT * FROM nd')}), td AS MATERIALIZED (SELECT nd.*, document_type FROM nd JOIN ty USING (doc_id))"


@query("p3_labs_taken", f"WITH {TAKEN_SQL} SELECT doc_id, test_name, value, unit FROM ({lab_sql("SELECT doc_id, text FROM td WHERE document_type = 'lab_report'")})")
def p3_labs(t: Tables):
    return t.spark.read.parquet(f"{_taken(t)}/labs").select("doc_id", "test_name", "value", "unit")


@query("p3_items_taken", f"WITH {TAKEN_SQL} SELECT doc_id, item, dose, unit, frequency FROM ({rx_sql("SELECT doc_id, text FROM td WHERE document_type = 'prescription'")})")
def p3_items(t: Tables):
    return t.spark.read.parquet(f"{_taken(t)}/items").select(
        "doc_id", "item", F.coalesce(F.round("dose", 4), F.lit(-1.0)).alias("dose"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("frequency", F.lit("")).alias("frequency"))


@query("p3_documents_taken", P3_SQL)
def p3_documents(t: Tables):
    return t.spark.read.parquet(f"{_taken(t)}/documents").select("doc_id", "document_type", "truncated", "extracted", "review_reason")


@query("p4_evidence_review", f"""
{GATES_SQL}, src AS (SELECT rule_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ev WHERE status = 'ok' GROUP BY 1)
SELECT rule_id, severity, confidence, all_passed, coalesce(sources, '') AS sources, CASE WHEN NOT all_passed THEN 'gates_failed' WHEN confidence < 0.75 THEN 'low_confidence' WHEN severity = 'none' THEN 'no_interaction'
  WHEN severity = 'critical' THEN 'pending_human_approval' WHEN severity = 'high' THEN 'pending_veto' ELSE 'severity_not_promotable' END AS next_state
FROM gates LEFT JOIN src USING (rule_id) WHERE rule_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def p4(t: Tables):
    decided = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rule_id"))
    out = evidence.review(evidence_rows(t), decided, "rule_id", source="source", status="status", severity="severity", context=F.col("rule_id") % 9 != 0,
                          conditions=F.col("rule_id") % 7 != 0, summary=[F.lit("risk"), F.when(F.col("rule_id") % 11 != 0, "why"), F.lit("do")],
                          required=("rxnav", "openfda"))
    return out.select("rule_id", "severity", "confidence", "all_passed", F.coalesce(F.array_join("sources_checked", ","), F.lit("")).alias("sources"), "next_state")


@query("p5_entity_dashboard", f"""
WITH {ROLLUP_CTES}, s AS (SELECT o_custkey, o_orderkey, o_orderdate, {PRIORITY_SQL} AS sev FROM orders),
l AS (SELECT o_custkey, count(*) FILTER (sev = 'critical') AS critical, count(*) FILTER (sev = 'high') AS high, count(*) FILTER (sev NOT IN ('critical', 'high', 'low')) AS medium, count(*) FILTER (sev = 'low') AS low FROM s GROUP BY 1),
n AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rn) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM s) WHERE rn <= 3 GROUP BY 1),
p AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(newest, '') AS newest, coalesce(pending, 0) AS pending, status
FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey JOIN roll USING (c_custkey)""")
def p5(t: Tables):
    al = alerts(t).withColumnRenamed("o_custkey", "c_custkey")
    counts = a.filtered_counts(t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], {"pending": F.col("o_orderstatus") == "P"})
    out = dashboards.dashboard(t.customer.select("c_custkey"), al, counts, rollup(t).select("c_custkey", "status"), entity="c_custkey", severity="severity",
                               message=F.col("o_orderkey").cast("string"), order=[F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return out.select("c_custkey", "critical", "high", "medium", "low", F.array_join("newest_alerts", ",").alias("newest"), "pending", "status")


@query("p6_readiness_packet", """
WITH pt AS (SELECT c_custkey, c_nationkey, 28.0 + (c_custkey * 37 % 1000) / 2000.0 AS lat, 77.0 + (c_custkey * 91 % 1000) / 2000.0 AS lon FROM customer),
h AS (SELECT s_suppkey, 28.0 + (s_suppkey * 53 % 997) / 1994.0 AS plat, 77.0 + (s_suppkey * 29 % 997) / 1994.0 AS plon FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (SELECT c_custkey, s_suppkey, power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2) AS a FROM pt, h)),
nr AS (SELECT c_custkey, arg_min(s_suppkey, km) AS hospital FROM d WHERE km <= 7 GROUP BY 1),
ct AS (SELECT s_nationkey, arg_min(s_name, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END * 10000000000 + s_suppkey) AS contact FROM supplier GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1),
q AS (SELECT c_custkey, coalesce(contact, '') AS contact, coalesce(hospital, -1) AS hospital, 100 - 25 * (contact IS NULL)::INT - 15 * (c_custkey % 3 = 0)::INT - 15 * (hospital IS NULL)::INT - 10 * (hospital IS NULL)::INT - 20 * (c_nationkey < 5)::INT
  - 10 * (n IS NULL)::INT - 5 * (coalesce(latest < TIMESTAMP '2000-01-01', TRUE))::INT AS score FROM pt LEFT JOIN nr USING (c_custkey) LEFT JOIN ct ON s_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, contact, hospital, score, CASE WHEN score >= 85 THEN 'ready' WHEN score >= 60 THEN 'usable_needs_review' ELSE 'incomplete' END AS band FROM q""")
def p6(t: Tables):
    from ..operators.windows import preferred
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    pts = t.customer.select(k, "c_nationkey", (28.0 + (k * 37 % 1000) / 2000.0).alias("lat"), (77.0 + (k * 91 % 1000) / 2000.0).alias("lon"))
    places = t.supplier.select(s, (28.0 + (s * 53 % 997) / 1994.0).alias("plat"), (77.0 + (s * 29 % 997) / 1994.0).alias("plon"))
    near = j.nearest_within(pts, places, "c_custkey", "lat", "lon", "s_suppkey", "plat", "plon").select("c_custkey", "c_nationkey", F.col("nearest").alias("hospital"))
    contact = preferred(t.supplier, ["s_nationkey"], F.when(F.col("s_acctbal") > 5000, 0).otherwise(1), "s_suppkey", ["s_name"]).select(
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("contact"))
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    base = near.join(contact, "c_nationkey", "left").join(orders, "c_custkey", "left")
    missing = {**card_columns(), "missing_caregiver_contacts": F.col("contact").isNull(), "missing_hospital_map": F.col("hospital").isNull(),
               "missing_hospital_phone": F.col("hospital").isNull(), "missing_active_medications": F.col("n").isNull(),
               "missing_recent_medication_log": F.coalesce(F.col("latest") < F.lit("2000-01-01").cast("timestamp_ntz"), F.lit(True))}
    packet = dashboards.readiness(base, missing).select("c_custkey", F.coalesce("contact", F.lit("")).alias("contact"),
                                                         F.coalesce("hospital", F.lit(-1)).alias("hospital"), "score", "band", F.lit(1).alias("version"))
    cache = t.customer.select("c_custkey", F.lit("").alias("contact"), F.lit(-1).cast("bigint").alias("hospital"), F.lit(0).alias("score"), F.lit("").alias("band"))
    return upsert(cache, packet, ["c_custkey"], "version", {n: "overwrite" for n in ("contact", "hospital", "score", "band")})
