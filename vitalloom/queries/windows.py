"""Windows, orders, limits and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import lookup, severity_rank, ts
from ..functions.encoding import encoder
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import windows as w
from ..registry import Tables, query, sql_literal
from ..session import written
from .aggregates import CENTROID_CTES, PRIORITY_SQL, alerts
from .joins import ITEMS_CTE, RULES_CTE, held_items, part_rules
from .records import EVENTS_AS_OF, ORDERS_AS_OF


@query("w1_latest_n", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank
FROM orders) WHERE rank <= 3""")
def w1(t: Tables):
    return w.latest_n(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
                      [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("w2_latest_marker", """
SELECT DISTINCT ON (user_id, lower(event_type)) user_id, lower(event_type) AS marker, value FROM (
  SELECT *, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS t FROM events)
ORDER BY user_id, lower(event_type), t DESC NULLS LAST, event_id DESC""")
def w2(t: Tables):
    rows = t.events.select("user_id", F.lower("event_type").alias("marker"), "value", "event_id",
                           F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("t"))
    return w.latest_per(rows, ["user_id", "marker"], ["t", "event_id"], ["value"])


KINDS = {"click": "veto_window", "view": "appointment_confirm", "error": "appointment_draft", "purchase": "medication_confirmation",
         "signup": "new_med"}


def contexts(t: Tables):
    return t.events.where(F.col("ts") <= ts(EVENTS_AS_OF)).select(
        "user_id", lookup("event_type", KINDS).alias("kind"), "ts", "event_id",
        F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("explicit"))


W3_SQL = f"""
SELECT user_id, event_id, kind, ends >= TIMESTAMP '{EVENTS_AS_OF}' AS active, ends AS expires_at FROM (
  SELECT DISTINCT ON (user_id) user_id, event_id, CASE event_type WHEN 'click' THEN 'veto_window' WHEN 'view' THEN 'appointment_confirm'
     WHEN 'error' THEN 'appointment_draft' WHEN 'purchase' THEN 'medication_confirmation' ELSE 'new_med' END AS kind,
   CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 9 HOUR ELSE ts + CASE event_type WHEN 'click' THEN INTERVAL 180 SECOND WHEN 'signup' THEN INTERVAL 180 SECOND
     WHEN 'view' THEN INTERVAL 72 HOUR ELSE INTERVAL 2 HOUR END END AS ends
  FROM events WHERE ts <= TIMESTAMP '{EVENTS_AS_OF}' ORDER BY user_id, ts DESC, event_id DESC)"""


@query("w3_open_context", W3_SQL)
def w3(t: Tables):
    return w.open_context(contexts(t), "user_id", "kind", "ts", "explicit", "event_id", EVENTS_AS_OF).select(
        "user_id", "event_id", "kind", "active", "expires_at")


LABS = {"click": "glucose", "view": "creatinine", "error": "hba1c", "purchase": "sodium", "signup": "mystery"}


@query("w4_value_jumps", """
WITH l AS (SELECT *, CASE event_type WHEN 'click' THEN 'glucose' WHEN 'view' THEN 'creatinine' WHEN 'error' THEN 'hba1c' WHEN 'purchase' THEN 'sodium' ELSE 'mystery' END AS test,
  lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, CASE WHEN (test = 'glucose' AND value NOT BETWEEN 10 AND 800) OR (test = 'creatinine' AND value NOT BETWEEN 0.1 AND 30)
   OR (test = 'hba1c' AND value NOT BETWEEN 3 AND 20) OR (test = 'sodium' AND value NOT BETWEEN 100 AND 180) THEN 'limit'
  WHEN prev > 0 AND value > 0 AND greatest(value / prev, prev / value) > 5 THEN 'jump' ELSE 'ok' END AS state FROM l""")
def w4(t: Tables):
    rows = t.events.withColumn("test", lookup("event_type", LABS))
    return w.value_jumps(rows, ["user_id", "test"], ["ts", "event_id"], "test", "value").select("event_id", "state")


@query("w5_first_occurrence", r"""
WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM l),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM e)
SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line FROM k WHERE key <> '' GROUP BY doc_id, key""")
def w5(t: Tables):
    return w.first_occurrences(t.documents.select("doc_id", "text"), "doc_id", w.lines_of("text"))


LAB_LINES = ["Glucose", "90.5", "mg/dL", "70 - 110", "Creatinine", "H", "2.4", "H", "0.6-1.2 range", "Sodium", "Potassium", "4"]


def vertical_docs(t: Tables):
    """Each document with a small lab table after its own text, its first value from the row's length."""
    block = "\n".join(LAB_LINES[2:])
    return t.documents.select("doc_id", F.concat_ws("\n", "text", F.lit("Glucose"), F.col("n_chars").cast("string"), F.lit(block)).alias("text"))


def lab_line_name(line):
    low = F.lower(F.trim(line))
    return F.when(low.isin("glucose", "creatinine", "sodium", "potassium"), low)


@query("w6_line_lookahead", """
SELECT doc_id, test_name, value, unit, flag, low, high FROM (
  SELECT doc_id, 'glucose' AS test_name, n_chars::DOUBLE AS value, 'mg/dL' AS unit, '' AS flag, 70.0::DOUBLE AS low, 110.0::DOUBLE AS high FROM documents
  UNION ALL SELECT doc_id, 'creatinine', 2.4, '', 'H', 0.6, 1.2 FROM documents
  UNION ALL SELECT doc_id, 'potassium', 4.0, '', '', -1.0, -1.0 FROM documents)""")
def w6(t: Tables):
    out = w.line_lookahead(vertical_docs(t), "doc_id", w.lines_of("text"), lab_line_name)
    return out.select("doc_id", "test_name", "value", F.coalesce("unit", F.lit("")).alias("unit"),
                      F.coalesce("flag", F.lit("")).alias("flag"), F.coalesce("low", F.lit(-1.0)).alias("low"),
                      F.coalesce("high", F.lit(-1.0)).alias("high"))


@query("w7_negation_proximity", """
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS tk FROM documents),
e AS (SELECT doc_id, tk, generate_subscripts(tk, 1) AS i, unnest(tk) AS w FROM t),
h AS (SELECT doc_id, bool_or(CASE WHEN w = 'anea' THEN list_has_any(tk[greatest(i - 4, 1):i + 4], ['ing', 'not', 'er'])
  WHEN w = 'of' AND tk[i + 1] = 'the' THEN list_has_any(tk[greatest(i - 4, 1):i + 5], ['ing', 'not', 'er']) ELSE FALSE END) AS negated FROM e GROUP BY 1)
SELECT doc_id, coalesce(negated, FALSE) AS negated FROM documents LEFT JOIN h USING (doc_id)""")
def w7(t: Tables):
    return t.documents.select("doc_id", w.negation_near("text", ["anea", "of the"], ["ing", "not", "er"]).alias("negated"))


W8_SQL = f"""
WITH {RULES_CTE}, it AS (SELECT l_orderkey, p_name, max(l_shipdate) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t DESC, p_name) AS rk FROM it),
pr AS (SELECT a.l_orderkey, a.p_name AS item, b.p_name AS partner, row_number() OVER (PARTITION BY a.l_orderkey, a.p_name ORDER BY b.rk) AS rank
  FROM rk a JOIN rk b ON a.l_orderkey = b.l_orderkey AND b.rk > a.rk
  WHERE NOT EXISTS (SELECT 1 FROM rules WHERE low = least(a.p_name, b.p_name) AND high = greatest(a.p_name, b.p_name)))
SELECT * FROM pr WHERE rank <= 3"""


@query("w8_new_pair_cap", W8_SQL)
def w8(t: Tables):
    return w.new_pairs(held_items(t), j.canonical_rules(part_rules(t)), "l_orderkey", "p_name", "l_shipdate", cap=3)


@query("w9_named_or_newest", """
WITH r AS (SELECT conv_id, turn, lower(text) || ' ' || (['click','view','error','purchase','signup','none'])[(conv_id + turn) % 6 + 1] AS msg FROM conversations),
l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
m AS (SELECT r.conv_id, r.turn, event_id, event_type, rn, contains(msg, event_type) AS named FROM r JOIN l ON user_id = conv_id WHERE rn <= 5),
p AS (SELECT *, bool_or(named) OVER (PARTITION BY conv_id, turn) AS any_named FROM m)
SELECT conv_id, turn, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rn) AS k FROM p WHERE named OR NOT any_named) WHERE k <= 3""")
def w9(t: Tables):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "error", "purchase", "signup", "none")]),
                        ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    reqs = t.conversations.select("conv_id", "turn", F.concat_ws(" ", "text", tail).alias("msg"))
    out = w.named_or_newest(reqs, t.events.select("user_id", "event_id", "event_type", "ts"), "conv_id", "user_id", "msg",
                            "event_type", [F.col("ts").desc(), F.col("event_id").desc()], ["event_id"])
    return out.select("conv_id", "turn", "event_type", "event_id")


@query("t1_rank_then_time", f"""
SELECT o_orderkey, s AS severity FROM (SELECT o_orderkey, o_orderdate, {PRIORITY_SQL} AS s FROM orders)
ORDER BY CASE s WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey LIMIT 12""")
def t1(t: Tables):
    s = F.col("severity")
    rank = F.when(s == "critical", 1).when(s == "high", 2).when(s == "medium", 3).otherwise(4)
    return w.top_by(alerts(t).select("o_orderkey", "o_orderdate", "severity"), [rank, F.col("o_orderdate").desc(), F.col("o_orderkey")],
                    12).select("o_orderkey", "severity")


@query("t2_first_time_desc", """
SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate - INTERVAL 30 DAY END) DESC NULLS LAST, o_orderkey LIMIT 8""")
def t2(t: Tables):
    when = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")),
                      F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")))
    return w.top_by(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), [when.desc_nulls_last(), F.col("o_orderkey")], 8).select("o_orderkey")


@query("t3_due_batch", f"""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' AND o_orderdate <= TIMESTAMP '{ORDERS_AS_OF}'
ORDER BY o_orderdate, o_orderkey LIMIT 25""")
def t3(t: Tables):
    due = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderdate") <= ts(ORDERS_AS_OF))
    return w.due_batch(t.orders, due, [F.col("o_orderdate"), F.col("o_orderkey")], 25).select("o_orderkey")


@query("t4_sorted_findings", f"""
WITH f AS (SELECT o_custkey, o_orderkey, {PRIORITY_SQL} AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, string_agg(s || ':' || o_orderkey, ',' ORDER BY CASE s WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 2 END DESC, rn) AS findings
FROM f WHERE rn <= 5 GROUP BY 1""")
def t4(t: Tables):
    lists = a.top_n_list(alerts(t), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")],
                         F.struct("severity", "o_orderkey"), 5, "findings")
    return lists.select("o_custkey", F.array_join(F.transform(w.sort_findings("findings"), lambda x: F.concat(
        x["severity"], F.lit(":"), x["o_orderkey"].cast("string"))), ",").alias("findings"))


@query("t5_nearest_label", f"""
WITH {CENTROID_CTES},
s AS (SELECT vec_id, c.label, sum(e.v * c.v) / (sqrt(sum(e.v * e.v)) * sqrt(sum(c.v * c.v))) AS score FROM (
   SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) e JOIN cent c USING (pos) WHERE c.label <> 9 GROUP BY 1, 2),
b AS (SELECT vec_id, arg_max(label, score) AS label, max(score) AS score FROM s GROUP BY 1)
SELECT vec_id, round(score, 5) AS score, CASE WHEN score >= CASE label WHEN 3 THEN 0.4 ELSE 0.2 END THEN label::VARCHAR ELSE 'unknown' END AS predicted FROM b""")
def t5(t: Tables):
    cents = a.label_centroids(t.embeddings, "label", "embedding", 64)
    out = a.nearest_label(t.embeddings, cents, "label", "embedding", ["vec_id"], thresholds={3: 0.4}, default_threshold=0.2, blocked=[9])
    return out.select("vec_id", F.round("score", 5).alias("score"), "predicted")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """A model without weights: how often each letter stands in a text."""
    return lambda texts: [[low.count(x) for x in LETTERS] for low in map(str.lower, texts)]


@query("t5_encoded_label", f"""
WITH t AS (SELECT doc_id, quality, lower(text) AS l FROM documents LEFT JOIN labels USING (doc_id)),
u AS (SELECT doc_id, quality, x, (length(l) - length(replace(l, x, '')))::DOUBLE AS v FROM t, (SELECT unnest(string_split('{LETTERS}', '')) AS x)),
m AS (SELECT quality AS label, x, avg(v) AS v FROM u WHERE quality IS NOT NULL GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1),
cent AS (SELECT label, x, v / norm AS v FROM m JOIN n USING (label)),
s AS (SELECT doc_id, label, CASE WHEN sum(u.v * u.v) > 0 THEN sum(u.v * c.v) / sqrt(sum(u.v * u.v)) ELSE 0 END AS score FROM u JOIN cent c USING (x) GROUP BY 1, 2)
SELECT doc_id, round(max(score), 5) AS score, CASE WHEN max(score) >= 0.9 THEN arg_max(label, round(score, 9) - label * 1e-10)::VARCHAR ELSE 'unknown' END AS predicted FROM s GROUP BY 1""")
def t5_encoded(t: Tables):
    """Documents encoded by a user's model, each given the nearest of the labels' mean vectors."""
    vectors = written(t.documents.select("doc_id", encoder(letter_counts)("text").alias("v")), "vectors")
    cents = a.label_centroids(vectors.join(t.labels.select("doc_id", "quality"), "doc_id"), "quality", "v", len(LETTERS))
    out = a.nearest_label(vectors, cents, "quality", "v", ["doc_id"], default_threshold=0.9)
    return out.select("doc_id", F.round("score", 5).alias("score"), "predicted")


@query("x23_cosine_scores", f"""
WITH {CENTROID_CTES}
SELECT vec_id, label, round(sum(e.v * c.v) / sqrt(sum(e.v * e.v)), 5) AS score FROM (
   SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) e JOIN cent c USING (label, pos) GROUP BY 1, 2""")
def x23(t: Tables):
    cents = a.label_centroids(t.embeddings, "label", "embedding", 64)
    return t.embeddings.join(cents, "label").select("vec_id", "label", F.round(a.cosine("embedding", "centroid"), 5).alias("score"))


@query("t6_first_preferred", """
SELECT c_nationkey, arg_min(c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 0 ELSE 1 END * 10000000000 + c_custkey) AS contact FROM customer GROUP BY 1""")
def t6(t: Tables):
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)
    return w.preferred(t.customer, ["c_nationkey"], rank, "c_custkey", ["c_name"]).withColumnRenamed("c_name", "contact")


@query("u1_union_distinct", """
SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000""")
def u1(t: Tables):
    o = t.orders
    return w.union_distinct(o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")),
                            o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")),
                            t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("id")))


@query("u2_union_findings", """
SELECT user_id AS entity, 'lab' AS type, event_type AS item, 'medium' AS severity FROM events WHERE value > 150
UNION ALL SELECT o_custkey, 'task', '', o_orderpriority FROM orders WHERE o_totalprice > 480000""")
def u2(t: Tables):
    labs = t.events.where("value > 150").select(F.col("user_id").alias("entity"), F.lit("lab").alias("type"),
                                                F.col("event_type").alias("item"), F.lit("medium").alias("severity"))
    tasks = t.orders.where("o_totalprice > 480000").select(F.col("o_custkey").alias("entity"), F.lit("task").alias("type"),
                                                           F.col("o_orderpriority").alias("severity"))
    shape = {"entity": "bigint", "type": "string", "item": "string", "severity": "string"}
    return w.union_findings(shape, labs, tasks).withColumn("item", F.coalesce("item", F.lit("")))


@query("u3_set_difference", """
SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000""")
def u3(t: Tables):
    return w.missing_from(t.nation.select(F.col("n_nationkey").alias("k")),
                          t.supplier.where("s_acctbal > 7000").select(F.col("s_nationkey").alias("k")), ["k"])


@query("u4_set_intersection", """
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), ',') AS shared
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey""")
def u4(t: Tables):
    n = t.part.select("p_partkey", F.split("p_name", " ").alias("parts"))
    return (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .join(n.select(F.col("p_partkey").alias("l_partkey"), F.col("parts").alias("a")), "l_partkey")
            .join(n.select(F.col("p_partkey").alias("l_suppkey"), F.col("parts").alias("b")), "l_suppkey")
            .select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared")))
