"""Sources, sinks and snapshot changes on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import ts
from ..registry import Tables, query
from ..session import scratch
from ..sources import buckets, snapshots, tables

ORDERS_AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"


@query("s1_pushed_scan", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_totalprice > 400000""")
def s1(t: Tables):
    return tables.scan(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"],
                       (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000))


@query("s2_optional_columns", """
SELECT event_id, event_type, FALSE AS processed, 'none' AS reason, value FROM events""")
def s2(t: Tables):
    return (tables.with_optional_columns(t.events, {"processed": False, "reason": "none", "value": 0.0})
            .select("event_id", "event_type", "processed", "reason", "value"))


@query("s3_append_facts", """
SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL""")
def s3(t: Tables):
    path = scratch(t.spark, "append")
    snapshots.append_facts(t.events, f"{path}/facts", time_col="ts", date_col="day")
    return (t.spark.read.parquet(f"{path}/facts")
            .groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n")))


S4_BASE = """
SELECT c_custkey AS custkey, c_acctbal AS last_price,
       CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '1994-01-01' END AS first_seen,
       CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'closed' END AS state,
       CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1994-06-01' END AS expires_at,
       c_custkey % 5 AS uses, c_nationkey = 3 AS flagged FROM customer"""


@query("s4_upsert_policies", f"""
WITH b AS ({S4_BASE}),
u AS (SELECT o_custkey AS custkey, arg_max(o_totalprice, o_orderkey) AS last_price,
             arg_min(o_orderdate, o_orderkey) AS first_seen, arg_max(o_orderdate, o_orderkey) AS expires_at,
             count(*) AS uses, bool_or(o_orderstatus = 'F') AS flagged,
             list_sort(list(DISTINCT o_orderpriority)) AS tags, TRUE AS u
      FROM orders GROUP BY 1)
SELECT custkey, CASE WHEN u.u THEN u.last_price ELSE b.last_price END AS last_price,
       coalesce(b.first_seen, u.first_seen) AS first_seen,
       CASE WHEN u.u IS NULL THEN b.expires_at WHEN b.state = 'pending' THEN b.expires_at
            ELSE u.expires_at END AS expires_at,
       coalesce(b.uses, 0) + coalesce(u.uses, 0) AS uses,
       coalesce(b.flagged, FALSE) OR coalesce(u.flagged, FALSE) AS flagged,
       CASE WHEN u.u IS NULL THEN '2-HIGH' WHEN b.custkey IS NULL THEN array_to_string(u.tags, '|')
            ELSE array_to_string(list_concat(['2-HIGH'], list_filter(u.tags, lambda x: x <> '2-HIGH')), '|') END AS tags
FROM b FULL JOIN u USING (custkey)""")
def s4(t: Tables):
    base, updates = s4_tables(t)
    out = snapshots.upsert(base, updates, ["custkey"], "o_orderkey", S4_POLICIES)
    return out.drop("state").withColumn("tags", F.array_join("tags", "|"))


S4_BUCKETS = 8
S4_POLICIES = {"last_price": "overwrite", "first_seen": "keep", "expires_at": ("keep_if_status", "state", ["pending"]),
               "uses": "increment", "flagged": "or", "tags": "append"}


def s4_tables(t: Tables):
    """Customers as stored rows, orders as updates."""
    k = F.col("c_custkey")
    base = t.customer.select(
        k.alias("custkey"), F.col("c_acctbal").alias("last_price"),
        F.when(k % 2 == 0, ts("1994-01-01")).alias("first_seen"),
        F.when(k % 3 == 0, "pending").otherwise("closed").alias("state"),
        F.when(k % 3 == 0, ts("1994-06-01")).alias("expires_at"),
        (k % 5).alias("uses"), (F.col("c_nationkey") == 3).alias("flagged"),
        F.array(F.lit("2-HIGH")).alias("tags"))
    updates = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("last_price"),
        F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("expires_at"),
        F.lit(1).cast("bigint").alias("uses"), (F.col("o_orderstatus") == "F").alias("flagged"),
        F.array("o_orderpriority").alias("tags"), "o_orderkey")
    return base, updates


@query("s4_bucket_merge", f"""
WITH b AS ({S4_BASE}), o AS (SELECT *, (o_orderdate >= DATE '1995-01-01')::BIGINT * 1000000000000 + o_orderkey AS seq FROM orders),
u AS (SELECT o_custkey AS custkey, arg_max(o_totalprice, seq) AS last_price, arg_min(o_orderdate, seq) AS first_seen,
             arg_max(o_orderdate, seq) AS expires_at, count(*) AS uses, bool_or(o_orderstatus = 'F') AS flagged,
             list(DISTINCT o_orderpriority) AS tags, TRUE AS u FROM o GROUP BY 1)
SELECT custkey, CASE WHEN u.u THEN u.last_price ELSE b.last_price END AS last_price, coalesce(b.first_seen, u.first_seen) AS first_seen,
       CASE WHEN u.u IS NULL OR b.state = 'pending' THEN b.expires_at ELSE u.expires_at END AS expires_at,
       coalesce(b.uses, 0) + coalesce(u.uses, 0) AS uses, coalesce(b.flagged, FALSE) OR coalesce(u.flagged, FALSE) AS flagged,
       array_to_string(list_sort(list_distinct(list_concat(CASE WHEN b.custkey IS NULL THEN [] ELSE ['2-HIGH'] END, coalesce(u.tags, [])))), '|') AS tags
FROM b FULL JOIN u USING (custkey)""")
def s4_buckets(t: Tables):
    """Orders before 1995 and after come as two batches into a table in buckets; the second is handed over twice."""
    table = f"{scratch(t.spark, 'buckets')}/customers"
    base, updates = s4_tables(t)
    buckets.create(base, table, ["custkey"], S4_BUCKETS)
    early = F.col("first_seen") < ts("1995-01-01")
    for number, rows in ((0, updates.where(early)), (1, updates.where(~early)), (1, updates.where(~early))):
        buckets.merge(t.spark, table, rows, ["custkey"], "o_orderkey", S4_POLICIES, number, buckets=S4_BUCKETS)
    return buckets.read(t.spark, table).drop("state").withColumn("tags", F.array_join(F.array_sort("tags"), "|"))


S5_ALLOWED = {"done": ["O"], "failed": ["O", "P"]}


@query("s5_guarded_transition", f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'failed' END AS to_status
           FROM orders WHERE o_orderpriority = '1-URGENT'),
j AS (SELECT o.o_orderkey, o.o_orderstatus, r.to_status,
        coalesce((r.to_status = 'done' AND o.o_orderstatus = 'O')
              OR (r.to_status = 'failed' AND o.o_orderstatus IN ('O', 'P')), FALSE) AS ok
      FROM orders o LEFT JOIN r USING (o_orderkey))
SELECT o_orderkey, CASE WHEN ok THEN to_status ELSE o_orderstatus END AS status,
       CASE WHEN ok AND to_status = 'done' THEN '{ORDERS_AS_OF}' ELSE '' END AS completed_at,
       ok AS applied, to_status IS NOT NULL AND NOT ok AS rejected FROM j""")
def s5(t: Tables):
    requests = t.orders.where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise("failed").alias("to"),
        F.col("o_orderdate").alias("at"))
    snap, log = snapshots.transition(
        t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), requests, "o_orderkey",
        "status", "to", "at", S5_ALLOWED, as_of=ORDERS_AS_OF, stamps={"done": "completed_at"})
    return snap.join(log, "o_orderkey", "left").select(
        "o_orderkey", "status",
        F.coalesce(F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("completed_at"),
        F.coalesce("applied", F.lit(False)).alias("applied"),
        (F.col("applied").isNotNull() & ~F.col("applied")).alias("rejected"))


@query("s6_delete_with_cancel", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN o_orderkey IS NOT NULL AND l_linestatus = 'O' THEN 'cancelled' ELSE l_linestatus END AS status
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_totalprice < 20000) ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, 0, 'owner' FROM orders WHERE o_totalprice >= 20000""")
def s6(t: Tables):
    deps = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("status"),
                             F.to_json(F.struct(F.col("l_orderkey").alias("target_id"))).alias("payload"))
    kept, changed = snapshots.delete_with_cancel(
        t.orders.select("o_orderkey"), deps,
        t.orders.where("o_totalprice < 20000").select("o_orderkey"), "o_orderkey",
        F.get_json_object("payload", "$.target_id"), "status", ["O"])
    return changed.drop("payload").unionByName(kept.select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("owner").alias("status")))


@query("s7_supersede", """
SELECT event_id, coalesce(lead(event_id) OVER w, -1) AS superseded_by, lead(ts) OVER w AS closed_at,
       lead(event_id) OVER w IS NULL AS is_current
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def s7(t: Tables):
    return (snapshots.supersede(t.events, ["user_id", "event_type"], ["ts", "event_id"], "event_id")
            .select("event_id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), "closed_at",
                    "is_current"))


@query("s8_seed_if_empty", """
SELECT n_nationkey AS id, n_name AS name FROM nation
UNION ALL SELECT r_regionkey, r_name FROM region
UNION ALL SELECT n_nationkey, n_name FROM nation""")
def s8(t: Tables):
    nation = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    region = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    full = snapshots.seed_if_empty(nation, F.lit(True), region)
    return full.unionByName(snapshots.seed_if_empty(region, F.lit(False), nation))


@query("s9_new_content", """
WITH a AS (SELECT min(doc_id) AS doc_id, lang, sha256(text) AS content_hash FROM documents
           WHERE doc_id % 10 <> 0 GROUP BY lang, sha256(text))
SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM documents h WHERE h.doc_id % 10 = 0
  AND h.lang = a.lang AND sha256(h.text) = a.content_hash)""")
def s9(t: Tables):
    old = F.col("doc_id") % 10 == 0
    docs = t.documents.select("doc_id", "lang", "text")
    return tables.new_content(docs.where(~old), docs.where(old), ["lang"], "text", "doc_id") \
        .select("doc_id", "lang", "content_hash")


S10_MIME = ["image/png", "audio/ogg", "application/pdf", "text/html"]


@query("s10_task_type", f"""
SELECT page_id, CASE WHEN mime LIKE 'image/%' THEN 'ocr_prescription' WHEN mime LIKE 'audio/%' THEN 'transcribe_audio'
  WHEN mime = 'application/pdf' THEN 'parse_pdf' ELSE '' END AS task
FROM (SELECT page_id, ({S10_MIME}::VARCHAR[])[length(url) % 4 + 1] AS mime FROM pages)""")
def s10(t: Tables):
    mime = F.element_at(F.array(*[F.lit(m) for m in S10_MIME]), F.length("url") % 4 + 1)
    return t.pages.select("page_id", tables.task_type(mime).alias("task"))


@query("s11_json_columns", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
  CASE WHEN json_extract_string(props, '$.missing') IS NULL THEN 'absent' ELSE 'set' END AS missing FROM events
UNION ALL SELECT -event_id, -1, 'absent' FROM events""")
def s11(t: Tables):
    schema = "k BIGINT, missing STRING"
    broken = t.events.select((-F.col("event_id")).alias("event_id"), F.lit(None).cast("string").alias("props"))
    rows = t.events.select("event_id", "props").unionByName(broken)
    js = tables.read_json_column("props", schema)
    return rows.select("event_id", F.coalesce(js["k"], F.lit(-1)).alias("k"),
                       F.when(js["missing"].isNull(), "absent").otherwise("set").alias("missing"))


@query("s12_strip_nul", """
SELECT doc_id, text AS clean, length(text) AS n FROM documents""")
def s12(t: Tables):
    dirty = t.documents.select("doc_id", F.concat(F.lit("\0"), F.replace("text", F.lit("."), F.lit(".\0"))).alias("clean"))
    return tables.strip_nul(dirty, ["clean"]).withColumn("n", F.length("clean"))
