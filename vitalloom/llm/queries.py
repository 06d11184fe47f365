"""Queries of the language-data operators on the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (centroid_clustering, decontamination, embedding_dedup, html_extraction, license_scan, minhash_dedup, packing, passage_dedup, pii, quality_classifier, sharding,
               source_audit, suffix_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; ``table(name)`` opens one of the given tables whole."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer() -> str:
    """The public vocabulary file of the packing query."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1(table):
    return packing.pack(table("documents"), tokenizer(), keep_ids=False)


@query("op9_quality_classifier")
def op9(table):
    return quality_classifier.classify(table("documents"), table("labels"))


OP8_SQL = """
WITH RECURSIVE cleaned AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM cleaned)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
roots AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.doc_id = d.doc_id
"""


@query("op8_minhash_near_dedup", OP8_SQL)
def op8(table):
    return minhash_dedup.near_duplicates(table("documents"))


OP6_SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN wins w ON p.n = w.n AND p.s = w.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6(table):
    return decontamination.contaminated(table("documents"), table("benchmark"))


@query("op10_license_scan")
def op10(table):
    return license_scan.scan(table("documents")).drop("places")


@query("op2_pii_weak_supervision")
def op2(table):
    found = pii.find(table("documents"))
    base = F.filter("found", lambda c: c["base"])
    counts = [F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


@query("op5_html_extraction")
def op5(table):
    return html_extraction.extract(table("pages"))


OP7_SQL = """
WITH RECURSIVE raw AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM raw
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT x AS vec_id, min(y) AS low FROM reach GROUP BY x),
degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id <= coalesce(low, e.vec_id) AS kept
FROM raw e LEFT JOIN roots r ON r.vec_id = e.vec_id LEFT JOIN degree g ON g.vec_id = e.vec_id
"""


@query("op7_embedding_near_dedup", OP7_SQL)
def op7(table):
    return embedding_dedup.near_duplicates(table("embeddings"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
dup AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM s SEMI JOIN dup ON s.h = dup.h),
numbered AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, g),
edges AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
cut AS (
  SELECT d.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""


@query("op4_suffix_array_dedup", OP4_SQL)
def op4(table):
    out = suffix_dedup.deduplicate(table("documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_substring_dedup")
def op3(table):
    out = passage_dedup.repeated_passages(table("documents"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), covered.alias("n_repeated"), listed.alias("spans"), "component_id")


@query("op11_sharding")
def op11(table):
    body = F.coalesce("text", F.lit(""))
    rows = table("documents").select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffled(rows, 16)
    return dealt.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
kept AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY lang, t HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) SEMI JOIN kept USING (lang, t) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
p AS (SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f JOIN v USING (lang)),
l AS (SELECT lang, t, sum(n)::BIGINT AS n FROM f GROUP BY lang, t),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12(table):
    return source_audit.audit(table("documents"))


def op13_sql(clusters: int = 8, rounds: int = 10, size: int = 64) -> str:
    """One common table per step of each round."""
    near = """a{r} AS MATERIALIZED (
  SELECT vec_id, v, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place
    FROM (SELECT k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k CROSS JOIN m{r} m))
  WHERE place = 1)"""
    mean = """m{n} AS MATERIALIZED (
  SELECT m{r}.c, coalesce(x.v, m{r}.v) AS v FROM m{r} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {size} + 1) t(i) GROUP BY c, i) GROUP BY c) x ON x.c = m{r}.c)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [mean.format(n=r + 1, r=r, size=size), near.format(r=r + 1)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)::BIGINT) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(e) = {size} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN m{rounds} m ON m.c = a.c
"""


@query("op13_centroid_clustering", op13_sql())
def op13(table):
    return centroid_clustering.with_inertia(*centroid_clustering.cluster(table("embeddings")))
