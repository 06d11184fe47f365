"""Document and message text on the given tables.

The given prose holds no care words, so each row's own text is kept whole and
a care phrase chosen by its key is added to it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.core import substring_pattern
from ..operators import aggregates as a
from ..operators import documents as d
from ..registry import Tables, query, sql_literal, sql_values


def pick(values, key):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, key: str) -> str:
    return f"({sql_literal(list(values))})[({key}) % {len(values)} + 1]"


def sql_replace(text: str, mapping) -> str:
    """Whole-token replacement in SQL: same framing by two blanks, nested replaces."""
    out = f"(' ' || replace(trim({text}), ' ', '  ') || ' ')"
    for old, new in sorted(mapping.items(), key=lambda kv: len(kv[0]), reverse=True):
        frame = lambda p: "' " + "  ".join(p.lower().split()).replace("'", "''") + " '"
        out = f"replace({out}, {frame(old)}, {frame(new)})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def sql_squeeze(text: str) -> str:
    return (f"array_to_string([{text}[i] for i in range(1, length({text}) + 1) if not (i > 2 and {text}[i] = {text}[i - 1] "
            f"and {text}[i] = {text}[i - 2])], '')")


def sql_tokens(mapping, keep: bool = False) -> str:
    """Token map in SQL over the list ``tk``."""
    m = "MAP {" + ", ".join(f"{sql_literal(k)}: {sql_literal(x)}" for k, x in mapping.items()) + "}"
    body = f"coalesce(({m})[tk[i]], tk[i])"
    if keep:
        body = f"CASE WHEN tk[i] IN {v.NEGATED_TOKENS} AND i > 1 AND tk[i - 1] IN {v.NEGATORS} THEN tk[i] ELSE {body} END"
    return f"array_to_string([{body} for i in range(1, len(tk) + 1)], ' ')"


MESSAGES = ["Heloo doctar, dawai nhi li!!!", "chestpain   abhi", "plz book appmnt 4 me", "seene mein dard ho raha", "soooo tired",
            "tab let suger report", "nahi li u r gr8", "12345", "bhool gya"]


def messages(t: Tables):
    key = F.col("conv_id") + F.col("turn")
    return t.conversations.select("conv_id", "turn", "role", F.concat_ws(" ", "text", pick(MESSAGES, key)).alias("msg"))


MSG_SQL = f"SELECT conv_id, turn, role, text || ' ' || {pick_sql(MESSAGES, 'conv_id + turn')} AS msg FROM conversations"
FIRST = {**{k: v.TOKEN_REPAIRS.get(x, x) for k, x in v.SHORTHAND.items()}, **{k: x for k, x in v.TOKEN_REPAIRS.items() if k not in v.SHORTHAND}}
NORMAL_SQL = rf"""
WITH m0 AS ({MSG_SQL}), m1 AS (SELECT *, lower(msg) AS l FROM m0), m2 AS (SELECT conv_id, turn, {sql_squeeze('l')} AS s FROM m1),
m3 AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(s, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM m2),
m4 AS (SELECT conv_id, turn, {sql_replace(sql_replace('s', v.PHRASE_REPAIRS), {k: x for k, x in v.ALIASES.items() if ' ' in k})} AS s FROM m3),
m6 AS (SELECT conv_id, turn, {sql_tokens(FIRST)} AS s FROM (SELECT *, string_split(s, ' ') AS tk FROM m4)),
m7 AS (SELECT conv_id, turn, {sql_tokens({k: x for k, x in v.ALIASES.items() if ' ' not in k}, keep=True)} AS s FROM (SELECT *, string_split(s, ' ') AS tk FROM m6)),
m8 AS (SELECT conv_id, turn, {sql_replace(sql_replace('s', v.SPLIT_REPAIRS), v.PHRASE_REPAIRS)} AS s FROM m7)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[a-z]') THEN s ELSE '' END AS normal FROM m8"""


@query("x1_normalize", NORMAL_SQL)
def x1(t: Tables):
    return messages(t).select("conv_id", "turn", d.normalize("msg").alias("normal"))


@query("x3_clean_spoken")
def x3(t: Tables):
    spoken = F.concat_ws(" ", "text", pick(["um um please note the the dose", "haan ji matlab matlab 10:30", "actually, stop-it/now"], F.col("doc_id")))
    return t.documents.select("doc_id", d.clean_spoken(spoken).alias("clean"))


ITEM_TEXTS = ["Tab. Ecosprin AV 75 mg", "Telma-AM", "Syrup", "Cap. Metoprolol Succinate 25mg", "Met XL (50 mg)", "warfarin", ""]


@query("x4_normalize_item", f"""
WITH a AS (SELECT p_partkey, lower(trim({pick_sql(ITEM_TEXTS, 'p_partkey')} || ' ' || p_name)) AS t FROM part),
b AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\b(?:tab|tablet|cap|capsule|inj|syrup|fab|pab)\\.?\\s+', '', 'g'),
  '\\b\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|g|ml|iu|units?)\\b', '', 'g'), '[^a-z0-9+ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM a)
SELECT p_partkey, coalesce((SELECT arg_min(canon, CASE WHEN alias = t THEN 0 ELSE n + 1 END) FROM {sql_values([(n, k, x) for n, (k, x) in enumerate(v.ITEM_ALIASES.items())], 'al(n, alias, canon)')} WHERE contains(t, alias)), t) AS item
FROM b""".replace("\\\\", "\\"))
def x4(t: Tables):
    return t.part.select("p_partkey", d.normalize_item(F.concat(pick(ITEM_TEXTS, F.col("p_partkey")), F.lit(" "), "p_name")).alias("item"))


@query("x5_components", """
SELECT p_partkey, unnest(list_filter(list_transform(string_split_regex(lower(p_type || '/' || p_brand || ' + ' || p_name), '[/+]'), lambda x: trim(x)), lambda x: x <> '')) AS component FROM part""")
def x5(t: Tables):
    return t.part.select("p_partkey", F.explode(d.split_components(F.concat("p_type", F.lit("/"), "p_brand", F.lit(" + "), "p_name"))).alias("component"))


LAB_SPELLINGS = ["Hb", "Serum Creatinine", "T3 - Free", "Random Blood Sugar", "Oxygen Saturation!"]


@query("x8_canonical_lab", f"""
SELECT p_partkey, coalesce(canon, replace(t, ' ', '_')) AS lab FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_name
   ELSE {pick_sql(LAB_SPELLINGS, 'p_partkey')} END), '[^a-z0-9% ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM part)
LEFT JOIN {sql_values(v.ALL_LAB_ALIASES.items(), 'al(spelling, canon)')} ON spelling = t""".replace("\\\\", "\\"))
def x8(t: Tables):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(pick(LAB_SPELLINGS, F.col("p_partkey")))
    return t.part.select("p_partkey", d.canonical_lab(raw).alias("lab"))


DOC_TAILS = ["Tab. Metformin 500 mg BD after food", "Discharged today, follow up in 2 weeks, hospital stay", "known case of diabetes purana rog allergy",
             "CBC test result: glucose 110 mg/dL reference range low high", "please refer to specialist, urgent evaluation", "note", ""]


def typed_documents(t: Tables):
    return t.documents.select("doc_id", "source", "n_chars", F.concat_ws("\n", "text", pick(DOC_TAILS, F.col("doc_id"))).alias("text"))


TYPED_SQL = f"SELECT doc_id, source, n_chars, text || chr(10) || {pick_sql(DOC_TAILS, 'doc_id')} AS text FROM documents"
TYPE_ROWS = [(n, k, x, max(3, min(len(d.type_words(k)), 8))) for n, k in enumerate(v.TYPE_WORDS) for x in d.type_words(k)]
def type_sql(source: str) -> str:
    """SQL twin of the document typing of any (doc_id, text) source."""
    return f"""
SELECT doc_id, CASE WHEN score > 0.1 THEN kind ELSE 'unknown' END AS document_type, round(score, 2) AS type_confidence FROM (
  SELECT doc_id, arg_max(kind, score * 1000000 - n) AS kind, max(score) AS score FROM (
    SELECT doc_id, n, kind, sum(contains(lower(text), word)::INT) / any_value(size) AS score
    FROM ({source}), {sql_values(TYPE_ROWS, 'tw(n, kind, word, size)')} GROUP BY doc_id, n, kind) GROUP BY 1)"""


TYPE_SQL = type_sql(TYPED_SQL)


@query("x16_document_type", TYPE_SQL)
def x16(t: Tables):
    return d.document_type(typed_documents(t), "text").select("doc_id", "document_type", "type_confidence")


def _sum_sql(words, patterns):
    parts = [f"contains(l, {sql_literal(x)})::INT" for x in words] + [f"{n} * regexp_matches(l, {sql_literal(p)})::INT" for p, n in patterns]
    return " + ".join(parts)


@query("x17_two_class", f"""
SELECT doc_id, CASE WHEN rx >= 3 AND rx > lab THEN 'prescription' WHEN lab >= 3 AND lab >= rx THEN 'lab_report' ELSE 'general_note' END AS kind FROM (
  SELECT doc_id, {_sum_sql(v.RX_WORDS, v.RX_PATTERNS)} AS rx, {_sum_sql(v.LAB_WORDS, v.LAB_PATTERNS)} AS lab FROM (SELECT doc_id, lower(text) AS l FROM ({TYPED_SQL})))""")
def x17(t: Tables):
    return typed_documents(t).select("doc_id", d.two_class("text").alias("kind"))


@query("x24_chunks", r"""
WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS n, 0 AS beg, substr(text, 1, 2000) AS w FROM documents
  UNION ALL SELECT doc_id, text, n + 1, nx, substr(text, nx + 1, 2000) FROM (SELECT doc_id, text, n, greatest(beg + cut - 200, beg + 1) AS nx FROM (
    SELECT *, CASE WHEN nl >= 1400 THEN nl WHEN dot >= 1400 THEN dot ELSE 2000 END AS cut FROM (SELECT *,
      CASE WHEN contains(w, chr(10)) THEN length(w) - strpos(reverse(w), chr(10)) ELSE -1 END AS nl,
      CASE WHEN contains(w, '. ') THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END AS dot FROM c WHERE beg + 2000 < length(text))))),
f AS (SELECT *, CASE WHEN contains(w, chr(10)) THEN length(w) - strpos(reverse(w), chr(10)) ELSE -1 END AS nl,
      CASE WHEN contains(w, '. ') THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END AS dot FROM c)
SELECT doc_id, n AS chunk_no, beg AS start, CASE WHEN beg + 2000 >= length(text) THEN w WHEN nl >= 1400 THEN w[1:nl] WHEN dot >= 1400 THEN w[1:dot] ELSE w END AS chunk FROM f""")
def x24(t: Tables):
    return d.chunks(t.documents, "doc_id", "text", 2000, 200)


@query("x24_fixed_chunks", """
SELECT doc_id, n AS chunk_no, n * 1800 AS start, substr(text, n * 1800 + 1, 2000) AS chunk FROM (
  SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 1800.0), 1)::INT)) AS n FROM documents)""")
def x24_fixed(t: Tables):
    return d.fixed_chunks(t.documents, "doc_id", "text", 2000, 200)


@query("x25_merge_chunk_rows", """
WITH r AS (SELECT source, doc_id, lang AS name, CAST(n_chars // 1000 AS VARCHAR) AS value FROM documents)
SELECT source, lower(trim(name)) AS name, value, min(doc_id) AS doc_id FROM r GROUP BY 1, 2, 3""")
def x25(t: Tables):
    rows = t.documents.select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("name"),
                              F.floor(F.col("n_chars") / 1000).cast("string").alias("value"))
    return d.merge_chunk_rows(rows, ["source"], ["name", "value"], ["doc_id"]).select("source", F.lower("name").alias("name"), "value", "doc_id")


BUDGET = 30
KEEP = d.keep_words("prescription")
KEEP_SQL = sql_literal(substring_pattern(KEEP))


@query("x26_budgeted_truncation", f"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM ({TYPED_SQL})),
b AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: regexp_matches(lower(x), {KEEP_SQL})), chr(10)) AS kept,
  array_to_string(list_filter(ls, lambda x: NOT regexp_matches(lower(x), {KEEP_SQL})), ' ') AS other, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS total FROM a),
c AS (SELECT *, len(list_filter(string_split_regex(kept, '\\s+'), lambda x: x <> '')) AS n, list_filter(string_split_regex(other, '\\s+'), lambda x: x <> '') AS ws FROM b),
e AS (SELECT doc_id, n, total, kept, regexp_replace(kept || chr(10) || array_to_string(ws[1:greatest({BUDGET} - n, 0)], ' '), '^\\s+|\\s+$', '', 'g') AS joined FROM c)
SELECT doc_id, CASE WHEN n >= {BUDGET} THEN substr(kept, 1, {BUDGET * 5}) ELSE joined END AS text,
  CASE WHEN n >= {BUDGET} THEN TRUE ELSE total > len(list_filter(string_split_regex(joined, '\\s+'), lambda x: x <> '')) END AS truncated FROM e""".replace("\\\\", "\\"))
def x26(t: Tables):
    return typed_documents(t).select("doc_id", d.truncate_keeping("text", BUDGET, KEEP).alias("c")).select("doc_id", "c.text", "c.truncated")


@query("x29_best_pass", """
SELECT source, lang, arg_max(doc_id, (n::BIGINT) * 1000000000 + n_chars % 100 * 1000000 + doc_id) AS doc_id FROM (
  SELECT source, lang, doc_id, n_chars, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS n FROM documents) GROUP BY 1, 2""")
def x29(t: Tables):
    passes = t.documents.select("source", "lang", "doc_id", "text", ((F.col("n_chars") % 100) / 100).alias("conf"))
    return d.best_pass(passes, ["source", "lang"], "text", "conf", "doc_id").select("source", "lang", "doc_id")


NOISE = ["  A â€“ B (TSH)\t\tx", "2.5 Âµg – 37 Â°C", "a\n\n\n\n\nb", "c—d"]


@query("x30_clean_extracted", rf"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(t, 'â€“', '-'), 'â€”', '-'), '–', '-'), '—', '-'), 'Âµ', 'µ'), 'Â°', '°'),
 '(?i)\((TSH|T3|T4)\)', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean
FROM (SELECT doc_id, text || ({sql_literal(NOISE)})[doc_id % 4 + 1] || text AS t FROM documents)""")
def x30(t: Tables):
    noisy = F.concat("text", F.lit("\0"), pick(NOISE, F.col("doc_id")), "text")
    return t.documents.select("doc_id", d.clean_extracted(noisy).alias("clean"))


TAG_TAILS = ["seen at cardiology", "patient rested", "ENT clinic", "renal unit", "joint replacement ward", "bone pain severe"]
SPEC_SQL = "CASE " + " ".join(
    rf"WHEN regexp_matches(l, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(ws)})($|[^\p{{L}}\p{{N}}_])') THEN '{n}'" for n, ws in v.SPECIALTIES) + " ELSE '' END"


@query("x31_specialty_tag", f"""
SELECT doc_id, {SPEC_SQL} AS specialty, contains(l, 'severe') OR {' OR '.join(f"contains(l, '{x}')" for x in v.SYMPTOM_ALERT_WORDS)} AS alert
FROM (SELECT doc_id, lower(text || ' ' || {pick_sql(TAG_TAILS, 'doc_id')}) AS l FROM documents)""")
def x31(t: Tables):
    text = F.concat_ws(" ", "text", pick(TAG_TAILS, F.col("doc_id")))
    return t.documents.select("doc_id", d.specialty(text).alias("specialty"), d.symptom_needs_alert(F.lit("symptom"), text).alias("alert"))


@query("x32_stable_keys", """
WITH h AS (SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS held FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, l_linenumber, sha256(least(a.p_name, b.p_name) || ':' || greatest(a.p_name, b.p_name)) AS pair_key,
  sha256(l_orderkey || '|' || a.p_name || '|' || array_to_string(held, ',') || '|{}') AS decision_key
FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey JOIN h USING (l_orderkey)""")
def x32(t: Tables):
    n = t.part.select("p_partkey", "p_name")
    pairs = (t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
             .join(n.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a")), "l_partkey")
             .join(n.select(F.col("p_partkey").alias("l_suppkey"), F.upper("p_name").alias("b")), "l_suppkey"))
    held = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(n, "p_partkey").groupBy("l_orderkey").agg(
        F.collect_set("p_name").alias("held"))
    return pairs.join(held, "l_orderkey").select(
        "l_orderkey", "l_linenumber", d.pair_hash("a", "b").alias("pair_key"),
        d.decision_hash("l_orderkey", "a", "held", F.lit("{}")).alias("decision_key"))


PARTS = " || ':' || ".join(f"sum(('0x' || substr(d, {3 + 13 * i}, 13))::BIGINT::HUGEINT)" for i in range(5))


@query("x32_corpus_hash", f"""
WITH h AS (SELECT sha256(item_id || chr(31) || text) AS d FROM benchmark),
s AS (SELECT substr(d, 1, 2) || ':' || count(*) || ':' || {PARTS} AS s FROM h GROUP BY substr(d, 1, 2))
SELECT sha256(string_agg(s, ',' ORDER BY s)) AS corpus_hash FROM s""")
def x32_corpus(t: Tables):
    return d.corpus_hash(t.benchmark, "item_id", "text")


@query("x16_vs_labels_agreement", f"""
WITH ty AS ({TYPE_SQL}), j AS (SELECT document_type AS a, CASE WHEN quality = 1 THEN 'lab_report' ELSE 'general_note' END AS b FROM ty JOIN labels USING (doc_id)),
k AS (SELECT a, b, count(*) AS n FROM j GROUP BY 1, 2)
SELECT a AS label_a, b AS label_b, n, round(sum(CASE WHEN a = b THEN n ELSE 0 END) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a), 4) AS agreement FROM k""")
def x16_labels(t: Tables):
    typed = d.document_type(typed_documents(t), "text").select("doc_id", "document_type")
    truth = t.labels.select("doc_id", F.when(F.col("quality") == 1, "lab_report").otherwise("general_note").alias("truth"))
    return a.agreement(typed.join(truth, "doc_id"), "document_type", "truth")

