"""Near matches on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import soundex_like
from ..operators import similarity as s
from ..operators.routing import routing_text
from ..registry import Tables, query, sql_values
from .texts import pick, pick_sql

TYPO_SQL = "substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2)"
SOUND = "regexp_replace(" * 7 + "translate(regexp_replace(lower({x}), '[^a-z]', '', 'g'), 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000000111122222222334556')" + "".join(
    f", '{d}+', '{d}', 'g')" for d in range(7))


def sound_sql(x: str) -> str:
    return f"substr(upper(substr(regexp_replace(lower({x}), '[^a-z]', '', 'g'), 1, 1)) || replace(substr({SOUND.replace('{x}', x)}, 2), '0', '') || '000', 1, 4)"


def typo_names(t: Tables):
    """Part names with one character left out."""
    n = (F.col("p_partkey") % F.length("p_name")).cast("int")
    return t.part.select("p_partkey", F.concat(F.substring("p_name", F.lit(1), n), F.substring("p_name", n + 2, F.length("p_name"))).alias("raw"))


@query("j18_fuzzy_name_join", f"""
WITH n AS (SELECT DISTINCT trim({TYPO_SQL}) AS n FROM part), w AS (SELECT DISTINCT p_name AS w FROM part),
s AS (SELECT n, w, CASE WHEN contains(n, w) THEN 4 WHEN 1 - levenshtein(n, w) / greatest(length(n), length(w)) >= 0.8 - 1e-12 THEN 2
  WHEN length(n) >= 4 AND NOT contains(n, ' ') AND {sound_sql('n')} = {sound_sql('w')} AND greatest(0.76, (1 - levenshtein(n, w) / greatest(length(n), length(w))) * 0.9) >= 0.8 THEN 1 ELSE 0 END AS tier,
  1 - levenshtein(n, w) / greatest(length(n), length(w)) AS ratio FROM n, w),
b AS (SELECT n, max(struct_pack(tier := tier, score := CASE tier WHEN 4 THEN 1.0 WHEN 2 THEN ratio ELSE greatest(0.76, ratio * 0.9) END, w := w)) AS b FROM s WHERE tier > 0 GROUP BY 1)
SELECT p_partkey, coalesce(b.w, '') AS matched, coalesce(round(b.score, 4), 0) AS score, coalesce(b.tier, 0) AS tier FROM part LEFT JOIN b ON n = trim({TYPO_SQL})""")
def j18(t: Tables):
    out = s.fuzzy_names(typo_names(t), t.part, "raw", "p_name")
    return out.select("p_partkey", F.coalesce("matched", F.lit("")).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.coalesce("tier", F.lit(0)).alias("tier"))


@query("j18_exact_ratio_join")
def j18_exact(t: Tables):
    return s.fuzzy_names(typo_names(t), t.part, "raw", "p_name", exact_ratio=True).select("p_partkey", "matched", "score", "tier")


@query("j18_sound_code", f"SELECT doc_id, {sound_sql('text')} AS code FROM documents")
def j18_sound(t: Tables):
    return t.documents.select("doc_id", soundex_like("text").alias("code"))


HINT_TAILS = ["amlodipine se chakkar", "metformin and loose stools", "ramipril khansi", "dizzy today", "glimepiride weakness", "fine"]
HINT_ITEMS = ["amlodipine", "", "glimepiride", "metformin", "ramipril"]
HINT_ROWS = [(n, dr, sy, w) for n, (dr, sy) in enumerate(v.SIDE_EFFECT_HINTS) for w in v.SYMPTOM_SYNONYMS.get(sy, (sy,))]


@query("j19_side_effect_hint", f"""
WITH d AS (SELECT doc_id, {pick_sql(HINT_ITEMS, 'doc_id // 3')} AS item, lower(text || ' ' || {pick_sql(HINT_TAILS, 'doc_id')}) AS l FROM documents),
h AS (SELECT doc_id, min(CASE WHEN item = drug THEN n ELSE n + 1000 END) AS k FROM d JOIN {sql_values(HINT_ROWS, 'hint(n, drug, symptom, word)')} ON contains(l, word) AND (item = drug OR contains(l, drug)) GROUP BY 1)
SELECT doc_id, coalesce(drug, '') AS item, coalesce(symptom, '') AS symptom, CASE WHEN k IS NULL THEN 0 WHEN k < 1000 THEN 0.95 ELSE 0.90 END::DOUBLE AS confidence
FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN (SELECT DISTINCT n, drug, symptom FROM {sql_values(HINT_ROWS, 'hint(n, drug, symptom, word)')}) x ON x.n = k % 1000""")
def j19(t: Tables):
    raw = F.concat_ws(" ", "text", pick(HINT_TAILS, F.col("doc_id")))
    e = t.documents.select("doc_id", s.side_effect_hint(pick(HINT_ITEMS, F.floor(F.col("doc_id") / 3)), raw, raw).alias("e"))
    return e.select("doc_id", F.coalesce("e.item", F.lit("")).alias("item"), F.coalesce("e.symptom", F.lit("")).alias("symptom"),
                    F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))


@query("j21_mentioned_item", """
WITH i AS (SELECT DISTINCT doc_id % 100 AS entity, regexp_extract(lower(text), '\\p{L}{4,}') AS item FROM documents WHERE regexp_extract(lower(text), '\\p{L}{4,}') <> '' AND (doc_id % 100 < 90 OR doc_id < 100)),
one AS (SELECT entity, min(item) AS only_item FROM i GROUP BY 1 HAVING count(*) = 1),
h AS (SELECT conv_id, turn, item, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(item) DESC, item) AS n FROM conversations JOIN i ON entity = conv_id % 100 AND contains(lower(text), item))
SELECT c.conv_id, c.turn, coalesce(h.item, only_item, '') AS matched_item FROM conversations c LEFT JOIN h ON h.conv_id = c.conv_id AND h.turn = c.turn AND n = 1 LEFT JOIN one ON one.entity = c.conv_id % 100""".replace("\\\\", "\\"))
def j21(t: Tables):
    items = t.documents.where("doc_id % 100 < 90 OR doc_id < 100").select(
        (F.col("doc_id") % 100).alias("entity"), F.regexp_extract(F.lower("text"), r"\p{L}{4,}", 0).alias("item"))
    msgs = t.conversations.select("conv_id", "turn", (F.col("conv_id") % 100).alias("entity"), "text")
    return s.mentioned_item(msgs, items, ["conv_id", "turn"], "entity", "item", "text").select(
        "conv_id", "turn", F.coalesce("matched_item", F.lit("")).alias("matched_item"))


MISSPELT = ["ambulence please", "emergancy at home", "appointmnet kal", "medicin", "unconscius", "skiped dose", "fine"]


@query("x2_token_repair")
def x2(t: Tables):
    k = F.col("conv_id") + F.col("turn")
    rows = t.conversations.select("conv_id", "turn", routing_text(F.concat_ws(" ", "text", pick(MISSPELT, k))).alias("routed"))
    return s.repair_tokens(rows, ["conv_id", "turn"], "routed").select("conv_id", "turn", "repaired")


#: The twin's edit distance counts bytes: letters beyond ASCII become capitals there, which the lower-cased texts do not hold.
ONE_BYTE = "translate({x}, 'éèêëàâáäçîïíôóöùûúüñœæß', 'ABCDEFGHIJKLMNOPQRSTUVW')"


@query("x22_nearest_seed", f"""
WITH m AS (SELECT conv_id, turn, trim(regexp_replace(lower(CASE (conv_id + turn) % 4 WHEN 3 THEN c.text WHEN 2 THEN replace(replace(b.text, 'e', 'i'), 'th', 't') WHEN 1 THEN substr(b.text, 5, 60) ELSE c.text || ' ' || b.text END), '\\s+', ' ', 'g')) AS mt
  FROM conversations c JOIN benchmark b ON b.item_id = (conv_id + turn) % 40),
s AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS st FROM benchmark),
p AS (SELECT conv_id, turn, item_id, mt, st, list_distinct(string_split(mt, ' ')) AS ms, list_distinct(string_split(st, ' ')) AS ss FROM m, s),
q AS (SELECT conv_id, turn, item_id, CASE WHEN mt = st THEN 0.96 WHEN contains(mt, st) OR contains(st, mt) THEN 0.88
  ELSE greatest(2 * len(list_intersect(ms, ss)) / (len(ms) + len(ss)), 0.82 * (1 - levenshtein({ONE_BYTE.format(x="mt")}, {ONE_BYTE.format(x="st")}) / greatest(length(mt), length(st)))) END AS sc FROM p),
b AS (SELECT conv_id, turn, max(struct_pack(sc := sc, l := item_id)) AS b FROM q WHERE sc >= 0.55 GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(b.l::VARCHAR, 'unknown') AS predicted, round(coalesce(b.sc, 0), 4) AS score FROM m LEFT JOIN b USING (conv_id, turn)""".replace("\\\\", "\\"))
def x22(t: Tables):
    k = (F.col("conv_id") + F.col("turn")) % 4
    b = t.benchmark.select(F.col("item_id").alias("__i"), F.col("text").alias("__b"))
    misspelt = F.replace(F.replace(F.col("__b"), F.lit("e"), F.lit("i")), F.lit("th"), F.lit("t"))
    msg = F.when(k == 3, F.col("text")).when(k == 2, misspelt).when(k == 1, F.substring("__b", 5, 60)).otherwise(F.concat_ws(" ", "text", "__b"))
    msgs = t.conversations.join(b, (F.col("conv_id") + F.col("turn")) % 40 == F.col("__i")).select("conv_id", "turn", msg.alias("msg"))
    return s.nearest_seed(msgs, t.benchmark.select("item_id", "text"), ["conv_id", "turn"], "msg", "item_id", "text")


TYPO_PHRASES = ("chest pain", "heart attack", "not breathing", "unconscious", "call ambulance")
TYPO_TAILS = ["chestoain", "heartatack", "not breathng", "chess pawn", "callambulence now"]


@query("x33_compact_typo")
def x33(t: Tables):
    k = F.col("conv_id") + F.col("turn")
    msg = F.concat_ws(" ", "text", pick(TYPO_TAILS, k))
    rows = t.conversations.select("conv_id", "turn", F.lower(msg).alias("msg"))
    return s.compact_typos(rows, ["conv_id", "turn"], "msg", TYPO_PHRASES).select("conv_id", "turn", "typo")
