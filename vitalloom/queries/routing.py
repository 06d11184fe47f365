"""Message routing on the given conversations; care phrases are added to each message's own text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import word_pattern
from ..operators import routing as r
from ..operators.windows import negation_pattern
from ..registry import Tables, query, sql_literal
from .extraction import dated_messages, dated_sql
from .texts import pick, pick_sql, sql_replace, sql_squeeze

ROUTE_TAILS = [
    "chestpain abhi", "no chest pain", "headache hai", "uncle mar gaya", "phone died", "call ambulance plz", "stroke pehle", "knife", "heart attak",
    "approve this", "you idiot", "uncle ko chakkar aaya", "dawai nhi li", "BP 150/90", "hba1c 7.2", "doctor ne diya naya tablet", "discharged from hospital",
    "book cardiology appointment 30th may 2:00 pm", "doctor kab aayenge appointment", "kab lena hai", "stock low", "medication list", "unconscius abhi", "mann nahi lag raha", "tension ho rahi hai", "wo chal nahi pa rahe", "dizzy hai aur pain abhi", "emergancy", "colapsed kal", "appointment budhwar ko", "doctor se mile",
    "ulti aur bukhar", "pain", "lunch skip", "neend nahi aayi", "i miss her", "mood off", "evening walk", "chutti chahiye", "sab theek hua", "kiya", "hello"]
CONTEXTS = ["veto_window", "appointment_draft", "appointment_confirm", "medication_confirmation", "refill_confirm", "clarification_question", "", "", "", "", ""]
MEDIA = ["image/png", "", "", "", "", "", "audio/ogg", "", "", "", "", "", ""]
SHORT = ["approve", "haan", "nahi", "hello", "liya", "reject this"]


def routed_messages(t: Tables):
    """Every message with a care phrase after its own text."""
    k = F.col("conv_id") * 8 + F.col("turn")
    tail = F.when(k % 5 == 4, pick(SHORT, F.floor(k / 5))).otherwise(pick(ROUTE_TAILS, k))
    msg = F.concat_ws(" ", "text", tail)
    return t.conversations.select("conv_id", "turn", "role", msg.alias("msg"), pick(CONTEXTS, k).alias("context"), pick(MEDIA, k).alias("media"))


MSG_SQL = f"""SELECT conv_id, turn, role, text || ' ' || tail AS msg, {pick_sql(CONTEXTS, 'k')} AS context, {pick_sql(MEDIA, 'k')} AS media
 FROM (SELECT *, CASE WHEN k % 5 = 4 THEN {pick_sql(SHORT, 'k // 5')} ELSE {pick_sql(ROUTE_TAILS, 'k')} END AS tail FROM (SELECT *, conv_id * 8 + turn AS k FROM conversations))"""


def ratio_sql(a: str, b: str) -> str:
    return f"(1 - (2 * levenshtein({a}, {b}) - abs(length({a}) - length({b}))) / (length({a}) + length({b})))"


# The routing terms that a misspelt token may stand for.
MISSPELT_TERMS = ("ambulance", "emergency", "appointment", "medication", "medicine", "tablets", "skipped", "missed", "taken", "approve", "reject", "veto", "collapse", "unconscious")
BEST_SQL = "list_aggregate([" + ", ".join(f"struct_pack(r := {ratio_sql('tk[i]', sql_literal(x))}, t := {sql_literal(x)})" for x in MISSPELT_TERMS) + "], 'max')"
CLOSE_SQL = f"CASE WHEN length(tk[i]) >= 5 AND ({BEST_SQL}).r >= 0.88 THEN ({BEST_SQL}).t END"


def near_sql(phrases, col: str = "s") -> str:
    """SQL twin of the close critical phrases."""
    parts = []
    for size in sorted({len(p.split()) for p in phrases}):
        runs = f"[array_to_string(string_split({col}, ' ')[i:i + {size - 1}], ' ') for i in range(1, len(string_split({col}, ' ')) - {size - 1} + 1)]"
        parts += [f"len(list_filter({runs}, lambda x: {ratio_sql('x', sql_literal(p))} >= 0.88)) > 0" for p in phrases if len(p.split()) == size]
    return "(" + " OR ".join(parts) + ")"


def routed_ctes(source: str, keep: str) -> str:
    """SQL twin of the routing form; ``keep`` names the columns to carry."""
    m = "MAP {" + ", ".join(f"{sql_literal(a)}: {sql_literal(b)}" for a, b in r.ROUTING_TOKENS.items()) + "}"
    return rf"""
r0 AS ({source}), r1 AS (SELECT {keep}, regexp_replace(lower(msg), '[^a-z0-9+%/:\s]', ' ', 'g') AS l FROM r0),
r2 AS (SELECT {keep}, trim(regexp_replace({sql_squeeze('l')}, '\s+', ' ', 'g')) AS s FROM r1), r3 AS (SELECT {keep}, {sql_replace('s', r.ROUTING_PHRASES)} AS s FROM r2),
r4 AS (SELECT {keep}, array_to_string([coalesce(({m})[tk[i]], {CLOSE_SQL}, tk[i]) for i in range(1, len(tk) + 1)], ' ') AS s FROM (SELECT *, string_split(s, ' ') AS tk FROM r3)),
rt AS (SELECT {keep}, {sql_replace('s', r.ROUTING_PHRASES)} AS s FROM r4)"""


def _w(words, col="s"):
    return f"regexp_matches({col}, {sql_literal(word_pattern(words))})"


def _m(pattern, col="s"):
    return f"regexp_matches({col}, {sql_literal(pattern)})"


NEG = f"regexp_matches(' ' || regexp_replace(s, '[^a-z0-9]+', ' ', 'g') || ' ', {sql_literal(negation_pattern(r.CRITICAL_WORDS, r.NEGATIONS))})"
COMMAND = f"({_m(r.APPROVE_SHAPE)} OR {_m(r.REJECT_SHAPE)})"
CRITICAL_SQL = f"({_w(r.CRITICAL_WORDS)} OR {near_sql(r.CRITICAL_WORDS)})"
REASON_SQL = f"""CASE WHEN {COMMAND} THEN 'command_word' WHEN {_w(r.THINGS_THAT_DIE)} THEN 'no_crisis_detected' WHEN {_w(r.EXPLICIT_HELP)} THEN 'explicit_emergency' WHEN {NEG} THEN 'negated'
 WHEN {_w(r.BENIGN_PAIN)} THEN 'pain_non_emergency' WHEN {_w(r.DEATH_WORDS)} THEN 'death_report' WHEN {_w(r.ASSAULT_WORDS)} THEN 'sexual_assault' WHEN {_w(r.VIOLENCE_WORDS)} THEN 'violence_threat'
 WHEN {_w(r.SELF_HARM_WORDS)} OR ({_w(['kood'])} AND {_w(['bridge', 'building', 'chhat', 'roof'])}) THEN 'self_harm_risk'
 WHEN {_w(r.PRESENT_WORDS)} AND {CRITICAL_SQL} THEN 'crisis_present' WHEN {_w(r.PAST_WORDS)} AND {CRITICAL_SQL} THEN 'crisis_historical'
 WHEN {_w(r.SHORT_CRITICAL)} THEN 'medical_emergency' ELSE 'no_crisis_detected' END"""
IS_EMERGENCY = "reason IN ('explicit_emergency', 'death_report', 'sexual_assault', 'violence_threat', 'self_harm_risk', 'crisis_present', 'medical_emergency')"


def rule_sql(rule: r.Rule, context: bool = True) -> str:
    parts = []
    if rule.context:
        parts.append(f"context IN ({', '.join(sql_literal(x) for x in rule.context)})" if context else "FALSE")
    if rule.media:
        parts.append(_m(rule.media, "media") if context else "FALSE")
    parts += [("" if want else "NOT ") + _m(p) for p, want in rule.patterns()]
    if rule.not_both:
        parts.append(f"NOT ({_w(rule.not_both[0])} AND {_w(rule.not_both[1])})")
    if rule.max_words:
        parts.append(f"len(string_split(s, ' ')) <= {rule.max_words}")
    return " AND ".join(parts)


def route_sql(context: bool = True) -> str:
    media = " ".join(f"WHEN {rule_sql(x, context)} THEN '{x.intent}'" for x in r.ROUTES if x.media)
    rest = " ".join(f"WHEN {rule_sql(x, context)} THEN '{x.intent}'" for x in r.ROUTES if not x.media)
    live = f"context IN {r.APPROVAL_CONTEXT}" if context else "FALSE"
    cmd = " ".join(f"WHEN {_m(shape)} THEN CASE WHEN {live} THEN '{intent}' ELSE 'approval_context_missing' END"
                   for shape, intent in ((r.APPROVE_SHAPE, "approve_command"), (r.REJECT_SHAPE, "veto_command")))
    return f"CASE {media} WHEN {IS_EMERGENCY} THEN 'crisis' {cmd} {rest} ELSE 'unknown' END"


ROUTED = routed_ctes(MSG_SQL, "conv_id, turn, context, media")
CLASSIFIED = f"{ROUTED}, em AS (SELECT *, {REASON_SQL} AS reason FROM rt), cl AS (SELECT *, {route_sql()} AS intent FROM em)"
CONF_SQL = "CASE intent " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in r.CONFIDENCE.items()) + " ELSE 0.78 END::DOUBLE"


@query("x18_ordered_rules", f"WITH {CLASSIFIED} SELECT conv_id, turn, intent, {CONF_SQL} AS confidence FROM cl")
def x18(t: Tables):
    return r.classify(routed_messages(t), "msg", context="context", media="media").select(
        "conv_id", "turn", "intent", F.col("intent_confidence").alias("confidence"))


@query("x19_emergency_screen", f"WITH {CLASSIFIED} SELECT conv_id, turn, reason, {IS_EMERGENCY} AS is_emergency FROM cl")
def x19(t: Tables):
    e = routed_messages(t).select("conv_id", "turn", r.routing_text("msg").alias("s")).withColumn("e", r.emergency(F.col("s")))
    return e.select("conv_id", "turn", "e.reason", "e.is_emergency")


@query("x2_routing_text", f"WITH {ROUTED} SELECT conv_id, turn, s AS routed FROM rt")
def x2_base(t: Tables):
    return routed_messages(t).select("conv_id", "turn", r.routing_text("msg").alias("routed"))


LEVELS = f"""CASE WHEN {IS_EMERGENCY} THEN 'severe_acute' WHEN intent = 'symptom_report' AND {_w(r.CRITICAL_SYMPTOMS)} AND ({_w(r.ACUTE)} OR {_w(r.SEVERE)}) THEN 'severe_acute'
 WHEN {_w(r.SEVERE)} AND ({_w(r.CHRONIC)} OR NOT {_w(r.ACUTE)}) THEN 'severe_chronic' WHEN {_w(r.MODERATE)} OR ({_w(r.SEVERE)} AND intent IN ('mood_report', 'emotional_checkin', 'sleep_report')) THEN 'moderate'
 WHEN {_w(r.MILD)} THEN 'mild' WHEN intent IN ('diet_report', 'exercise_report') THEN 'mild' WHEN intent = 'symptom_report' THEN 'moderate' ELSE 'mild' END"""


@query("x20_report_severity", f"WITH {CLASSIFIED} SELECT conv_id, turn, {LEVELS} AS level FROM cl")
def x20(t: Tables):
    c_ = r.classify(routed_messages(t), "msg", context="context", media="media")
    return c_.select("conv_id", "turn", r.report_severity(F.col("routed"), F.col("intent"))["level"].alias("level"))


COMPOUND_TAILS = ["dawai le li, bukhar hai and lunch skip kiya also neend nahi aayi", "chakkar aaya; walk kiya plus mood off", "ok"]


def compound_messages(t: Tables):
    k = F.col("conv_id") + F.col("turn")
    return t.conversations.select("conv_id", "turn", F.concat_ws(", ", pick(COMPOUND_TAILS, k), "text").alias("msg"), F.lit("status_query").alias("primary"))


CL_SPLIT = sql_literal(r.CLAUSE_SPLIT)
CLAUSE_SQL = f"""
SELECT conv_id, turn, generate_subscripts(cs, 1) - 1 AS pos, unnest(cs) AS msg FROM (SELECT conv_id, turn, list_filter(ps, lambda p: regexp_matches(p, '\\S\\s+\\S'))[1:5] AS cs FROM (
  SELECT conv_id, turn, msg, list_filter(list_transform(string_split_regex(msg, {CL_SPLIT}), lambda p: regexp_replace(p, '^[ .!?]+|[ .!?]+$', '', 'g')), lambda p: p <> '') AS ps FROM (
    SELECT conv_id, turn, {pick_sql(COMPOUND_TAILS, 'conv_id + turn')} || ', ' || text AS msg FROM conversations))
  WHERE (len(string_split(trim(regexp_replace(msg, '\\s+', ' ', 'g')), ' ')) > 10 OR len(ps) >= 3) AND regexp_matches(msg, {CL_SPLIT}))""".replace("\\\\", "\\")


@query("x21_compound_clauses", f"""
WITH {routed_ctes(CLAUSE_SQL, 'conv_id, turn, pos')}, em AS (SELECT *, {REASON_SQL} AS reason FROM rt), cl AS (SELECT *, {route_sql(False)} AS intent FROM em)
SELECT conv_id, turn, intent AS secondary, min(pos) AS pos FROM cl WHERE intent NOT IN ('unknown', 'greeting', 'status_query') GROUP BY 1, 2, 3""")
def x21(t: Tables):
    return r.secondary_intents(compound_messages(t), ["conv_id", "turn"], "msg", "primary")


VOICE_SQL = "CASE " + " ".join(f"WHEN {_w(ws, 'lower(clause)')} THEN '{k}'" for k, ws in r.VOICE_EVENTS) + " END"


@query("x21_voice_events", f"""
WITH c AS (SELECT conv_id, turn, generate_subscripts(ps, 1) - 1 AS pos, trim(unnest(ps)) AS clause FROM (
  SELECT conv_id, turn, string_split_regex({pick_sql(COMPOUND_TAILS, 'conv_id + turn')} || ', ' || text, {sql_literal(r.VOICE_SPLIT)}) AS ps FROM conversations))
SELECT * FROM (SELECT conv_id, turn, pos, {VOICE_SQL} AS event_type FROM c WHERE clause <> '') WHERE event_type IS NOT NULL""")
def x21_voice(t: Tables):
    return r.voice_events(compound_messages(t), ["conv_id", "turn"], "msg").select("conv_id", "turn", "pos", "event_type")


CARE_TAILS = ["kaisa hai aaj", "did he take it", "please approve", "alert me when late", "main nahi hoon kal", "blood test kab", "hmm"]
CARE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(l, {sql_literal(word_pattern(x.any))}) THEN '{x.intent}'" for x in r.CAREGIVER_RULES) + " ELSE '' END"


@query("x18_caregiver_questions", f"""
SELECT conv_id, turn, {CARE_SQL} AS intent, CASE WHEN {CARE_SQL} = 'approval_action' AND turn % 2 = 0 THEN 0.95 WHEN {CARE_SQL} = '' THEN 0.0 ELSE 0.85 END::DOUBLE AS confidence
FROM (SELECT conv_id, turn, lower(text || ' ' || {pick_sql(CARE_TAILS, 'conv_id + turn')}) AS l FROM conversations)""")
def x18_care(t: Tables):
    msg = F.concat_ws(" ", "text", pick(CARE_TAILS, F.col("conv_id") + F.col("turn")))
    ctx = F.when(F.col("turn") % 2 == 0, "new_med").otherwise("none")
    e = t.conversations.select("conv_id", "turn", r.caregiver_intent(msg, ctx).alias("e"))
    return e.select("conv_id", "turn", F.coalesce("e.intent", F.lit("")).alias("intent"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"))


@query("x18_temporal_bias", """
WITH m AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'medication_due_now' WHEN 1 THEN 'medication_report' ELSE 'diet_report' END AS i, hour(ts) * 60 + minute(ts) AS n, event_id % 2 = 0 AS said FROM events),
d AS (SELECT *, least(abs(n - 510), 1440 - abs(n - 510), abs(n - 1230), 1440 - abs(n - 1230)) AS gap FROM m)
SELECT event_id, CASE WHEN gap <= 30 AND i = 'medication_report' AND said THEN 'medication_due_now' WHEN gap > 120 AND i = 'medication_due_now' THEN 'medication_list' ELSE i END AS intent,
  round(CASE WHEN gap <= 30 AND i = 'medication_due_now' THEN 0.95 WHEN gap <= 30 AND i = 'medication_report' AND said THEN 0.9 ELSE 0.8 END, 2)::DOUBLE AS confidence FROM d""")
def x18_bias(t: Tables):
    intent = F.when(F.col("event_id") % 3 == 0, "medication_due_now").when(F.col("event_id") % 3 == 1, "medication_report").otherwise("diet_report")
    n = F.hour("ts") * 60 + F.minute("ts")
    gaps = [F.least(F.abs(n - x), 1440 - F.abs(n - x)) for x in (510, 1230)]
    said = F.when(F.col("event_id") % 2 == 0, "abhi li").otherwise("li")
    e = t.events.select("event_id", r.temporal_bias(intent, F.lit(0.8), said, F.least(*gaps)).alias("e"))
    return e.select("event_id", "e.intent", F.round("e.confidence", 2).alias("confidence"))


TIME_TAILS = ["abhi batao", "3 ghante baad", "do hours later", "kal subah", "parso raat ko", "yesterday lunch", "shaam", "what next"]


@query("x13_temporal_query")
def x13(t: Tables):
    m = dated_messages(t, TIME_TAILS)
    e = m.withColumn("e", r.temporal_query("msg", "now"))
    return e.select("conv_id", "turn", "e.bucket", "e.is_now", "e.confidence", F.col("e.target_date").cast("string").alias("target_date"))


def _hb(h):
    return f"CASE WHEN {h} BETWEEN 6 AND 11 THEN 'morning' WHEN {h} BETWEEN 12 AND 17 THEN 'afternoon' WHEN {h} BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END"


HOURS = "CASE hw " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in r.NUMBER_WORDS.items()) + " ELSE try_cast(nullif(hw, '') AS INT) END"
PLAIN_TIME_SQL = f"""
WITH m AS (SELECT conv_id, turn, now, lower(tail) AS s FROM (SELECT conv_id, turn, TIMESTAMP '2024-01-01 06:00:00' + to_days(conv_id::INT) + to_hours(turn) AS now, {pick_sql(TIME_TAILS, 'conv_id + turn')} AS tail FROM conversations)),
h AS (SELECT *, regexp_extract(s, {sql_literal(r.HOUR_OFFSET)}, 1) AS hw FROM m), k AS (SELECT *, {HOURS} AS hrs FROM h),
d AS (SELECT *, CASE WHEN {_w(['yesterday'])} THEN now::DATE - 1 WHEN {_w(['parso'])} THEN now::DATE + 2 WHEN {_w(['kal', 'tomorrow'])} THEN now::DATE + 1 ELSE now::DATE END AS day,
  CASE {' '.join(f"WHEN {_w(ws)} THEN '{b}'" for b, ws in r.BUCKET_WORDS)} END AS named FROM k)
SELECT conv_id, turn, CASE WHEN {_w(r.NOW_WORDS)} THEN {_hb('hour(now)')} WHEN hrs IS NOT NULL THEN {_hb('hour(now + to_hours(hrs))')} WHEN named IS NOT NULL THEN named ELSE {_hb('hour(now)')} END AS bucket,
  {_w(r.NOW_WORDS)} AS is_now, CASE WHEN {_w(r.NOW_WORDS)} THEN 0.95 WHEN hrs IS NOT NULL OR named IS NOT NULL THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence,
  (CASE WHEN {_w(r.NOW_WORDS)} THEN now::DATE WHEN hrs IS NOT NULL THEN (now + to_hours(hrs))::DATE ELSE day END)::VARCHAR AS target_date FROM d"""


@query("x13_temporal_phrases", PLAIN_TIME_SQL)
def x13_plain(t: Tables):
    m = dated_messages(t, TIME_TAILS).withColumn("tail", pick(TIME_TAILS, F.col("conv_id") + F.col("turn")))
    e = m.withColumn("e", r.temporal_query("tail", "now"))
    return e.select("conv_id", "turn", "e.bucket", "e.is_now", "e.confidence", F.col("e.target_date").cast("string").alias("target_date"))


WINDOW_TAILS = ["in 5 days", "appointments today", "this week", "next month", "previous visits", "kab hai", "next 10 days"]
WORDS = {"w_today": ["today", "aaj"], "w_week": ["week"], "w_month": ["month"], "w_past": list(r.HISTORY_WORDS)}


@query("x14_query_window", f"""
WITH m AS (SELECT *, lower(msg) AS s FROM ({dated_sql(WINDOW_TAILS)})),
n AS (SELECT *, try_cast(nullif(regexp_extract(s, '(?:next|in|agle|andar)\\s+(\\d{{1,2}})\\s+days?', 1), '') AS INT) AS n FROM m)
SELECT conv_id, turn, CASE WHEN n IS NOT NULL THEN now WHEN {_w(WORDS['w_today'])} THEN date_trunc('day', now) WHEN {_w(WORDS['w_week'])} OR {_w(WORDS['w_month'])} THEN now
   WHEN {_w(WORDS['w_past'])} THEN now - INTERVAL 90 DAY ELSE now END AS start_at,
  CASE WHEN n IS NOT NULL THEN now + to_days(n) WHEN {_w(WORDS['w_today'])} THEN date_trunc('day', now) + INTERVAL 1 DAY WHEN {_w(WORDS['w_week'])} THEN now + INTERVAL 7 DAY
   WHEN {_w(WORDS['w_month'])} THEN now + INTERVAL 31 DAY WHEN {_w(WORDS['w_past'])} THEN now ELSE now + INTERVAL 14 DAY END AS end_at FROM n""".replace("\\\\", "\\"))
def x14(t: Tables):
    e = dated_messages(t, WINDOW_TAILS).withColumn("e", r.query_window("msg", "now"))
    return e.select("conv_id", "turn", F.col("e.start").alias("start_at"), F.col("e.end").alias("end_at"))


