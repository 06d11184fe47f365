"""Rows extracted from the given texts; care phrases are added to each row's own text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.core import ts
from ..operators import aggregates as a
from ..operators import documents as d
from ..operators import extraction as x
from ..registry import Tables, query, sql_literal, sql_values
from .texts import pick, pick_sql


def rr(expr: str, pattern: str, new: str) -> str:
    """Global regex replace in SQL, from a Spark replacement."""
    new = re.sub(r"\$(\d)", r"\\\1", new)
    return f"regexp_replace({expr}, {sql_literal(pattern)}, {sql_literal(new)}, 'g')"


def sql_clean(expr: str) -> str:
    for old, new in d.MOJIBAKE[1:]:
        expr = f"replace({expr}, {sql_literal(old)}, {sql_literal(new)})"
    for pattern, new in ((r"(?i)\((TSH|T3|T4)\)", "$1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        expr = rr(expr, pattern, new)
    return expr


def sql_space(expr: str) -> str:
    return f"trim({rr(expr, chr(92) + 's+', ' ')})"


VITAL_TAILS = ["BP 150/95 and pulse {n} bpm", "sugar: {n} mmol", "spo2 {n}% BP:{n}/ 80", "temp {n} f, pulse - {n}", "bukhar {n}.5",
               "blood  sugar {n} mg/dl heart rate {n}", "nothing new"]


def vital_messages(t: Tables):
    n = (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(90)) + 30).cast("string")
    tail = F.replace(pick(VITAL_TAILS, F.col("conv_id") + F.col("turn")), F.lit("{n}"), n)
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", "text", tail).alias("msg"))


VITAL_MSG_SQL = f"""SELECT conv_id, turn, text || ' ' || replace({pick_sql(VITAL_TAILS, 'conv_id + turn')}, '{{n}}', CAST((conv_id * 7 + turn * 13) % 90 + 30 AS VARCHAR)) AS msg FROM conversations"""
PV = {k: sql_literal(p) for k, p in x.VITAL_PATTERNS.items()}


def _vital_part(kind, value, secondary, unit, conf):
    return (f"SELECT conv_id, turn, '{kind}' AS test, {value} AS value, {secondary} AS secondary, {unit} AS unit, {conf} AS confidence FROM "
            f"(SELECT conv_id, turn, unnest(regexp_extract_all(msg, {PV[kind]}, 0)) AS m FROM msgs)")


def _g(kind, n):
    return f"regexp_extract(m, {PV[kind]}, {n})"


VITALS_SQL = f"""
WITH msgs AS ({VITAL_MSG_SQL}), r AS ({' UNION ALL '.join([
    _vital_part('bp', f"{_g('bp', 1)}::DOUBLE", f"{_g('bp', 2)}::DOUBLE", "'mmHg'", '0.98'),
    _vital_part('glucose', f"CASE WHEN lower({_g('glucose', 3)}) = 'mmol' THEN {_g('glucose', 2)}::DOUBLE * 18.0 ELSE {_g('glucose', 2)}::DOUBLE END", 'NULL', "'mg/dl'", f"CASE WHEN {_g('glucose', 3)} = '' THEN 0.9 ELSE 0.95 END"),
    _vital_part('pulse', f"{_g('pulse', 2)}::DOUBLE", 'NULL', "'bpm'", f"CASE WHEN lower({_g('pulse', 3)}) = 'bpm' THEN 0.95 ELSE 0.9 END"),
    _vital_part('spo2', f"{_g('spo2', 2)}::DOUBLE", 'NULL', "'%'", '0.95'),
    _vital_part('temperature', f"CASE WHEN contains(lower({_g('temperature', 3)}), 'f') THEN ({_g('temperature', 2)}::DOUBLE - 32) * 5 / 9 ELSE {_g('temperature', 2)}::DOUBLE END", 'NULL', "'C'", '0.95')])})
SELECT conv_id, turn, test, round(value, 2) AS value, unit, confidence::DOUBLE AS confidence, CASE
  WHEN test = 'bp' AND (value >= 180 OR secondary >= 120) THEN 'critical' WHEN test = 'bp' AND (value >= 140 OR secondary >= 90) THEN 'advisory'
  WHEN test = 'glucose' AND (value >= 250 OR value < 70) THEN 'critical' WHEN test = 'glucose' AND value >= 180 THEN 'advisory'
  WHEN test = 'pulse' AND (value >= 120 OR value < 50) THEN 'critical' WHEN test = 'pulse' AND (value >= 100 OR value < 60) THEN 'advisory'
  WHEN test = 'spo2' AND value < 90 THEN 'critical' WHEN test = 'spo2' AND value < 95 THEN 'advisory'
  WHEN test = 'temperature' AND value >= 39 THEN 'critical' WHEN test = 'temperature' AND value >= 38 THEN 'advisory' ELSE 'normal' END AS severity FROM r"""


@query("x6_vital_signs", VITALS_SQL)
def x6(t: Tables):
    return x.vital_signs(vital_messages(t), ["conv_id", "turn"], "msg").drop("pos", "secondary")


LAB_TAILS = ["HbA1c: 7.2 % (4.0-5.6)", "Serum Creatinine 1.4 mg/dL ref 0.6 to 1.2\nTSH - 3.5 uIU/mL normal: 0.4-4.0", "Hb {n} g/dL",
             "Thyroxine (T4), Free 1.2 ng/dL 0.8 – 1.8", "Glucose {n} mg/dL\nglucose {n} mg/dL\nPulse 70", "Platelet Count {n} /cumm\nSodium 140\nTotal Cholesterol 210 mg/dL\nSGOT 33 U/L (5-40)\nTotal Cholesterol / HDL Ratio 4.1\nA/G Ratio: 1.5", "no results"]


def lab_texts(t: Tables):
    n = (F.col("n_chars") % 300 + 5).cast("string")
    return t.documents.select("doc_id", "n_chars", F.concat_ws("\n", "text", F.replace(pick(LAB_TAILS, F.col("doc_id")), F.lit("{n}"), n)).alias("text"))


LAB_TEXT_SQL = f"SELECT doc_id, n_chars, text || chr(10) || replace({pick_sql(LAB_TAILS, 'doc_id')}, '{{n}}', CAST(n_chars % 300 + 5 AS VARCHAR)) AS text FROM documents"
LR, RL, RP = sql_literal(x.LAB_ROW), sql_literal(x.RANGE_LABELLED), sql_literal(x.RANGE_PLAIN)


def _rng(n):
    return f"coalesce(try_cast(nullif(regexp_extract(tail, {RL}, {n}), '') AS DOUBLE), try_cast(nullif(regexp_extract(tail, {RP}, {n}), '') AS DOUBLE), -1)"


def lab_sql(source: str) -> str:
    """SQL twin of the lab rows of any (doc_id, text) source."""
    return f"""
WITH h AS (SELECT doc_id, generate_subscripts(ms, 1) AS pos, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all({sql_clean('text')}, {LR}, 0) AS ms FROM ({source}))),
r AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(regexp_extract(m, {LR}, 1)), '[^a-z0-9% ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS nm,
  regexp_extract(m, {LR}, 2)::DOUBLE AS value, regexp_extract(m, {LR}, 3) AS unit, regexp_extract(m, {LR}, 4) AS tail FROM h)
SELECT doc_id, coalesce(canon, replace(nm, ' ', '_')) AS test_name, value, unit, arg_min({_rng(1)}, pos) AS low, arg_min({_rng(2)}, pos) AS high
FROM r LEFT JOIN {sql_values(v.ALL_LAB_ALIASES.items(), 'al(spelling, canon)')} ON spelling = nm GROUP BY 1, 2, 3, 4""".replace("'\\\\s+'", "'\\s+'")


@query("x7_lab_rows", lab_sql(LAB_TEXT_SQL))
def x7(t: Tables):
    out = x.lab_rows(lab_texts(t), ["doc_id"], "text")
    return out.select("doc_id", "test_name", "value", "unit", F.coalesce("low", F.lit(-1.0)).alias("low"), F.coalesce("high", F.lit(-1.0)).alias("high"))


RX_TAILS = ["Rx TAB METFORMIN {n}mg BD after food SYRUP ALEX 2/3 teaspoon 3 times a day shake well Dr. Asha Mehta", "TAB VITAMIN C one gram once a day",
            "Telma-AM to 30 1-0-0 CAP 2ING {n} mg 1-0-1", "INJ INSULIN 10 units HS; TAB CROUN 5OO mg SOS in case of fever", "TAB METFORMIN 500mg BD TAB METFORMIN 500 mg BD",
            "TAB CALPOL {n} mg BD Dr. Asha Mehta MBBS", "SYRUP ALEX in case of fever BD; TAB DOLO for pain 500 mg Dr. Rao OD", "rest and water"]


def rx_texts(t: Tables):
    n = (F.col("n_chars") % 300 + 5).cast("string")
    return t.documents.select("doc_id", F.concat_ws("\n", "text", F.replace(pick(RX_TAILS, F.col("doc_id")), F.lit("{n}"), n)).alias("text"))


RX_TEXT_SQL = f"SELECT doc_id, text || chr(10) || replace({pick_sql(RX_TAILS, 'doc_id')}, '{{n}}', CAST(n_chars % 300 + 5 AS VARCHAR)) AS text FROM documents"


def sql_repair(expr: str) -> str:
    for pattern, new in x.DOSE_REPAIRS:
        expr = rr(expr, pattern, new)
    return expr


def sql_part(s: str) -> str:
    return rr(f"string_split_regex({s}, {sql_literal(x.NOT_ITEM)})[1]", x.TAKEN_FOR, "")


def _ex(s, pattern, n):
    return f"nullif(regexp_extract({s}, {sql_literal(pattern)}, {n}), '')"


def sql_dose(s: str) -> tuple[str, str]:
    frac = f"({_ex(s, x.FRACTION, 1)}::DOUBLE / {_ex(s, x.FRACTION, 2)}::DOUBLE)"
    word = f"CASE lower({_ex(s, x.WORD_DOSE, 1)}) WHEN 'one' THEN 1.0 WHEN 'two' THEN 2.0 WHEN 'three' THEN 3.0 WHEN 'half' THEN 0.5 END"
    unit = f"lower(coalesce({_ex(s, x.DOSE, 2)}, {_ex(s, x.WORD_DOSE, 2)}))"
    return (f"coalesce({frac}, {_ex(s, x.DOSE, 1)}::DOUBLE, {word})",
            f"CASE WHEN {frac} IS NOT NULL THEN 'teaspoon' WHEN {unit} IN ('gram', 'grams') THEN 'g' ELSE {unit} END")


def sql_frequency(s: str) -> str:
    reg = " || ".join(f"regexp_extract({s}, {sql_literal(x.REGIMEN_ROW)}, {i})" for i in (1, 2, 3))
    by_reg = "CASE " + reg + " " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in x.ROW_REGIMENS.items()) + " END"
    words = "CASE " + " ".join(f"WHEN regexp_matches({s}, {sql_literal(f'(?i){x.EDGE_L}(?:{p}){x.EDGE_R}')}) THEN '{f}'" for p, f in x.ROW_FREQUENCIES) + " END"
    return f"coalesce({by_reg}, {words})"


def sql_item(s: str) -> str:
    t = rr(s, rf"(?i)^(?:(?:rx|lx)\.? +)?(?:(?:{'|'.join(v.FORM_WORDS)})\.? +)?", "")
    t = f"string_split_regex({t}, {sql_literal(x.STOP_AT)})[1]"
    t = rr(t, "(?i)(?:" + "|".join(v.ADVICE) + ")", " ")
    t = sql_space(rr(t, "[^A-Za-z0-9/+ -]+", " "))
    t = rr(rr(t, "^[ /-]+|[ /-]+$", ""), " *- *", "-")
    for pattern, new in x.NAME_REPAIRS:
        t = rr(t, pattern, new)
    return f"trim({rr(t, '(?i)(?:^| )to$', '')})"


def sql_phrases(s: str, phrases) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower({s}), '{p}') THEN '{p}' END" for p in phrases) + "], lambda z: z IS NOT NULL), '; ')"


SEG = f"replace({sql_space(sql_clean('text'))}, ' ', '  ')"
SEG = rr(rr(SEG, rf"(?i)({x.EDGE_L})({x.MARKERS})({x.EDGE_R})", "$1\n$2$3"), rf"(?i)({x.EDGE_L})({x.ENDINGS})({x.EDGE_R})", "$1$2\n$3")
def rx_sql(source: str) -> str:
    """SQL twin of the prescription items of any (doc_id, text) source."""
    return f"""
WITH a AS (SELECT doc_id, string_split({SEG}, chr(10)) AS parts FROM ({source})),
b AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS p FROM a),
c AS (SELECT doc_id, pos, {rr(sql_space('p'), '^[ .•*:;-]+|[ .•*:;-]+$', '')} AS seg FROM b),
e AS (SELECT doc_id, pos, seg, {sql_repair('seg')} AS s FROM c WHERE length(seg) >= 3),
e2 AS (SELECT doc_id, pos, seg, s AS whole, {sql_part('s')} AS s FROM e),
f AS (SELECT doc_id, pos, {sql_item('s')} AS item, {sql_dose('s')[0]} AS dose, {sql_dose('s')[1]} AS unit, {sql_frequency('s')} AS frequency,
  {sql_phrases('seg', v.INSTRUCTIONS)} AS instructions, {sql_phrases('seg', v.ADVICE)} AS advice FROM e2 WHERE regexp_matches(whole, {sql_literal(x.LOOKS_LIKE_ITEM)})),
g AS (SELECT *, trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) AS k FROM f WHERE length(item) >= 2 AND lower(item) NOT IN ('tab', 'cap', 'syrup', 'syp', 'syr', 'inj', 'drop', 'medicine'))
SELECT doc_id, arg_min(item, pos) AS item, coalesce(round(dose, 4), -1) AS dose, coalesce(unit, '') AS unit, coalesce(frequency, '') AS frequency,
  arg_min(instructions, pos) AS instructions, arg_min(advice, pos) AS advice FROM g GROUP BY doc_id, k, dose, unit, frequency"""


@query("x9_prescription_segments", rx_sql(RX_TEXT_SQL))
def x9(t: Tables):
    out = x.prescription_items(rx_texts(t), ["doc_id"], "text")
    return out.select("doc_id", "item", F.coalesce(F.round("dose", 4), F.lit(-1.0)).alias("dose"), F.coalesce("unit", F.lit("")).alias("unit"),
                      F.coalesce("frequency", F.lit("")).alias("frequency"), "instructions", "advice")


LINE_TAILS = ["Tab. Metformin\n500 mg\n1-0-1\nafter food\nshake well", "Rx Syrup Alex\n2/3 teaspoon\nBD\nwith food", "Aspirin 75 mg\nOD\nInj Insulin\n10 units\nHS\nempty stomach", "walk daily"]


def rx_line_texts(t: Tables):
    return t.documents.select("doc_id", F.concat_ws("\n", "text", pick(LINE_TAILS, F.col("doc_id"))).alias("text"))


LINES_SQL = f"""
WITH a AS (SELECT doc_id, string_split_regex(text || chr(10) || {pick_sql(LINE_TAILS, 'doc_id')}, '\\r\\n|\\r|\\n') AS ls FROM documents),
b AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l FROM a),
c AS (SELECT doc_id, pos, {sql_space('l')} AS line FROM b),
e AS (SELECT *, {sql_part(sql_repair('line'))} AS s, regexp_matches(line, {sql_literal(x.ITEM_LINE)}) OR regexp_matches(line, {sql_literal(x.DOSE_LINE)}) AS st FROM c WHERE line <> ''),
f AS (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS item_no FROM e),
g AS (SELECT doc_id, item_no, pos, CASE WHEN st THEN {sql_item('s')} END AS nm, {sql_dose('s')[0]} AS dv, {sql_dose('s')[1]} AS du, {sql_frequency('s')} AS fq,
  nullif({sql_phrases('line', v.INSTRUCTIONS)}, '') AS ins, nullif({sql_phrases('line', v.ADVICE)}, '') AS adv FROM f WHERE item_no > 0),
h AS (SELECT *, CASE WHEN length(nm) >= 2 AND lower(nm) NOT IN ('tab', 'cap', 'syrup', 'syp', 'syr', 'inj', 'drop', 'medicine') THEN nm END AS item FROM g)
SELECT doc_id, item_no::BIGINT AS item_no, arg_min(item, pos) FILTER (item IS NOT NULL) AS item, coalesce(round(arg_min(dv, pos) FILTER (dv IS NOT NULL), 4), -1) AS dose,
  coalesce(arg_min(du, pos) FILTER (dv IS NOT NULL), '') AS unit, coalesce(arg_min(fq, pos) FILTER (fq IS NOT NULL), '') AS frequency,
  coalesce(string_agg(ins, '; ' ORDER BY pos), '') AS instructions, coalesce(string_agg(adv, '; ' ORDER BY pos), '') AS advice FROM h GROUP BY 1, 2
HAVING count(item) > 0""".replace("'\\\\r\\\\n|\\\\r|\\\\n'", "'\\r\\n|\\r|\\n'")


@query("x9_prescription_lines", LINES_SQL)
def x9_lines(t: Tables):
    out = x.prescription_lines(rx_line_texts(t), ["doc_id"], "text")
    return out.select("doc_id", "item_no", "item", F.coalesce(F.round("dose", 4), F.lit(-1.0)).alias("dose"), F.coalesce("unit", F.lit("")).alias("unit"),
                      F.coalesce("frequency", F.lit("")).alias("frequency"), "instructions", "advice")


RAW_DOSES = ["{n} mg", "about {n}.5", "none", "0", "20000"]
RAW_UNITS = ["MG", "grams", "µg", "tsp.", "bottle", "", "Tablets"]
RAW_FREQS = ["1-0-1", "twice  daily", "Take 1 - 1 - 1 now", "PRN", "whenever", "", "QID"]


def raw_fields(t: Tables):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", "p_name", "p_size", F.replace(pick(RAW_DOSES, k), F.lit("{n}"), F.col("p_size").cast("string")).alias("dose"),
                         pick(RAW_UNITS, k).alias("unit"), pick(RAW_FREQS, F.floor(k / 7)).alias("freq"))


RAW_SQL = f"""SELECT p_partkey, p_name, p_size, replace({pick_sql(RAW_DOSES, 'p_partkey')}, '{{n}}', p_size::VARCHAR) AS dose, {pick_sql(RAW_UNITS, 'p_partkey')} AS unit,
  {pick_sql(RAW_FREQS, 'p_partkey // 7')} AS freq FROM part"""
FIELDS_SQL = f"""
r AS ({RAW_SQL}), n1 AS (SELECT *, try_cast(nullif(regexp_extract(dose, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS amount,
  coalesce((MAP {{{', '.join(f"{sql_literal(k)}: {sql_literal(u)}" for k, u in v.UNIT_ALIASES.items())}}})[lower(unit)], lower(unit)) AS u0,
  trim(regexp_replace(lower(freq), '\\s+', ' ', 'g')) AS f0 FROM r),
n2 AS (SELECT p_partkey, p_name, p_size, amount, CASE WHEN amount IS NULL THEN 0 WHEN amount <= 0 OR amount > 10000 THEN 0.25 ELSE 1 END::DOUBLE AS amount_conf,
  CASE WHEN u0 IN {v.UNITS} THEN u0 END AS unit, coalesce(fm[f0], fm[regexp_replace(regexp_extract(f0, {sql_literal(x.REGIMEN)}, 1), '\\s+', '', 'g')]) AS frequency
  FROM (SELECT *, MAP {{{', '.join(f"{sql_literal(k)}: {sql_literal(u)}" for k, u in v.FREQUENCIES.items())}}} AS fm FROM n1))""".replace("\\\\", "\\")


@query("x10_dose_fields", f"""WITH {FIELDS_SQL} SELECT p_partkey, coalesce(amount, -1) AS amount, amount_conf, coalesce(unit, '') AS unit, coalesce(frequency, '') AS frequency FROM n2""")
def x10(t: Tables):
    f = raw_fields(t).select("p_partkey", x.dose_amount("dose").alias("d"), x.dose_unit("unit").alias("u"), x.frequency("freq").alias("f"))
    return f.select("p_partkey", F.coalesce("d.value", F.lit(-1.0)).alias("amount"), F.col("d.confidence").alias("amount_conf"),
                    F.coalesce("u.value", F.lit("")).alias("unit"), F.coalesce("f.value", F.lit("")).alias("frequency"))


TIMING = ["after breakfast", "before food subah", "after lunch", "before dinner", "", "at night", "empty stomach"]
FREQ_WORDS = ["OD", "BD", "TDS", "QID", "HS", "SOS", "weekly"]
EARLY = "(contains(i, 'before') OR contains(i, 'pehle'))"
SCHEDULE_SQL = f"""
WITH r AS (SELECT p_partkey, {pick_sql(TIMING, 'p_partkey')} AS i, upper({pick_sql(FREQ_WORDS, 'p_partkey // 7')}) AS f FROM part),
s AS (SELECT *, CASE WHEN {EARLY} OR contains(i, 'empty stomach') THEN '07:30' ELSE '08:30' END AS mo, CASE WHEN {EARLY} THEN '12:30' ELSE '13:30' END AS lu,
  CASE WHEN {EARLY} THEN '19:30' ELSE '20:30' END AS di FROM r),
q AS (SELECT *, CASE f WHEN 'OD' THEN [mo] WHEN 'BD' THEN [mo, di] WHEN 'TDS' THEN [mo, lu, di] WHEN 'QID' THEN [mo, '12:30', '17:30', '21:30'] WHEN 'HS' THEN ['21:30']
  WHEN 'WEEKLY' THEN [mo] ELSE [] END AS byf, f IN ('BD', 'TDS', 'QID') AS many FROM s)
SELECT p_partkey, array_to_string(CASE WHEN regexp_matches(i, 'breakfast|subah|morning') THEN CASE WHEN many THEN byf ELSE [mo] END
  WHEN regexp_matches(i, 'lunch|afternoon|dopahar') THEN [lu] WHEN regexp_matches(i, 'dinner|night|raat') OR f = 'HS' THEN CASE WHEN many THEN byf WHEN f = 'HS' THEN ['21:30'] ELSE [di] END
  ELSE byf END, ',') AS times FROM q"""


@query("x11_schedule_times", SCHEDULE_SQL)
def x11(t: Tables):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", F.array_join(x.schedule_times(pick(FREQ_WORDS, F.floor(k / 7)), pick(TIMING, k)), ",").alias("times"))


DATE_TAILS = ["Date: {d}/{m}/2023", "follow up 2024-01-05\n{d} March 98", "Visit date 2022.{m}.{d}", "Sept {d}, 2021 seen", "Address 1-2-2020\nno date", "31/02/2024 then {d}-{m}-24",
              "{m} visits", "Report\n{d}-{m}-19\nRx date: 2020-{m}-{d}"]


def dated_texts(t: Tables):
    dd, mm = (F.col("doc_id") % 31 + 1).cast("string"), (F.col("doc_id") % 12 + 1).cast("string")
    tail = F.replace(F.replace(pick(DATE_TAILS, F.col("doc_id")), F.lit("{d}"), dd), F.lit("{m}"), mm)
    return t.documents.select("doc_id", F.concat_ws("\n", "text", tail).alias("text"))


def sql_date(s: str) -> str:
    out = []
    for n, (pattern, (y, m, dd)) in enumerate(x.DATE_PATTERNS):
        p = sql_literal(pattern)
        month = f"regexp_extract({s}, {p}, {m})"
        if n >= 2:
            month = "CASE substr(lower(" + month + "), 1, 3) " + " ".join(f"WHEN '{w}' THEN '{i + 1}'" for i, w in enumerate(x.MONTHS)) + " END"
        yr = f"try_cast(nullif(regexp_extract({s}, {p}, {y}), '') AS INT)"
        yr = f"CASE WHEN {yr} < 70 THEN {yr} + 2000 WHEN {yr} < 100 THEN {yr} + 1900 ELSE {yr} END"
        out.append(f"try_cast(lpad(({yr})::VARCHAR, 4, '0') || '-' || lpad({month}, 2, '0') || '-' || lpad(regexp_extract({s}, {p}, {dd}), 2, '0') AS DATE)")
    return f"coalesce({', '.join(out)})"


SKIP_SQL = " OR ".join(f"contains(lower(l), '{s}')" for s in x.SKIP_LINES)
DATE_SQL = f"""
WITH a AS (SELECT doc_id, string_split_regex(text || chr(10) || replace(replace({pick_sql(DATE_TAILS, 'doc_id')}, '{{d}}', (doc_id % 31 + 1)::VARCHAR), '{{m}}', (doc_id % 12 + 1)::VARCHAR), '\\r\\n|\\r|\\n') AS ls FROM documents),
b AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l FROM a),
c AS (SELECT doc_id, pos, {sql_date('l')} AS dt, regexp_matches(l, {sql_literal(x.LABELLED_DATE)}) AS lab, contains(lower(l), 'address') AS addr FROM b WHERE NOT ({SKIP_SQL})),
e AS (SELECT doc_id, coalesce(arg_min(dt, pos) FILTER (dt IS NOT NULL AND lab), arg_min(dt, pos) FILTER (dt IS NOT NULL AND NOT addr)) AS dt FROM c GROUP BY 1)
SELECT doc_id, coalesce(dt::VARCHAR, '') AS start_date FROM documents LEFT JOIN e USING (doc_id)""".replace("'\\\\r\\\\n|\\\\r|\\\\n'", "'\\r\\n|\\r|\\n'")


@query("x12_document_date", DATE_SQL)
def x12(t: Tables):
    return dated_texts(t).select("doc_id", F.coalesce(x.document_date(F.lit(None).cast("string"), "text").cast("string"), F.lit("")).alias("start_date"))


APPT_TAILS = ["cardiac review 30th may 2:00 PM at City Clinic", "dentist kal 5 baje shaam", "neurologist next friday morning", "appointment 12/03/2024 with Dr. Asha Rao 10:30 am",
              "kidney doctor parso", "video consult monday afternoon", "sugar doctor in two weeks 9 am", "book 5 feb evening me Hill Road"]


def dated_messages(t: Tables, tails):
    now = ts("2024-01-01 06:00:00") + F.make_dt_interval(F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    return t.conversations.select("conv_id", "turn", now.alias("now"), F.concat_ws(" . ", "text", pick(tails, F.col("conv_id") + F.col("turn"))).alias("msg"))


def dated_sql(tails) -> str:
    return (f"SELECT conv_id, turn, TIMESTAMP '2024-01-01 06:00:00' + to_days(conv_id::INT) + to_hours(turn) AS now, text || ' . ' || {pick_sql(tails, 'conv_id + turn')} AS msg FROM conversations")


def _w(words):
    from ..functions.core import word_pattern
    return f"regexp_matches(l, {sql_literal(word_pattern(words))})"


def _t(words):
    return "(" + " OR ".join(f"contains(l, {sql_literal(w)})" for w in words) + ")"


def _ymd(y, m, dd):
    return f"try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad(({dd})::VARCHAR, 2, '0') AS DATE)"


def _fwd(m, dd):
    this = _ymd("year(now)", m, dd)
    return f"CASE WHEN {this} < now::DATE THEN {_ymd('year(now) + 1', m, dd)} ELSE {this} END"


DMP, NDP, CLK, BJ = (sql_literal(p) for p in (x.DAY_MONTH, x.NUMERIC_DATE, x.CLOCK, x.BAJE))
MON = f"CASE substr(lower(regexp_extract(l, {DMP}, 2)), 1, 3) " + " ".join(f"WHEN '{w}' THEN '{i + 1}'" for i, w in enumerate(x.MONTHS)) + " END"
Y2 = f"try_cast(nullif(regexp_extract(l, {NDP}, 3), '') AS INT)"
DAY_SQL = f"""CASE WHEN {_t(['parso', 'day after tomorrow'])} THEN now::DATE + 2 WHEN {_w(['kal', 'tomorrow'])} THEN now::DATE + 1 WHEN {_w(['aaj', 'today'])} THEN now::DATE
 WHEN regexp_matches(l, 'in\\s+two\\s+weeks|do\\s+hafte|2\\s+weeks') THEN now::DATE + 14 WHEN contains(l, 'next week') THEN now::DATE + 7
 WHEN regexp_matches(l, {DMP}) THEN {_fwd(MON, f'regexp_extract(l, {DMP}, 1)')}
 WHEN regexp_matches(l, {NDP}) THEN CASE WHEN {Y2} IS NULL THEN {_fwd(f'regexp_extract(l, {NDP}, 2)', f'regexp_extract(l, {NDP}, 1)')}
   ELSE {_ymd(f'CASE WHEN {Y2} < 100 THEN {Y2} + 2000 ELSE {Y2} END', f'regexp_extract(l, {NDP}, 2)', f'regexp_extract(l, {NDP}, 1)')} END
 {' '.join(f"WHEN {_w([w])} THEN now::DATE + (CASE WHEN ({n} - (isodow(now) - 1) + 7) % 7 = 0 OR contains(l, 'next {w}') THEN 7 ELSE ({n} - (isodow(now) - 1) + 7) % 7 END)::INT" for w, n in x.WEEKDAY_WORDS)} END""".replace("\\\\", "\\")
HH, H2 = f"try_cast(regexp_extract(l, {CLK}, 1) AS INT)", f"try_cast(regexp_extract(l, {BJ}, 1) AS INT)"
MIN_SQL = f"""CASE WHEN regexp_matches(l, {CLK}) THEN (CASE WHEN regexp_extract(l, {CLK}, 3) = 'pm' AND {HH} <> 12 THEN {HH} + 12 WHEN regexp_extract(l, {CLK}, 3) = 'am' AND {HH} = 12 THEN 0 ELSE {HH} END % 24) * 60
   + coalesce(try_cast(nullif(regexp_extract(l, {CLK}, 2), '') AS INT), 0)
 WHEN regexp_matches(l, {BJ}) THEN (CASE WHEN {_w(['shaam', 'evening', 'raat'])} AND {H2} < 12 THEN {H2} + 12 ELSE {H2} END % 24) * 60 + coalesce(try_cast(nullif(regexp_extract(l, {BJ}, 2), '') AS INT), 0)
 WHEN {_w(['subah', 'morning'])} THEN 540 WHEN {_w(['afternoon', 'dopahar'])} THEN 840 WHEN {_w(['evening', 'shaam'])} THEN 1080 END"""
PROV = r"(?:^|[^0-9A-Za-z_])Dr\.?\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})"
APPT_SQL = f"""
WITH m AS (SELECT *, lower(msg) AS l FROM ({dated_sql(APPT_TAILS)})),
p AS (SELECT conv_id, turn, now, l, {DAY_SQL} AS day, {MIN_SQL} AS minute, CASE {' '.join(f"WHEN {_w(ws)} THEN '{n}'" for n, ws in x.DEPARTMENTS)} ELSE '' END AS department,
  CASE WHEN regexp_extract(msg, '{PROV}', 1) <> '' THEN 'Dr. ' || regexp_extract(msg, '{PROV}', 1) ELSE '' END AS provider,
  CASE WHEN contains(l, 'tele consult') OR contains(l, 'tele-consult') OR contains(l, 'video consult') OR contains(l, 'phone consult') THEN 'tele_consult' ELSE 'doctor' END AS kind FROM m),
q AS (SELECT *, day::TIMESTAMP + to_minutes(minute) AS ap FROM p)
SELECT conv_id, turn, kind, department, provider, coalesce(strftime(CASE WHEN ap < now - INTERVAL 2 HOUR THEN ap + INTERVAL 1 YEAR ELSE ap END, '%Y-%m-%d %H:%M'), '') AS appointment_at,
  array_to_string(list_filter([CASE WHEN day IS NULL THEN 'date' END, CASE WHEN minute IS NULL THEN 'time' END], lambda z: z IS NOT NULL), ',') AS missing FROM q"""


@query("x15_appointment_fields", APPT_SQL)
def x15(t: Tables):
    out = x.appointments(dated_messages(t, APPT_TAILS), ["conv_id", "turn"], "msg", "now")
    return out.select("conv_id", "turn", "kind", F.coalesce("department", F.lit("")).alias("department"), F.coalesce("provider", F.lit("")).alias("provider"),
                      F.coalesce(F.date_format("appointment_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("appointment_at"), "missing")


@query("x27_grounding", f"""
WITH s AS ({LAB_TEXT_SQL}), e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'prescription' ELSE 'lab_report' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN 'glucose' ELSE 'HbA1c' END AS name, CASE WHEN doc_id % 4 = 0 THEN 9999.0 ELSE (n_chars % 300 + 5)::DOUBLE END AS value FROM documents),
j AS (SELECT e.*, lower(text) AS src FROM e JOIN s USING (doc_id)),
k AS (SELECT doc_id, list_filter([CASE WHEN kind = 'lab_report' AND ((name = 'glucose' AND (value < 10 OR value > 800)) OR (name = 'HbA1c' AND (value < 3 OR value > 20))) THEN 'value:physical_limit' END,
  CASE WHEN NOT (contains(src, value::VARCHAR) OR contains(src, value::BIGINT::VARCHAR)) THEN 'value:not_in_source' END,
  CASE WHEN kind = 'prescription' AND NOT contains(src, lower(name)) THEN 'name:not_in_source' END], lambda z: z IS NOT NULL) AS errs FROM j)
SELECT doc_id, array_to_string(errs, ',') AS errors, len(errs) > 0 AS needs_review FROM k""")
def x27(t: Tables):
    docs = lab_texts(t)
    k = F.col("doc_id")
    ext = docs.select("doc_id", F.when(k % 2 == 0, "prescription").otherwise("lab_report").alias("kind"),
                      F.when(k % 3 == 0, "glucose").otherwise("HbA1c").alias("name"),
                      F.when(k % 4 == 0, 9999.0).otherwise((F.col("n_chars") % 300 + 5).cast("double")).alias("value"))
    out = x.ground(ext, docs, "doc_id", "text", name="name", value="value", kind="kind")
    return out.select("doc_id", F.array_join("errors", ",").alias("errors"), "needs_review")


@query("x28_fill_missing", f"""
WITH {FIELDS_SQL} SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'UNKNOWN_DRUG' ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'missing_drug_name' ELSE '' END AS flag,
  coalesce(unit, 'mg') AS unit, coalesce(frequency, 'OD') AS freq FROM n2""")
def x28(t: Tables):
    f = raw_fields(t).select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, " ").otherwise(F.col("p_name")).alias("name"),
                             x.dose_unit("unit")["value"].alias("unit"), x.frequency("freq")["value"].alias("freq"))
    return x.fill_missing(f, "name", "unit", "freq").select("p_partkey", "name", "flag", "unit", "freq")


A21_SQL = f"""
WITH {FIELDS_SQL}, c AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 0.92 WHEN 1 THEN 0.95 WHEN 2 THEN 0.88 ELSE 0.5 END::DOUBLE AS nc, coalesce(amount * CASE frequency WHEN 'BD' THEN 2 WHEN 'TDS' THEN 3 WHEN 'QID' THEN 4 WHEN 'SOS' THEN 0 ELSE 1 END > p_size * 12 OR amount <= 0, FALSE) AS sus FROM n2),
e AS (SELECT p_partkey, round(nc * 0.4 + amount_conf * 0.2 + (unit IS NOT NULL)::INT * 0.2::DOUBLE + (frequency IS NOT NULL)::INT * 0.2::DOUBLE, 3) AS confidence, list_filter([CASE WHEN nc < 0.8 THEN 'drug_name' END,
  CASE WHEN amount IS NULL OR amount_conf < 1 OR (unit IS NOT NULL AND frequency IS NOT NULL AND sus) THEN 'dose_amount' END, CASE WHEN unit IS NULL THEN 'dose_unit' END, CASE WHEN frequency IS NULL THEN 'frequency' END], lambda z: z IS NOT NULL) AS un FROM c)
SELECT p_partkey, confidence, array_to_string(un, ',') AS unresolved, CASE WHEN len(un) = 0 AND confidence >= 0.85 THEN 'interaction_pending' ELSE 'suspicious' END AS status FROM e"""


def candidate_records(t: Tables):
    f = raw_fields(t).select("p_partkey", "p_name", "p_size", x.dose_amount("dose").alias("d"), x.dose_unit("unit").alias("u"), x.frequency("freq").alias("f"))
    k = F.col("p_partkey") % 4
    nc = F.when(k == 0, 0.92).when(k == 1, 0.95).when(k == 2, 0.88).otherwise(0.5)
    sus = a.suspicious_dose("d.value", "f.value", F.array(F.col("p_size").cast("double")))
    cols = a.record_confidence(F.col("p_name"), nc, F.col("d.value"), F.col("d.confidence"), F.col("u.value"), F.col("u.confidence"),
                               F.col("f.value"), F.col("f.confidence"), sus)
    return f.select("p_partkey", "p_name", F.col("d.value").alias("dose"), F.col("u.value").alias("unit"), F.col("f.value").alias("frequency"),
                    *[e.alias(n) for n, e in cols.items()])


@query("a21_record_confidence", A21_SQL)
def a21(t: Tables):
    return candidate_records(t).select("p_partkey", "confidence", F.array_join("unresolved", ",").alias("unresolved"), "status")
