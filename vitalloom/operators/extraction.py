"""Rows out of text: vitals, labs, prescriptions, dates, schedules, appointments, grounding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import patterns as p
from ..functions import vocabulary as v
from ..functions.core import WORD, c, first_match, has_text, has_word
from ..functions.text import let, literal_map, one_space
from .documents import cleaned
from .filters import PHYSICAL_LIMITS, vital_severity

EDGE_L, EDGE_R = f"(?:^|[^{WORD}])", f"(?:$|[^{WORD}])"

# Fixed patterns of vital signs: name, pattern, group of the value.
VITAL_PATTERNS = {
    "bp": r"(?i)bp\s*[:\-]?\s*(\d{2,3})\s*/\s*(\d{2,3})",
    "glucose": r"(?i)(sugar|glucose|blood\s*sugar)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(mg/dl|mmol)?",
    "pulse": r"(?i)(pulse|heart\s*rate)\s*[:\-]?\s*(\d+)\s*(bpm)?",
    "spo2": r"(?i)(spo2|oxygen|saturation)\s*[:\-]?\s*(\d+)\s*%?",
    "temperature": r"(?i)(temp|temperature|bukhar)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(°?f|°?c|f|c)?",
}


def vital_signs(df: DataFrame, keys: Sequence[str], text: str, older: Column | None = None,
                copd: Column | None = None) -> DataFrame:
    """All vital signs of a text, in usual units, with severity and confidence."""
    def reading(kind: str, m: Column) -> Column:
        pat = VITAL_PATTERNS[kind]
        if kind == "bp":
            return F.struct(F.lit(kind).alias("test"), F.regexp_extract(m, pat, 1).cast("double").alias("value"),
                            F.regexp_extract(m, pat, 2).cast("double").alias("secondary"), F.lit("mmHg").alias("unit"),
                            F.lit(0.98).alias("confidence"))
        value = F.regexp_extract(m, pat, 2).cast("double")
        unit = F.lower(F.regexp_extract(m, pat, 3)) if kind != "spo2" else F.lit("")
        if kind == "glucose":
            value, unit_out = F.when(unit == "mmol", value * 18.0).otherwise(value), F.lit("mg/dl")
            conf = F.when(unit == "", 0.9).otherwise(0.95)
        elif kind == "temperature":
            value = F.when(unit.contains("f"), (value - 32) * 5 / 9).otherwise(value)
            unit_out, conf = F.lit("C"), F.lit(0.95)
        elif kind == "pulse":
            unit_out, conf = F.lit("bpm"), F.when(unit == "bpm", 0.95).otherwise(0.9)
        else:
            unit_out, conf = F.lit("%"), F.lit(0.95)
        return F.struct(F.lit(kind).alias("test"), value.alias("value"), F.lit(None).cast("double").alias("secondary"),
                        unit_out.alias("unit"), conf.alias("confidence"))

    found = F.concat(*[_readings(text, k, reading) for k in VITAL_PATTERNS])
    rows = df.select(*keys, *([older.alias("__o")] if older is not None else []),
                     *([copd.alias("__c")] if copd is not None else []), F.posexplode_outer(found).alias("pos", "r")).where("pos IS NOT NULL")
    sev = vital_severity("r.test", "r.value", "r.secondary", F.col("__o") if older is not None else None,
                         F.col("__c") if copd is not None else None)
    return rows.select(*keys, "pos", "r.test", F.round("r.value", 2).alias("value"), "r.secondary", "r.unit",
                       "r.confidence", sev.alias("severity"))


def _readings(text: str, kind: str, reading) -> Column:
    return F.transform(F.regexp_extract_all(c(text), F.lit(VITAL_PATTERNS[kind]), 0), lambda m: reading(kind, m))


LAB_ROW = rf"(?i)({v.LAB_NAME_PATTERN})\s*[:\-]?\s*(\d+(?:\.\d+)?)[ \t]*([a-zA-Z/%µ°]+)?([^\n\r]{{0,80}})"
RANGE_LABELLED = r"(?i)(?:ref(?:erence)?(?:\s*range)?|normal)\s*[:=]?\s*(\d+(?:\.\d+)?)\s*(?:-|–|to)\s*(\d+(?:\.\d+)?)"
RANGE_PLAIN = r"\(?\s*(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*\)?"


def _number(s: Column) -> Column:
    return F.nullif(s, F.lit("")).cast("double")


LAB_TYPE = pa.struct([("test_name", pa.string()), ("value", pa.float64()), ("unit", pa.string()), ("low", pa.float64()), ("high", pa.float64())])


def _labs_of(texts: pa.Array) -> pa.Array:
    # clean texts hold no NUL, so it parts the matches from the rest
    parts = pc.split_pattern(p.replaced(cleaned(texts), f"({LAB_ROW})", "\0$1\0"), "\0")
    row = np.asarray(pc.list_parent_indices(parts))
    place = np.arange(len(row)) - np.asarray(parts.offsets)[row] + parts.offsets[0].as_py()
    m = pc.filter(parts.flatten(), pa.array(place % 2 == 1))
    names = p.one_space(p.replaced(pc.utf8_lower(p.group(m, LAB_ROW, 1)), "[^a-z0-9% ]+", " "))
    tail = pc.fill_null(p.group(m, LAB_ROW, 4), "")
    low, high = (pc.coalesce(p.doubles(p.group(tail, RANGE_LABELLED, n)), p.doubles(p.group(tail, RANGE_PLAIN, n))) for n in (1, 2))
    columns = [pa.array([v.ALL_LAB_ALIASES.get(x, x.replace(" ", "_")) for x in names.to_pylist()], pa.string()), p.doubles(p.group(m, LAB_ROW, 2)),
               pc.fill_null(p.group(m, LAB_ROW, 3), "").cast(pa.string()), low, high]
    return p.lists(len(texts), row[place % 2 == 1], pa.StructArray.from_arrays(columns, fields=list(LAB_TYPE)))


@F.arrow_udf(T.ArrayType(from_arrow_type(LAB_TYPE)))
def _labs(texts: pa.Array) -> pa.Array:
    return p.joined([_labs_of(t) for t in p.steps(texts)], pa.list_(LAB_TYPE))


def lab_array(text: str | Column) -> Column:
    """Lab rows of a text as an array of (test_name, value, unit, low, high), in text order."""
    return _labs(c(text))


def lab_rows(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Lab rows of a text: canonical name, value, unit and range; equal rows once."""
    return merged_labs(exploded(df, keys, lab_array(text), "pos", "r"), keys)


def merged_labs(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal lab rows (keys, pos, r) once, with the first one's range."""
    rows = each.select(*keys, "pos", "r.*")
    return rows.groupBy(*keys, "test_name", "value", "unit").agg(
        F.min_by(F.struct("low", "high"), "pos").alias("__r")).select(*keys, "test_name", "value", "unit", "__r.low", "__r.high")


# --- doses, units, frequencies, schedules --------------------------------------------

def dose_amount(raw: str | Column) -> Column:
    """Struct (value, confidence): 0 < v <= 10000 is sure, other numbers are not."""
    def rate(n: Column) -> Column:
        conf = F.when(n.isNull(), 0.0).when((n <= 0) | (n > 10000), 0.25).otherwise(1.0)
        return F.struct(n.alias("value"), conf.alias("confidence"))
    return let(_number(F.regexp_extract(c(raw).cast("string"), r"(\d+(?:\.\d+)?)", 1)), rate)


def dose_unit(raw: str | Column) -> Column:
    """Struct (value, confidence) in the controlled units."""
    def check(u: Column) -> Column:
        ok = u.isin(*v.UNITS)
        return F.struct(F.when(ok, u).alias("value"), F.when(ok, 1.0).otherwise(0.0).alias("confidence"))
    low = F.lower(F.trim(F.coalesce(c(raw), F.lit(""))))
    return let(F.coalesce(F.try_element_at(literal_map(v.UNIT_ALIASES), low), low), check)


REGIMEN = r"(?:^|[^0-9A-Za-z_])([01]\s*-\s*[01]\s*-\s*[01](?:\s*-\s*[01])?)(?:$|[^0-9A-Za-z_])"


def frequency(raw: str | Column) -> Column:
    """Struct (value, confidence): shorthand, words or a 1-0-1 regimen."""
    table = literal_map(v.FREQUENCIES)
    def check(t: Column) -> Column:
        regimen = F.regexp_replace(F.regexp_extract(t, REGIMEN, 1), r"\s+", "")
        found = F.coalesce(F.try_element_at(table, t), F.try_element_at(table, regimen))
        return F.struct(found.alias("value"), F.when(found.isNull(), 0.0).otherwise(1.0).alias("confidence"))
    return let(one_space(F.lower(F.coalesce(c(raw), F.lit("")))), check)


def schedule_times(freq: str | Column, instructions: str | Column, table: dict | None = None) -> Column:
    """Clock times from frequency and instruction words, as an array of HH:MM."""
    f = F.upper(F.trim(F.coalesce(c(freq), F.lit(""))))
    t = F.lower(F.trim(F.coalesce(c(instructions), F.lit(""))))
    early = has_text(t, ["before", "pehle"])
    fasting = early | t.contains("empty stomach")
    def slot(first, other, cond=early):
        return F.when(cond, first).otherwise(other)
    morning, lunch, dinner = slot("07:30", "08:30", fasting), slot("12:30", "13:30"), slot("19:30", "20:30")
    empty = F.array().cast("array<string>")
    by_freq = first_match([
        (f == "OD", F.array(morning)), (f == "BD", F.array(morning, dinner)), (f == "TDS", F.array(morning, lunch, dinner)),
        (f == "QID", F.array(morning, F.lit("12:30"), F.lit("17:30"), F.lit("21:30"))), (f == "HS", F.array(F.lit("21:30"))),
        (f == "WEEKLY", F.array(morning))], empty)
    if table:
        by_freq = first_match([(f == k, F.array(*[F.lit(x) for x in ts]).cast("array<string>")) for k, ts in table.items()], empty)
    many = f.isin("BD", "TDS", "QID")
    return first_match([
        (has_text(t, ["breakfast", "subah", "morning"]), F.when(many, by_freq).otherwise(F.array(morning))),
        (has_text(t, ["lunch", "afternoon", "dopahar"]), F.array(lunch)),
        (has_text(t, ["dinner", "night", "raat"]) | (f == "HS"),
         F.when(many, by_freq).when(f == "HS", F.array(F.lit("21:30"))).otherwise(F.array(dinner))),
    ], by_freq)


# --- prescriptions ------------------------------------------------------------------------

# Words that open an item or close it, and units.
MARKERS = "|".join(("rx", "lx") + v.FORM_WORDS[:-1])
ENDINGS = r"once +a +day|once +daily|twice +daily|three +times +a +day|3 +times +a +day|once +a +week|sos|bd|tds|qid|hs|\d *- *\d *- *\d"
UNIT_WORDS = ("mg|mcg|grams|gram|g|ml|iu|units|unit|tsp|teaspoon|tbsp|tablespoon|spoon|drops|drop|puffs|puff|sprays|spray|"
              "sachet|vial|ampoule|amp|applications|application")
WORD_DOSES = {"one": 1.0, "two": 2.0, "three": 3.0, "half": 0.5}  # fixed values
WORD_UNITS = "grams|gram|g|teaspoon|spoon|tsp|tbsp|drops|drop|puffs|puff|sprays|spray"
DOSE = rf"(?i){EDGE_L}(\d+(?:\.\d+)?)\s*({UNIT_WORDS}){EDGE_R}"
FRACTION = rf"(?i){EDGE_L}(\d+)\s*/\s*([1-9]\d*)\s*(?:tea|teaspoon|spoon)"
WORD_DOSE = rf"(?i){EDGE_L}(one|two|three|half)\s+({WORD_UNITS}){EDGE_R}"
REGIMEN_ROW = rf"{EDGE_L}([01])\s*-\s*([01])\s*-\s*([01]){EDGE_R}"
# Misread dose texts and their repair, in order.
DOSE_REPAIRS = (
    (rf"(?i)({EDGE_L})to\s+(\d{{1,4}})(\s+\d\s*-\s*\d\s*-\s*\d)", "$1$2 mg$3"),
    (rf"({EDGE_L})(\d{{1,4}})(\s+\d\s*-\s*\d\s*-\s*\d)", "$1$2 mg$3"),
    (rf"(?i)({EDGE_L})[il]o\s*mg({EDGE_R})", "$110 mg$2"),
    (rf"(?i)({EDGE_L})(\d+)oo\s*mg({EDGE_R})", "$1$200 mg$3"),
    (rf"(?i)({EDGE_L})(\d+)o\s*mg({EDGE_R})", "$1$20 mg$3"),
    (rf"(?i)({EDGE_L})(\d+)s[o0]\s*m({EDGE_R})", "$1$250 mg$3"),
    (rf"(?i)({EDGE_L})([1-9]\d+)\s*g({EDGE_R})", "$1$2 mg$3"),
    (rf"(?i)({EDGE_L})(\d+)\s*/\s*b({EDGE_R})", "$1$2/3$3"),
    (rf"(?i)({EDGE_L})3\s*tines?\s*a\s*day({EDGE_R})", "$1three times a day$2"),
)
# Frequency words of a prescription row, first hit wins.
ROW_FREQUENCIES = (
    ("sos", "SOS"), (r"od|once\s+daily|once\s+a\s+day|daily", "OD"), (r"bd|twice\s+daily|twice\s+a\s+day", "BD"),
    (r"tds|three\s+times\s+daily|three\s+times\s+a\s+day|3\s*times|3\s*tines?\s*a\s*day", "TDS"),
    (r"qid|four\s+times\s+daily|four\s+times\s+a\s+day", "QID"), ("hs|bedtime|night", "HS"),
    (r"once\s+a\s+week|weekly", "weekly"))
ROW_REGIMENS = {"100": "OD", "010": "OD", "001": "HS", "101": "BD", "110": "BD", "011": "BD", "111": "TDS"}
# Misread item names.
NAME_REPAIRS = ((r"(?i)\b2ING\b", "ZINC"), (r"(?i)\bCROUIN\b", "CROCIN"), (r"(?i)\bCROUN\b", "CROCIN"),
                (r"(?i)\bCHLORD\s+QUINE\b", "CHLOROQUINE"), (r"(?i)\bHYDRONY\b", "HYDROXY"))
# A doctor or address ends the item; the reason to take it is no part of its name.
NOT_ITEM = rf"(?i){EDGE_L}(?:DR\.?\s|(?:D\.?\s*RAJ|MBBS|SENIOR\s*CONSULTANT|Residence){EDGE_R})"
TAKEN_FOR = r"(?i)\b(?:in case of|in case if|in case|for)\s+(?:fever|pain|throat|cough|cold)\b"
LOOKS_LIKE_ITEM = (rf"(?i){EDGE_L}(?:{'|'.join(v.FORM_WORDS[:-1])}|sos|od|bd|tds|qid|hs){EDGE_R}|"
                   rf"{EDGE_L}\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|tsp|teaspoon|tbsp|tablespoon|spoon|drops?|puffs?|sprays?){EDGE_R}|"
                   rf"{EDGE_L}\d\s*-\s*\d\s*-\s*\d{EDGE_R}")
STOP_AT = (rf"(?i){EDGE_L}\d+(?:\.\d+)?\s*(?:{UNIT_WORDS}){EDGE_R}|{EDGE_L}\d+\s*/\s*\d+|{EDGE_L}(?:one|two|three|half)\s+(?:{WORD_UNITS}){EDGE_R}|"
           rf"{EDGE_L}(?:sos|od|bd|tds|qid|hs|once|twice|daily|weekly|three\s+times|3\s*times){EDGE_R}|{EDGE_L}[01]\s*-\s*[01]\s*-\s*[01]")


def repaired(s: pa.Array) -> pa.Array:
    """Misread doses put right, in segments that have a digit."""
    out = s
    for pattern, new in DOSE_REPAIRS:
        out = p.replaced(out, pattern, new)
    return pc.if_else(pc.match_substring_regex(s, r"\d"), out, s)


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of prescriptions that look like an item, and their rows: cut before item markers and after frequencies."""
    t = pc.replace_substring(p.one_space(cleaned(texts)), " ", "  ")
    t = p.replaced(t, rf"(?i)({EDGE_L})({MARKERS})({EDGE_R})", "$1\n$2$3")
    t = p.replaced(t, rf"(?i)({EDGE_L})({ENDINGS})({EDGE_R})", "$1$2\n$3")
    parts = pc.split_pattern(t, "\n")
    s = p.replaced(p.one_space(parts.flatten()), r"^[ .•*:;-]+|[ .•*:;-]+$", "")
    looks = pc.or_(pc.match_substring_regex(s, LOOKS_LIKE_ITEM), pc.match_substring_regex(repaired(s), LOOKS_LIKE_ITEM))
    kept = pc.and_(pc.greater_equal(pc.utf8_length(s), 3), looks)
    return pc.filter(s, kept), np.asarray(pc.list_parent_indices(parts))[np.asarray(kept)]


def exploded(df: DataFrame, keys: Sequence[str], items: Column, *names: str) -> DataFrame:
    """Positions and items of an array. The outer form with a null test keeps Spark from
    computing a costly array a second time just to skip empty ones."""
    return df.select(*keys, F.posexplode_outer(items).alias(*names)).where(F.col(names[0]).isNotNull())


def row_frequency(s: pa.Array) -> pa.Array:
    regimen = pc.binary_join_element_wise(*[p.group(s, REGIMEN_ROW, i) for i in (1, 2, 3)], "")
    words = [p.mapped(regimen, ROW_REGIMENS, pa.string())]
    words += [pc.if_else(pc.match_substring_regex(s, rf"(?i){EDGE_L}(?:{w}){EDGE_R}"), f, pa.scalar(None, pa.string())) for w, f in ROW_FREQUENCIES]
    return pc.coalesce(*words)


DOSE_TYPE = pa.struct([("value", pa.float64()), ("unit", pa.string())])


def row_dose(s: pa.Array) -> pa.Array:
    """Struct (value, unit): fraction of a spoon, number with unit, or word number."""
    frac = pc.divide(p.doubles(p.group(s, FRACTION, 1)), p.doubles(p.group(s, FRACTION, 2)))
    word = p.mapped(pc.utf8_lower(p.group(s, WORD_DOSE, 1)), WORD_DOSES, pa.float64())
    unit = pc.utf8_lower(pc.coalesce(p.group(s, DOSE, 2), p.group(s, WORD_DOSE, 2)))
    unit = pc.if_else(pc.is_in(unit, pa.array(["gram", "grams"], unit.type)), "g", unit)
    value = pc.coalesce(frac, p.doubles(p.group(s, DOSE, 1)), word)
    return pa.StructArray.from_arrays([value, pc.if_else(pc.is_valid(frac), "teaspoon", unit).cast(pa.string())], fields=list(DOSE_TYPE))


def item_name(s: pa.Array) -> pa.Array:
    """Name in a repaired segment: the part before the first dose or frequency."""
    t = p.replaced(s, rf"(?i)^(?:(?:rx|lx)\.? +)?(?:(?:{'|'.join(v.FORM_WORDS)})\.? +)?", "")
    t = p.before(t, STOP_AT)
    t = p.replaced(t, "(?i)(?:" + "|".join(v.ADVICE) + ")", " ")
    t = p.one_space(p.replaced(t, "[^A-Za-z0-9/+ -]+", " "))
    t = p.replaced(p.replaced(t, r"^[ /-]+|[ /-]+$", ""), r" *- *", "-")
    for pattern, new in NAME_REPAIRS:
        t = p.replaced(t, pattern, new)
    t = pc.utf8_trim(p.replaced(t, r"(?i)(?:^| )to$", ""), " ")
    form = pc.is_in(pc.utf8_lower(t), pa.array(["tab", "cap", "syrup", "syp", "syr", "inj", "drop", "medicine"], t.type))
    return pc.if_else(pc.and_(pc.greater_equal(pc.utf8_length(t), 2), pc.invert(form)), t, None)


def prescriber(text: str | Column) -> Column:
    name = F.regexp_extract(c(text), rf"(?i){EDGE_L}dr\.?\s+([A-Za-z][A-Za-z .-]{{2,50}})", 1)
    return F.when(name != "", F.concat(F.lit("Dr. "), one_space(name)))


ITEM_TYPE = pa.struct([("item", pa.string()), ("dose", DOSE_TYPE), ("frequency", pa.string()), ("instructions", pa.string()), ("advice", pa.string())])


def item_fields(segment: pa.Array) -> pa.Array:
    """Struct of all fields of each segment: the part up to a doctor's name or address, without the reason to take the item."""
    s = p.replaced(p.before(repaired(segment), NOT_ITEM), TAKEN_FOR, "")
    columns = [item_name(s), row_dose(s), row_frequency(s), p.phrases(segment, v.INSTRUCTIONS), p.phrases(segment, v.ADVICE)]
    return pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(columns, ITEM_TYPE, strict=True)], fields=list(ITEM_TYPE))


def _items_of(texts: pa.Array) -> pa.Array:
    found, row = segments(texts)
    return p.lists(len(texts), row, item_fields(found))


@F.arrow_udf(T.ArrayType(from_arrow_type(ITEM_TYPE)))
def _items(texts: pa.Array) -> pa.Array:
    return p.joined([_items_of(t) for t in p.steps(texts)], pa.list_(ITEM_TYPE))


def item_array(text: str | Column) -> Column:
    """Items of a prescription text as an array of structs, in text order."""
    return _items(c(text))


def item_key(item: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(item), "[^a-z0-9]+", " "))


def prescription_items(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Items of each prescription text, equal (name, dose, unit, frequency) once."""
    return merged_items(exploded(df, keys, item_array(text), "pos", "r"), keys)


def merged_items(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal items (keys, pos, r) once, with the first one's words."""
    rows = each.where("r.item IS NOT NULL").select(
        *keys, "pos", "r.item", F.col("r.dose.value").alias("dose"), F.col("r.dose.unit").alias("unit"), "r.frequency",
        "r.instructions", "r.advice")
    return rows.withColumn("__k", item_key(F.col("item"))).groupBy(*keys, "__k", "dose", "unit", "frequency").agg(
        F.min_by(F.struct("pos", "item", "instructions", "advice"), "pos").alias("__r")).select(
        *keys, "__r.pos", "__r.item", "dose", "unit", "frequency", "__r.instructions", "__r.advice")


# Lines that can start an item or fill a field; all others are left out before the costly patterns.
TELLING = (r"(?i)\d|" + EDGE_L + "(?:one|two|three|half|sos|od|bd|tds|qid|hs|once|twice|daily|weekly|bedtime|night|"
           + "|".join(v.FORM_WORDS[:-1]) + ")" + EDGE_R + "|" + "|".join(v.INSTRUCTIONS + v.ADVICE))
ITEM_LINE = rf"(?i)^\s*(?:rx\s*)?(?:{'|'.join(v.FORM_WORDS[:-1])})[\s.:-]+"
DOSE_LINE = r"(?i)[A-Za-z][A-Za-z0-9+\-/ ]{2,}\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|units?)(?:$|[^0-9A-Za-z_])"


LINE_TYPE = pa.struct([("start", pa.bool_()), ("x", ITEM_TYPE)])


def _item_lines_of(texts: pa.Array) -> pa.Array:
    lines = pc.split_pattern_regex(pc.fill_null(texts, ""), "\r\n|\r|\n")
    s = p.one_space(lines.flatten())
    told = pc.match_substring_regex(s, TELLING)
    kept = pc.filter(s, told)
    start = pc.or_(pc.match_substring_regex(kept, ITEM_LINE), pc.match_substring_regex(kept, DOSE_LINE))
    return p.lists(len(texts), np.asarray(pc.list_parent_indices(lines))[np.asarray(told)], pa.StructArray.from_arrays([start, item_fields(kept)], fields=list(LINE_TYPE)))


@F.arrow_udf(T.ArrayType(from_arrow_type(LINE_TYPE)))
def _item_lines(texts: pa.Array) -> pa.Array:
    return p.joined([_item_lines_of(t) for t in p.steps(texts)], pa.list_(LINE_TYPE))


def prescription_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Line form: a marker or dose line starts an item, later lines fill what it lacks.

    The item number is a running count inside the document; the fields fold by
    first-non-null, so only the document's own lines meet.
    """
    rows = exploded(df, keys, _item_lines(c(text)), "pos", "r").select(*keys, "pos", F.col("r.start").alias("__start"), "r.x.*")
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("item_no", F.sum(F.col("__start").cast("int")).over(w)).where("item_no > 0")
    rows = rows.withColumns({
        "__name": F.when(F.col("__start"), F.col("item")), "__d": F.col("dose"), "__f": F.col("frequency"),
        "__i": F.nullif(F.col("instructions"), F.lit("")), "__a": F.nullif(F.col("advice"), F.lit(""))})
    def first(col):
        return F.min_by(col, F.when(col.isNotNull(), F.col("pos")))
    def all_of(col):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(col.isNotNull(), F.struct("pos", col.alias("x"))))), lambda r: r["x"]), "; ")
    dose = F.when(F.col("__d.value").isNotNull(), F.col("__d"))
    return rows.groupBy(*keys, "item_no").agg(
        first(F.col("__name")).alias("item"), first(dose).alias("__dose"), first(F.col("__f")).alias("frequency"),
        all_of(F.col("__i")).alias("instructions"), all_of(F.col("__a")).alias("advice")).where("item IS NOT NULL").select(
        *keys, "item_no", "item", F.col("__dose.value").alias("dose"), F.col("__dose.unit").alias("unit"), "frequency",
        "instructions", "advice")


# --- dates -----------------------------------------------------------------------------------

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORD = "(jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)[a-z]*"
NB_L, NB_R = r"(?:^|[^0-9A-Za-z_])", r"(?:$|[^0-9A-Za-z_])"
DATE_PATTERNS = (
    (rf"{NB_L}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){NB_R}", (1, 2, 3)),
    (rf"{NB_L}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{2,4}}){NB_R}", (3, 2, 1)),
    (rf"(?i){NB_L}(\d{{1,2}})\s+{MONTH_WORD}\s+(\d{{2,4}}){NB_R}", (3, 2, 1)),
    (rf"(?i){NB_L}{MONTH_WORD}\s+(\d{{1,2}}),?\s+(\d{{2,4}}){NB_R}", (3, 1, 2)),
)


def month_number(word: Column) -> Column:
    return F.try_element_at(literal_map({m: str(i + 1) for i, m in enumerate(MONTHS)}), F.substring(F.lower(word), 1, 3))


def four_digit_year(y: Column) -> Column:
    n = y.try_cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n)


def visible_date(text: str | Column) -> Column:
    """First readable date of a text, day first; an impossible date falls to the next form."""
    t = c(text)
    out = []
    for n, (pattern, (y, m, d)) in enumerate(DATE_PATTERNS):
        month = F.regexp_extract(t, pattern, m)
        month = month if n < 2 else month_number(month)
        year = F.lpad(four_digit_year(F.nullif(F.regexp_extract(t, pattern, y), F.lit(""))).cast("string"), 4, "0")
        day = F.regexp_extract(t, pattern, d)
        out.append(F.try_to_date(F.concat_ws("-", F.nullif(year, F.lit("")), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(*out)


# Lines that carry other dates.
SKIP_LINES = ("follow up", "follow-up", "review after", "d.no", "reg.", "ph:", "opno")
LABELLED_DATE = rf"(?i){NB_L}date{NB_R}"


def document_date(explicit: str | Column, text: str | Column) -> Column:
    """Explicit field, else a labelled line, else any line that is not to be skipped."""
    lines = F.filter(F.split(F.coalesce(c(text), F.lit("")), "\r\n|\r|\n"), lambda x: x.rlike(r"\d"))
    def search(ls: Column) -> Column:
        usable = F.filter(ls, lambda x: ~has_text(F.lower(x), SKIP_LINES))
        dated = F.filter(F.transform(usable, lambda x: F.struct(
            visible_date(x).alias("d"), x.rlike(LABELLED_DATE).alias("labelled"), F.lower(x).contains("address").alias("skip"))),
            lambda r: r["d"].isNotNull())
        return let(dated, lambda ds: F.coalesce(F.get(F.filter(ds, lambda r: r["labelled"]), 0)["d"],
                                               F.get(F.filter(ds, lambda r: ~r["skip"]), 0)["d"]))
    return F.coalesce(visible_date(explicit), let(lines, search))


# --- appointments --------------------------------------------------------------------------------

# Departments by their words, and weekday words by number from Monday.
DEPARTMENTS = (
    ("cardiology", ("cardiology", "cardiologist", "cardiac", "cardio", "heart", "heart doctor", "heart specialist", "dil")),
    ("nephrology", ("nephrology", "nephrologist", "kidney specialist", "kidney doctor")),
    ("endocrinology", ("endocrinology", "endocrinologist", "diabetes doctor", "sugar doctor")),
    ("neurology", ("neurology", "neurologist", "brain doctor")),
    ("psychiatry", ("psychiatry", "psychiatrist")), ("dentistry", ("dentist", "dental")))
WEEKDAY_WORDS = (("monday", 0), ("tuesday", 1), ("wednesday", 2), ("thursday", 3), ("friday", 4), ("saturday", 5), ("sunday", 6),
                 ("somwar", 0), ("mangalwar", 1), ("budhwar", 2), ("guruvar", 3), ("shukrawar", 4), ("shanivar", 5), ("ravivar", 6))
DAY_MONTH = rf"{NB_L}(\d{{1,2}})(?:st|nd|rd|th)?\s+{MONTH_WORD}{NB_R}"
NUMERIC_DATE = rf"{NB_L}(\d{{1,2}})[/-](\d{{1,2}})(?:[/-](\d{{2,4}}))?{NB_R}"
CLOCK = rf"{NB_L}(\d{{1,2}})(?::(\d{{2}}))?\s*(am|pm){NB_R}"
BAJE = rf"{NB_L}(\d{{1,2}})(?::(\d{{2}}))?\s*baje{NB_R}"


def appointment_date(text: Column, now: Column) -> Column:
    """Target day of a message sent at ``now``: relative words, day and month rolled
    forward when past, numeric dates, weekday names."""
    today = F.to_date(now)
    def ymd(y, m, d):
        return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    def forward(m, d):
        this = ymd(F.year(today), m, d)
        return F.when(this < today, ymd(F.year(today) + 1, m, d)).otherwise(this)
    d1, m1 = F.regexp_extract(text, DAY_MONTH, 1), month_number(F.regexp_extract(text, DAY_MONTH, 2))
    d2, m2, y2 = (F.regexp_extract(text, NUMERIC_DATE, i) for i in (1, 2, 3))
    y = F.nullif(y2, F.lit("")).try_cast("int")
    numeric = F.when(y.isNull(), forward(m2, d2)).otherwise(ymd(F.when(y < 100, y + 2000).otherwise(y), m2, d2))
    rules = [(has_text(text, ["parso", "day after tomorrow"]), F.date_add(today, 2)), (has_word(text, ["kal", "tomorrow"]), F.date_add(today, 1)),
             (has_word(text, ["aaj", "today"]), today), (text.rlike(r"in\s+two\s+weeks|do\s+hafte|2\s+weeks"), F.date_add(today, 14)),
             (text.contains("next week"), F.date_add(today, 7)), (text.rlike(DAY_MONTH), forward(m1, d1)), (text.rlike(NUMERIC_DATE), numeric)]
    weekday = F.weekday(today)
    for word, n in WEEKDAY_WORDS:
        delta = F.pmod(F.lit(n) - weekday, F.lit(7))
        delta = F.when((delta == 0) | text.contains(f"next {word}"), 7).otherwise(delta)
        rules.append((has_word(text, [word]), F.date_add(today, delta.cast("int"))))
    return first_match(rules)


def appointment_minute(text: Column) -> Column:
    """Minute of the day: clock with am/pm, with *baje*, or a day part."""
    h, m, ap = (F.regexp_extract(text, CLOCK, i) for i in (1, 2, 3))
    hh, mm = h.try_cast("int"), F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0))
    clock = F.pmod(F.when((ap == "pm") & (hh != 12), hh + 12).when((ap == "am") & (hh == 12), 0).otherwise(hh), F.lit(24)) * 60 + mm
    h2 = F.regexp_extract(text, BAJE, 1).try_cast("int")
    m2 = F.coalesce(F.nullif(F.regexp_extract(text, BAJE, 2), F.lit("")).try_cast("int"), F.lit(0))
    baje = F.pmod(F.when(has_word(text, ["shaam", "evening", "raat"]) & (h2 < 12), h2 + 12).otherwise(h2), F.lit(24)) * 60 + m2
    return first_match([(text.rlike(CLOCK), clock), (text.rlike(BAJE), baje), (has_word(text, ["subah", "morning"]), 540),
                        (has_word(text, ["afternoon", "dopahar"]), 840), (has_word(text, ["evening", "shaam"]), 1080)])


def appointments(df: DataFrame, keys: Sequence[str], text: str, now: str) -> DataFrame:
    """Appointment fields of each message, what is missing, and the time rolled to the
    next year when it is more than two hours past."""
    low = F.lower(c(text))
    department = first_match([(has_word(low, words), n) for n, words in DEPARTMENTS])
    provider = F.regexp_extract(c(text), r"(?:^|[^0-9A-Za-z_])Dr\.?\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})", 1)
    place = F.regexp_extract(c(text), r"(?:^|[^0-9A-Za-z_])(?:at|in|mein|me)\s+([A-Z][A-Za-z0-9&.\- ]{2,40})", 1)
    place = F.regexp_replace(F.get(F.split(place, r"\s+(?:on|at|mein|me|ko|par)(?:$|[^0-9A-Za-z_])"), 0), r"^[ .,-]+|[ .,-]+$", "")
    rows = df.select(*keys, c(now).alias("__now"), appointment_date(low, c(now)).alias("day"), appointment_minute(low).alias("minute"),
                     department.alias("department"), F.when(provider != "", F.concat(F.lit("Dr. "), provider)).alias("provider"),
                     F.when((place != "") & ~F.lower(place).rlike("^dr[ .]"), place).alias("location"),
                     F.when(has_text(low, ["tele consult", "tele-consult", "video consult", "phone consult"]), "tele_consult").otherwise("doctor").alias("kind"))
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))
    rows = rows.withColumn("__at", at)
    late = F.col("__at") < F.col("__now").cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS")
    return rows.select(*keys, "kind", "department", "provider", "location",
                       F.when(late, F.col("__at") + F.expr("INTERVAL 1 YEAR")).otherwise(F.col("__at")).alias("appointment_at"),
                       F.array_join(F.array_compact(F.array(F.when(F.col("day").isNull(), "date"), F.when(F.col("minute").isNull(), "time"))), ",").alias("missing"))


# --- grounding and filling -----------------------------------------------------------------------------

def number_in_source(value: Column, source: Column) -> Column:
    """The number, in any usual spelling, occurs in the lower-case source."""
    text = F.lower(value.cast("string"))
    n = value.try_cast("double")
    whole = F.when(n == F.floor(n), n.cast("bigint").cast("string"))
    any_of = F.array_compact(F.array(text, n.cast("string"), whole))
    return F.exists(any_of, lambda x: (x != "") & source.contains(x))


def ground(extracted: DataFrame, sources: DataFrame, key: str, text: str, *, name: str, value: str, kind: str) -> DataFrame:
    """Error list and review flag of each extracted row, checked against its own source.

    ``kind`` holds prescription or lab_report. One equality join; both sides hash on the key.
    """
    j = extracted.join(sources.select(key, F.lower(text).alias("__src")), key)
    rx = F.col(kind) == "prescription"
    n = F.col(value).try_cast("double")
    limit = F.lit(False)
    plain = F.replace(F.lower(F.col(name)), F.lit(" "), F.lit("_"))
    for lab, (lo, hi) in PHYSICAL_LIMITS.items():
        limit = limit | ((plain == lab) & ((n < lo) | (n > hi)))
    missing_name = rx & ~F.col("__src").contains(F.lower(F.col(name)))
    errors = F.array_compact(F.array(
        F.when(n.isNull() & F.col(value).isNotNull(), "value:not_numeric"),
        F.when(rx & ((n <= 0) | (n > 10000)), "value:out_of_range"), F.when(~rx & limit, "value:physical_limit"),
        F.when(n.isNotNull() & ~number_in_source(F.col(value), F.col("__src")), "value:not_in_source"),
        F.when(missing_name, "name:not_in_source")))
    return j.withColumn("errors", errors).withColumn("needs_review", F.size("errors") > 0).drop("__src")


def fill_missing(df: DataFrame, name: str, unit: str, frequency: str) -> DataFrame:
    """Unknown names are marked, missing unit and frequency take the usual ones."""
    gone = F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    return df.withColumns({
        "flag": F.when(gone, "missing_drug_name").otherwise(""), name: F.when(gone, "UNKNOWN_DRUG").otherwise(F.col(name)),
        frequency: F.coalesce(F.col(frequency), F.lit("OD")), unit: F.coalesce(F.col(unit), F.lit("mg"))})
