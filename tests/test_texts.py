"""Text operators on invented rows, with plain Python as the yardstick where Spark needs Python."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from vitalloom.functions.text import sequence_ratio, soundex_like
from vitalloom.operators import documents as d
from vitalloom.operators import extraction as x
from vitalloom.operators import filters as f
from vitalloom.operators import routing as r
from vitalloom.operators import similarity as s
from vitalloom.operators import windows as w


def value(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize("text,want", [
    ("Heloo   doctar!!!", "hello doctor"), ("nhi khai", "nahi li"), ("12345", ""), ("soooo  goood", "soo good"), ("ﬁne", "fine"),
    ("chestpain abhi", "chest pain now"), ("dawai nahi li", "medicine nahi li"), ("   ", "")])
def test_normalize(spark, text, want):
    assert value(spark, d.normalize(F.lit(text))) == want


def test_clean_spoken(spark):
    assert value(spark, d.clean_spoken(F.lit("Um the the dose, matlab 10:30"))) == "the dose    10:30"


@pytest.mark.parametrize("text,want", [
    ("Tab. Metformin 500 mg", "prescription"), ("Discharged today, follow up in 2 weeks", "discharge_summary"),
    ("known case of diabetes purana rog allergy", "medical_history"), ("qqq", "unknown")])
def test_document_type(rows, text, want):
    assert d.document_type(rows([(text,)], "t string"), "t").first()["document_type"] == want


def test_vector_type_goes_first_when_sure(rows):
    df = d.document_type(rows([("Tab. x mg", "advice_note", 0.9), ("Tab. x mg dose", "advice_note", 0.5)], "t string, vt string, vs double"), "t", vector_type="vt", vector_score="vs")
    assert [(q["document_type"], q["type_method"]) for q in df.collect()] == [("advice_note", "vector"), ("prescription", "keyword")]


def test_truncation_is_flagged_and_keeps_telling_lines(spark):
    text = "Tab. Med\nWalk\n" * 50
    got = value(spark, d.truncate_keeping(F.lit(text), 30, d.keep_words("prescription")))
    assert got["truncated"] and "Walk" not in got["text"] and len(got["text"]) <= 150
    short = value(spark, d.truncate_keeping(F.lit("walk well\nTab. x"), 30, d.keep_words()))
    assert tuple(short) == ("Tab. x\nwalk well", False)


def test_chunks_cut_at_lines_and_cover_the_text(rows):
    rng = random.Random(4)
    text = "".join(rng.choice("abc .\n") for _ in range(3000))
    got = d.chunks(rows([(1, text), (2, "short"), (3, "")], "i int, t string"), "i", "t", 400, 40).orderBy("i", "chunk_no").collect()
    mine = [q for q in got if q["i"] == 1]
    assert all(text[q["start"]:q["start"] + len(q["chunk"])] == q["chunk"] for q in mine)
    assert mine[0]["start"] == 0 and mine[-1]["start"] + len(mine[-1]["chunk"]) == len(text)
    assert all(b["start"] <= a["start"] + len(a["chunk"]) for a, b in zip(mine, mine[1:]))
    assert [q["chunk"] for q in got if q["i"] == 2] == ["short"]


def test_grounding_flags_absent_numbers(rows):
    ext = rows([(1, "glucose", 9999.0, "lab_report"), (2, "glucose", 100.0, "lab_report"), (3, "zinc", 5.0, "prescription")], "i int, n string, v double, k string")
    src = rows([(1, "glucose 100"), (2, "Glucose 100"), (3, "take 5 mg iron")], "i int, t string")
    got = {q["i"]: (q["errors"], q["needs_review"]) for q in x.ground(ext, src, "i", "t", name="n", value="v", kind="k").collect()}
    assert got[1] == (["value:physical_limit", "value:not_in_source"], True)
    assert got[2] == ([], False)
    assert got[3] == (["name:not_in_source"], True)


def test_vitals_units_and_severity(rows):
    got = {(q["test"], q["value"], q["severity"]) for q in x.vital_signs(rows([(1, "BP 182/95 sugar 12 mmol temp 101 f spo2 88% pulse: 55")], "i int, t string"), ["i"], "t").collect()}
    assert got == {("bp", 182.0, "critical"), ("glucose", 216.0, "advisory"), ("temperature", 38.33, "advisory"), ("spo2", 88.0, "critical"), ("pulse", 55.0, "advisory")}


@pytest.mark.parametrize("value_,older,copd,test,want", [(116, True, False, "pulse", "critical"), (116, False, False, "pulse", "advisory"), (93, False, True, "spo2", "normal"),
                                                         (93, False, False, "spo2", "advisory"), (38.9, True, False, "temperature", "critical")])
def test_vital_thresholds_shift(spark, value_, older, copd, test, want):
    assert value(spark, f.vital_severity(F.lit(test), F.lit(float(value_)), None, F.lit(older), F.lit(copd))) == want


@pytest.mark.parametrize("x_,want", [(1.005, 1.0), (38.795, 38.8), (-1.005, -1.0), (2.5, 2.5), (0.125, 0.13), (None, None)])
def test_doubles_round_as_they_are_stored(spark, x_, want):
    from vitalloom.functions.core import round_double
    assert value(spark, round_double(F.lit(x_).cast("double"), 2)) == want


def test_prescription_rows(rows):
    text = "Rx TAB METFORMIN 500mg BD after food SYRUP ALEX 2/3 teaspoon 3 times a day shake well TAB VITAMIN C one gram once a day Telma-AM to 30 1-0-0"
    got = {q["item"]: (round(q["dose"], 3) if q["dose"] else None, q["unit"], q["frequency"]) for q in x.prescription_items(rows([(1, text)], "i int, t string"), ["i"], "t").collect()}
    assert got["METFORMIN"] == (500.0, "mg", "BD")
    assert got["ALEX"][:2] == (0.667, "teaspoon")
    assert got["VITAMIN C"] == (1.0, "g", "OD")


@pytest.mark.parametrize("text,want", [("Date: 05/03/2024", "2024-03-05"), ("follow up 2024-06-01\nseen 3 Mar 98", "1998-03-03"), ("31/02/2024", None), ("Sept 9, 21", "2021-09-09"),
                                       ("addr 1-1-2020, address\nno", None)])
def test_document_date(spark, text, want):
    got = value(spark, x.document_date(F.lit(None).cast("string"), F.lit(text)))
    assert (got.isoformat() if got else None) == want


def test_schedule_times(spark):
    def go(freq, text):
        return value(spark, x.schedule_times(F.lit(freq), F.lit(text)))
    assert go("BD", "after breakfast") == ["08:30", "20:30"]
    assert go("QID", "") == ["08:30", "12:30", "17:30", "21:30"]
    assert go("", "before lunch") == ["12:30"]
    assert go("HS", "") == ["21:30"] and go("SOS", "") == []


def test_appointment_fields(rows):
    df = rows([(1, "cardiac review 30th may 2026 2:00 PM", "2026-01-05 10:00:00"), (2, "dentist kal 5 baje shaam", "2026-01-05 10:00:00"), (3, "neurologist monday", "2026-01-05 10:00:00")],
              "i int, t string, n string").withColumn("now", F.col("n").cast("timestamp_ntz"))
    got = {q["i"]: (q["department"], str(q["appointment_at"]), q["missing"]) for q in x.appointments(df, ["i"], "t", "now").collect()}
    assert got[1] == ("cardiology", "2026-05-30 14:00:00", "")
    assert got[2] == ("dentistry", "2026-01-06 17:00:00", "")
    assert got[3] == ("neurology", "None", "time")


def test_lookahead_stops_at_the_next_name(rows):
    text = "Glucose\n90\nmg/dL\n70 - 110\nSodium\nPotassium\n4.1\nH"
    got = {q["test_name"]: (q["value"], q["unit"], q["flag"], q["low"], q["high"]) for q in w.line_lookahead(
        rows([(1, text)], "i int, t string"), "i", w.lines_of("t"), lambda q: F.when(F.lower(q).isin("glucose", "sodium", "potassium"), F.lower(q))).collect()}
    assert got == {"glucose": (90.0, "mg/dL", None, 70.0, 110.0), "potassium": (4.1, None, "H", None, None)}


# --- routing -------------------------------------------------------------------------------------

@pytest.mark.parametrize("text,want", [
    ("chest pain", True), ("ambulance", True), ("he died", True), ("phone died", False), ("no chest pain", False), ("headache", False), ("saans abhi atak gayi hai", True),
    ("begun the insaan work", False), ("gun", True)])
def test_emergency(spark, text, want):
    assert value(spark, r.emergency(r.routing_text(F.lit(text))))["is_emergency"] is want


@pytest.mark.parametrize("text,context,want", [
    ("hello", "", "greeting"), ("approve", "veto_window", "approve_command"), ("approve", "", "approval_context_missing"), ("veto", "veto_window", "veto_command"),
    ("haan", "medication_confirmation", "medication_taken_confirm"), ("nahi", "medication_confirmation", "medication_missed_confirm"),
    ("book cardiology appointment 30th may 2:00 pm", "", "appointment_add"), ("doctor kab aayenge appointment", "", "appointment_query"), ("BP 150/90", "", "vital_report"),
    ("hba1c 7.2", "", "lab_report"), ("evening walk", "", "exercise_report"), ("xyz", "", "unknown"), ("chest pain", "", "crisis")])
def test_routing(rows, text, context, want):
    got = r.classify(rows([(text, context)], "t string, c string"), "t", context="c").first()
    assert got["intent"] == want and 0 <= got["intent_confidence"] <= 1


def test_time_phrases_are_read_before_normalising(rows):
    df = rows([("kal subah", "2024-03-10 10:00:00")], "t string, n string").withColumn("now", F.col("n").cast("timestamp_ntz"))
    got = df.select(r.temporal_query("t", "now").alias("e")).first()["e"]
    assert (got["bucket"], str(got["target_date"])) == ("morning", "2024-03-11")


def test_include_exclude_keeps_other_kinds_out(rows):
    df = rows([("physio therapy",), ("lab cbc",), ("mri scan",), ("labour ward",)], "t string")
    assert [q[0] for q in df.where(f.include_exclude(["t"], ["lab", "cbc"], ["mri"])).collect()] == ["lab cbc"]


def test_doctor_rows_are_not_tests(rows):
    got = [q[0] for q in rows([("doctor visit",), ("ct scan",)], "t string").select(f.category(["t"], ["lab", "test", "scan", "ct"], "test", "doctor")).collect()]
    assert got == ["doctor", "test"]


def test_specialty_needs_whole_words(spark):
    assert value(spark, d.specialty(F.lit("patient resting"))) == ""
    assert value(spark, d.specialty(F.lit("seen by ENT"))) == "ent specialist"


# --- near matches ----------------------------------------------------------------------------------

def plain_soundex(text):
    codes = {**dict.fromkeys("bfpv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}
    letters = re.sub("[^a-z]", "", text.lower())
    out, prev = "", codes.get(letters[:1], "")
    for ch in letters[1:]:
        code = codes.get(ch, "")
        out += code if code and code != prev else ""
        prev = code
    return (letters[:1].upper() + out + "000")[:4] if letters else ""


def test_sound_codes(rows):
    words = ["metformin", "ashcraft", "pfister", "aspirin", "tymczak", "", "bob", "hhw", "Ramipril"]
    got = [q[0] for q in rows([(q,) for q in words], "t string").select(soundex_like("t")).collect()]
    assert got == [plain_soundex(q) for q in words]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x_ in enumerate(a, 1):
        prev, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            prev, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, prev + (x_ != y))
    return row[-1]


@pytest.mark.parametrize("cutoff,exact", [(0.8, False), (0.7, False), (0.75, True), (0.88, True)])
def test_edit_candidates_miss_no_pair(rows, cutoff, exact):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(25)]
    names = []
    for q in vocab * 3:
        q = list(q)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(q) + 1)
            rng.choice([lambda: q.insert(p, rng.choice("abcd")), lambda: q and q.pop(p - 1), lambda: q.__setitem__(p - 1, "d")])()
        names.append("".join(q))
    bound = s.edits_sequence(cutoff) if exact else s.edits_levenshtein(cutoff)
    got = {tuple(q) for q in s.edit_candidates(rows([(q,) for q in names], "a string"), rows([(q,) for q in vocab], "b string"), "a", "b", bound).collect()}
    def near(a, b):
        if exact:
            return difflib.SequenceMatcher(None, a, b).ratio() >= cutoff
        return 1 - edits(a, b) / max(len(a), len(b)) >= cutoff
    want = {(a, b) for a in names for b in vocab if a and near(a, b)}
    assert want and want <= got


def test_exact_ratio_is_the_matching_blocks_ratio(rows):
    pairs = [("metfromin", "metformin"), ("abc", "xyz"), ("amlodipin", "amlodipine")]
    got = [q[0] for q in rows(pairs, "a string, b string").select(sequence_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_token_repair_equals_close_matches(rows):
    texts = ["ambulence please now", "medicin khatam", "emergancy", "fine day"]
    got = [q["repaired"] for q in s.repair_tokens(rows(list(enumerate(texts)), "i int, t string"), ["i"], "t").orderBy("i").collect()]
    def fix(t):
        return difflib.get_close_matches(t, r.REPAIR_TERMS, n=1, cutoff=0.88)[0] if len(t) >= 5 and difflib.get_close_matches(t, r.REPAIR_TERMS, n=1, cutoff=0.88) else t
    assert got == [" ".join(fix(q) for q in t.split()) for t in texts]


def test_compact_typos(rows):
    texts = ["chestoain", "chess pawn", "i have heart atack", "heartatack now", "all fine"]
    got = [q["typo"] for q in s.compact_typos(rows(list(enumerate(texts)), "i int, t string"), ["i"], "t", ["chest pain", "heart attack"]).orderBy("i").collect()]
    def plain(t):
        parts = [q for q in t.split() if len(q) >= 5] + ["".join(t.split())]
        return any(abs(len(c) - len(p)) <= 3 and difflib.SequenceMatcher(None, c, p).ratio() >= 0.86 for c in parts for p in ("chestpain", "heartattack"))
    assert got == [plain(t) for t in texts]


def test_fuzzy_names_by_tier(rows):
    raw = rows([("metformine",), ("tab aspirin 75",), ("glucophage xr",), ("ramipryl",), ("zzz",)], "n string")
    known = rows([("Metformin",), ("Aspirin",), ("Ramipril",)], "w string")
    got = {q["n"]: (q["matched"], q["tier"]) for q in s.fuzzy_names(raw, known, "n", "w", aliases={"glucophage": "metformin"}).collect()}
    assert got == {"metformine": ("metformin", 4), "tab aspirin 75": ("aspirin", 4), "glucophage xr": ("metformin", 3), "ramipryl": ("ramipril", 2), "zzz": (None, None)}


def test_known_side_effect(spark):
    got = value(spark, s.side_effect_hint(F.lit("amlodipine"), F.lit("feeling dizzy"), F.lit("")))
    assert tuple(got) == ("amlodipine", "dizziness", 0.95)


def test_report_lab_names_and_item_cuts(rows):
    labs = rows([(1, "Platelet Count 250000 /cumm\nSodium 140\nTotal Cholesterol 210 mg/dL\nSGOT 33\nGlucose 99\nTotal Cholesterol / HDL Ratio 4.1")], "k int, t string")
    got = {(r.test_name, r.value) for r in x.lab_rows(labs, ["k"], "t").collect()}
    assert got == {("platelets", 250000.0), ("sodium", 140.0), ("cholesterol", 210.0), ("sgot_ast", 33.0), ("glucose", 99.0), ("cholesterol_hdl_ratio", 4.1)}
    items = rows([(1, "TAB CALPOL Dr. Asha Mehta MBBS 500 mg BD"), (2, "SYRUP ALEX in case of fever BD")], "k int, t string")
    got = {r.k: (r.item, r.dose) for r in x.prescription_items(items, ["k"], "t").collect()}
    assert got == {1: ("CALPOL", None), 2: ("ALEX", None)}


def test_misspelt_and_restored_routes(rows):
    said = ["unconscius abhi", "mann nahi lag raha", "tension ho rahi hai", "wo chal nahi pa rahe", "dizzy hai aur pain abhi", "emergancy", "plain words only"]
    got = [(x_["intent"], x_["emergency_reason"]) for x_ in r.classify(rows([(k, t) for k, t in enumerate(said)], "k int, t string"), "t").orderBy("k").collect()]
    assert got[0] == ("crisis", "crisis_present") and got[5] == ("crisis", "explicit_emergency")
    assert [g[0] for g in got[1:4]] == ["emotional_checkin", "emotional_checkin", "caregiver_observation"]
    assert got[4][0] != "symptom_report" and got[6][0] == "unknown"
