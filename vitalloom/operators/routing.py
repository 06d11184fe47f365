"""Message routing: time phrases, query windows, emergency screen, ordered rules, clauses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, first_match, has_text, has_word, substring_pattern, word_pattern
from ..functions.text import let, literal_map, nfkc, one_space, ratio_of, replace_phrases, squeeze_runs, token_map
from .documents import clean_spoken
from .filters import hour_bucket
from .windows import negation_near

# --- fixed values -------------------------------------------------------------------------------
ROUTING_TOKENS = {
    "nhi": "nahi", "nai": "nahi", "nahin": "nahi", "sey": "se", "seyy": "se", "pe": "par", "mein": "me", "main": "mai", "kudh": "kood", "kud": "kood", "koodh": "kood",
    "khud": "kood", "li": "liya", "liye": "liya", "meds": "medications", "medicines": "medicine", "med": "medicine",
    "dawai": "medicine", "dava": "medicine", "dawa": "medicine", "tab": "tablet", "tabs": "tablets", "pills": "tablets",
    "attak": "attack", "atak": "attack", "emergncy": "emergency", "emerjency": "emergency", "ambulanse": "ambulance",
    "ambulans": "ambulance", "collaps": "collapse", "behos": "behosh", "rap": "rape", "raped": "rape",
    "killed": "kill", "marna": "maar", "mara": "maar", "maara": "maar",
}
ROUTING_PHRASES = {
    "some one": "someone", "heartattacke": "heart attack", "heartattack": "heart attack", "heart attak": "heart attack",
    "hert attack": "heart attack", "hart attack": "heart attack", "chestoain": "chest pain", "chestpain": "chest pain",
    "chest painn": "chest pain", "chest dard": "chest pain", "seene mein dard": "seene me dard",
    "sine me dard": "seene me dard", "sans nahi": "saans nahi", "saanse nahi": "saans nahi",
    "saansein atak gayi": "saans atak gayi", "livr failure": "liver failure", "liver fail": "liver failure",
    "kidny failure": "kidney failure", "kidney fail": "kidney failure", "no medication": "no medications",
    "no medicine": "no medications", "no medicines": "no medications", "nahi li": "nahi liya", "nhi li": "nahi liya",
    "appoinment": "appointment", "appointmnt": "appointment", "followup": "follow up",
    "present tablet": "present tablets", "build par se kood": "bridge par se kood", "i dont want my life": "i do not want my life",
    "i don t want my life": "i do not want my life",
}
REPAIR_TERMS = ("ambulance", "emergency", "appointment", "medication", "medicine", "tablets", "skipped", "missed", "taken",
                "approve", "reject", "veto", "collapse", "unconscious")
NOW_WORDS = ("now", "abhi", "right now", "iss waqt", "just now", "currently", "turant")
NUMBER_WORDS = {"ek": 1, "do": 2, "teen": 3, "chaar": 4, "char": 4, "paanch": 5, "panch": 5, "che": 6, "chhe": 6, "saat": 7,
                "aath": 8, "nau": 9, "das": 10}
BUCKET_WORDS = (
    ("morning", ("subah", "savere", "breakfast", "nashta")), ("afternoon", ("dopahar", "lunch", "2 baje", "do baje")),
    ("evening", ("shaam", "6 baje", "7 baje", "chey baje")), ("night", ("raat", "sone se pehle", "bedtime", "10 baje")))
HISTORY_WORDS = ("miss hua", "missed", "completed", "past", "previous", "last appointment", "ho gaya")
PRESENT_WORDS = ("abhi", "right now", "ho raha hai", "ho rha hai", "ho rahe hai", "ho rahi hai", "just now", "currently", "aaj",
                 "iss waqt", "is waqt", "this moment", "abhi abhi")
PAST_WORDS = ("tha", "thi", "the", "had", "was", "were", "kal", "parso", "last week", "last month", "yesterday", "pehle",
              "hua tha", "ho gaya tha")
EXPLICIT_HELP = ("ambulance", "help me", "bachao", "emergency", "call 112", "call ambulance", "urgent help", "jaldi help")
NEGATIONS = ("nahi", "not", "no", "without")
BENIGN_PAIN = ("knee pain", "headache", "sir dard", "pair dard", "back pain", "shoulder pain", "tooth pain")
CRITICAL_WORDS = (
    "chest pain", "heart attack", "stroke", "brain stroke", "paralysis", "liver failure", "kidney failure", "organ failure",
    "unconscious", "collapse", "collapsed", "behosh", "not breathing", "cannot breathe", "breathing problem",
    "severe breathing problem", "saans nahi", "saans atak gayi", "dam ghut raha", "saans", "sans", "saan", "seene mein dard",
    "seene me dard", "seizure", "fit aa raha", "bleeding heavily", "heavy bleeding", "blood loss")
DEATH_WORDS = ("died", "dead", "death", "passed away", "mar gaya", "maar gaya", "marr gaya", "gujar gaya", "death ho gaya")
THINGS_THAT_DIE = ("phone died", "battery died", "laptop died", "app died")
SELF_HARM_WORDS = ("kill myself", "suicide", "self harm", "marna chahta", "marna chahti", "jaan dena", "zehar", "poison",
                   "i do not want my life", "bridge par se kood", "building par se kood", "chhat se kood", "train ke samne")
VIOLENCE_WORDS = ("someone came to kill me", "someone kill me", "kill me", "kill my", "maar denge", "maar diya", "attack kar diya",
                  "assault", "beaten", "pitai", "gun", "knife", "chaku", "threat", "danger")
ASSAULT_WORDS = ("rape", "sexual assault", "molest", "molested", "raped my", "rape kiya")
SHORT_CRITICAL = ("heart attack", "stroke", "liver failure", "kidney failure", "organ failure", "unconscious", "collapse",
                  "collapsed", "behosh", "not breathing", "cannot breathe", "chest pain")
MILD = ("mild", "slight", "little", "minor", "halka", "thoda", "thodi")
MODERATE = ("fever", "bukhar", "vomiting", "ulti", "dizzy", "dizziness", "chakkar", "weak", "kamzori", "swelling", "sojan",
            "not slept", "neend nahi", "nahi khaya", "skipped food", "anxious", "confused", "pareshan")
SEVERE = ("severe", "unbearable", "very bad", "bahut", "bohot", "zyada", "zyaada", "intense", "worst", "tez", "jyada")
ACUTE = ("now", "right now", "abhi", "currently", "suddenly", "just now", "ho raha", "ho rha", "iss waqt", "this moment", "aaj")
CHRONIC = ("for days", "many days", "since yesterday", "since last week", "last week", "last month", "kal se", "hafta", "weeks",
           "months", "chronic", "roz", "bar bar", "baar baar", "again and again")
CRITICAL_SYMPTOMS = ("chest pain", "seene mein dard", "heart pain", "breathing problem", "cannot breathe", "saans", "breathing",
                     "collapse", "collapsed", "unconscious", "behosh", "severe pain", "bleeding", "stroke", "paralysis")
# ---------------------------------------------------------------------------------------------------


def routing_text(text: str | Column, *, compatibility: bool = False) -> Column:
    """Message in routing form: letters, digits and + % / : only, runs squeezed, phrases and tokens mapped."""
    raw = nfkc(c(text)) if compatibility else c(text)
    t = one_space(squeeze_runs(F.regexp_replace(F.lower(raw), r"[^a-z0-9+%/:\s]", " ")))
    return replace_phrases(token_map(replace_phrases(t, ROUTING_PHRASES), ROUTING_TOKENS, unknown=close_term), ROUTING_PHRASES)


def close_term(token: Column, terms: Sequence[str] = REPAIR_TERMS, cutoff: float = 0.88, min_length: int = 5) -> Column:
    """The term that a token of five letters or more misspells, null if none is close enough."""
    rated = F.transform(_by_length(terms, cutoff, token), lambda k: F.struct(_near_ratio(token, k, terms, cutoff).alias("r"), k.alias("t")))
    best = F.array_max(F.filter(rated, lambda x: x["r"] >= cutoff))
    return F.when(F.length(token) >= min_length, best["t"])


def _by_length(phrases: Sequence[str], cutoff: float, text: Column) -> Column:
    """The phrases whose length alone lets ``text`` reach the ratio ``cutoff``: one look-up by the length of ``text``."""
    def reach(n: int, p: str) -> bool:
        return abs(n - len(p)) <= (1 - cutoff) * (n + len(p)) + 1e-9
    longest = int(max(map(len, phrases)) * (2 - cutoff) / cutoff) + 1
    rows = [[p for p in phrases if reach(n, p)] for n in range(longest + 1)]
    return F.get(F.array(*[F.array(*map(F.lit, row)).cast("array<string>") for row in rows]), F.length(text))


def _near_ratio(text: Column, phrase: Column, phrases: Sequence[str], cutoff: float) -> Column:
    """:func:`edit_ratio`, null where the distance is beyond any that reaches ``cutoff`` with one of the ``phrases``."""
    # distance <= cost <= (1 - cutoff) * (sum of lengths), and the longer is at most (2 - cutoff) / cutoff times the shorter
    bound = int(2 * (1 - cutoff) / cutoff * max(map(len, phrases)) + 1e-9)
    distance = F.levenshtein(text, phrase, bound)
    return F.when(distance >= 0, ratio_of(distance, text, phrase))


# --- time phrases ------------------------------------------------------------------------------------

HOUR_OFFSET = r"(?:^|[^a-z0-9_])(\d+|" + "|".join(NUMBER_WORDS) + r")\s*(?:ghante|hours?)\s*(?:baad|later)"


def temporal_query(text: str | Column, now: str | Column) -> Column:
    """Struct (bucket, is_now, confidence, target_date) of a time phrase said at ``now``."""
    at = c(now)
    today = F.to_date(at)
    def row(bucket, is_now, conf, day):
        return F.struct(bucket.alias("bucket"), F.lit(is_now).alias("is_now"), F.lit(conf).alias("confidence"), day.alias("target_date"))
    def parse(t: Column) -> Column:
        word = F.regexp_extract(t, HOUR_OFFSET, 1)
        hours = F.coalesce(F.try_element_at(literal_map(NUMBER_WORDS), word), F.nullif(word, F.lit("")).try_cast("int"))
        later = at + F.make_dt_interval(F.lit(0), hours)
        day = first_match([(has_word(t, ["yesterday"]), F.date_sub(today, 1)), (has_word(t, ["parso"]), F.date_add(today, 2)),
                           (has_word(t, ["kal", "tomorrow"]), F.date_add(today, 1))], today)
        named = first_match([(has_word(t, words), b) for b, words in BUCKET_WORDS])
        return first_match([
            (t == "", row(F.lit("today"), False, 0.5, today)),
            (has_word(t, NOW_WORDS), row(hour_bucket(F.hour(at)), True, 0.95, today)),
            (hours.isNotNull(), row(hour_bucket(F.hour(later)), False, 0.85, F.to_date(later))),
            (named.isNotNull(), row(named, False, 0.85, day))], row(hour_bucket(F.hour(at)), False, 0.6, day))
    return let(clean_spoken(text), parse)


def query_window(text: str | Column, now: str | Column) -> Column:
    """Struct (start, end, history) of an appointment question asked at ``now``."""
    at = c(now).cast("timestamp_ntz")
    def window(start, end, history=False):
        return F.struct(start.alias("start"), end.alias("end"), F.lit(history).alias("history"))
    def parse(t: Column) -> Column:
        n = F.nullif(F.regexp_extract(t, r"(?:next|in|agle|andar)\s+(\d{1,2})\s+days?", 1), F.lit("")).try_cast("int")
        day = F.date_trunc("day", at).cast("timestamp_ntz")
        return first_match([
            (n.isNotNull(), window(at, at + F.make_dt_interval(n))),
            (has_word(t, ["today", "aaj"]), window(day, day + F.expr("INTERVAL 1 DAY"))),
            (has_word(t, ["week"]), window(at, at + F.expr("INTERVAL 7 DAYS"))),
            (has_word(t, ["month"]), window(at, at + F.expr("INTERVAL 31 DAYS"))),
            (has_word(t, HISTORY_WORDS), window(at - F.expr("INTERVAL 90 DAYS"), at, True))],
            window(at, at + F.expr("INTERVAL 14 DAYS")))
    return let(F.lower(c(text)), parse)


def temporal_bias(intent: Column, confidence: Column, text: str | Column, minutes_to_dose: Column) -> Column:
    """Struct (intent, confidence) after the distance to the nearest scheduled dose."""
    now = has_word(F.lower(c(text)), ["abhi", "now", "iss waqt", "right now", "current"])
    near, far = minutes_to_dose <= 30, minutes_to_dose > 120
    def row(i, conf):
        return F.struct(i.alias("intent"), F.least(conf, F.lit(1.0)).alias("confidence"))
    return first_match([
        (near & (intent == "medication_due_now"), row(intent, confidence + 0.15)),
        (near & (intent == "medication_report") & now, row(F.lit("medication_due_now"), confidence + 0.10)),
        (far & (intent == "medication_due_now"), row(F.lit("medication_list"), confidence))], row(intent, confidence))


# --- emergency screen ---------------------------------------------------------------------------------

# Shapes of command words.
APPROVE_SHAPE = r"^(?:approve|approve this|yes approve|confirm|theek hai|proceed)$|^approve |^yes approve"
REJECT_SHAPE = r"^(?:deny|reject|veto|veto this|cancel this|nahi chahiye|nai chahiye)$|^veto |^reject "


def near_phrase(text: Column, phrases: Sequence[str], cutoff: float = 0.88) -> Column:
    """True when as many words in a row as a phrase has come close to it."""
    def of_size(tokens: Column, size: int) -> Column:
        known = [p for p in phrases if len(p.split()) == size]
        runs = F.when(F.size(tokens) >= size, F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), lambda i: F.array_join(F.slice(tokens, i, size), " ")))
        near = F.exists(runs if size > 1 else tokens, lambda x: F.coalesce(F.exists(_by_length(known, cutoff, x), lambda k: _near_ratio(x, k, known, cutoff) >= cutoff), F.lit(False)))
        return F.coalesce(near, F.lit(False))

    sizes = sorted({len(p.split()) for p in phrases})
    return let(F.split(text, " "), lambda tokens: reduce(or_, [of_size(tokens, n) for n in sizes]))


def emergency(routed: Column) -> Column:
    """Struct (is_emergency, reason) of routing text, first rule wins. The struct is
    meant to be bound once with ``let`` or a column."""
    def row(flag, reason):
        return F.struct(F.lit(flag).alias("is_emergency"), F.lit(reason).alias("reason"))
    present, past = has_word(routed, PRESENT_WORDS), has_word(routed, PAST_WORDS)
    critical = has_word(routed, CRITICAL_WORDS) | F.when(present | past, near_phrase(routed, CRITICAL_WORDS)).otherwise(False)
    jump = has_word(routed, ["kood"]) & has_word(routed, ["bridge", "building", "chhat", "roof"])
    return first_match([
        (routed.rlike(APPROVE_SHAPE) | routed.rlike(REJECT_SHAPE), row(False, "command_word")),
        (has_word(routed, THINGS_THAT_DIE), row(False, "no_crisis_detected")),
        (has_word(routed, EXPLICIT_HELP), row(True, "explicit_emergency")),
        (negation_near(routed, CRITICAL_WORDS, NEGATIONS), row(False, "negated")),
        (has_word(routed, BENIGN_PAIN), row(False, "pain_non_emergency")),
        (has_word(routed, DEATH_WORDS), row(True, "death_report")),
        (has_word(routed, ASSAULT_WORDS), row(True, "sexual_assault")),
        (has_word(routed, VIOLENCE_WORDS), row(True, "violence_threat")),
        (has_word(routed, SELF_HARM_WORDS) | jump, row(True, "self_harm_risk")),
        (critical & present, row(True, "crisis_present")),
        (critical & past, row(False, "crisis_historical")),
        (has_word(routed, SHORT_CRITICAL), row(True, "medical_emergency")),
    ], row(False, "no_crisis_detected"))


# --- ordered rules ----------------------------------------------------------------------------------------

class Rule(NamedTuple):
    """One routing rule: all given parts must hold. Terms match whole words unless ``mode`` is substring."""

    intent: str
    any: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    regex: str = ""
    context: tuple[str, ...] = ()
    media: str = ""
    max_words: int = 0
    mode: str = "word"
    not_both: tuple = ()

    def patterns(self) -> list[tuple[str, bool]]:
        make = word_pattern if self.mode == "word" else substring_pattern
        out = [(make(self.any), True)] if self.any else []
        out += [(make(self.also), True)] if self.also else []
        out += [(make(self.none), False)] if self.none else []
        return out + ([(self.regex, True)] if self.regex else [])

    def column(self, text: Column, context: Column | None, media: Column | None) -> Column:
        cond = F.lit(True)
        if self.context:
            cond = cond & (context.isin(*self.context) if context is not None else F.lit(False))
        if self.media:
            cond = cond & (media.rlike(self.media) if media is not None else F.lit(False))
        for pattern, want in self.patterns():
            hit = text.rlike(pattern)
            cond = cond & (hit if want else ~hit)
        if self.not_both:
            cond = cond & ~(has_word(text, self.not_both[0]) & has_word(text, self.not_both[1]))
        if self.max_words:
            cond = cond & (F.size(F.split(text, " ")) <= self.max_words)
        return F.coalesce(cond, F.lit(False))


# Answers, contexts and dates.
YES = ("yes", "haan", "ha", "li", "le li", "kha liya", "taken", "took it", "done", "ho gaya", "liya")
NO = ("no", "nahi", "nai", "nhi", "missed", "bhool gaya", "skip", "skipped", "nahi liya", "not taken")
MED_CONTEXT = ("medication_confirmation", "medication_prompt", "scheduled_medication")
DATE_WORDS = ("kal", "parso", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "somwar", "mangalwar",
              "budhwar", "guruvar", "shukrawar", "shanivar", "ravivar", "tarikh", "aaj", "tomorrow", "today", "jan", "january",
              "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep",
              "sept", "september", "oct", "october", "nov", "november", "dec", "december")
DATE_OR_TIME = word_pattern(DATE_WORDS) + r"|(?:^|[^0-9a-z])\d{1,2}(?::\d{2})?\s*(?:am|pm|baje)?(?:$|[^0-9a-z])"
VITALS = (r"\d{2,3}/\d{2,3}|(?:sugar|glucose|rbs|fbs)\s*[:=-]?\s*\d{2,3}|\d{2,3}\s*mg/dl|\d{2,3}\s*bpm|(?:spo2|oxygen)\s*[:=-]?\s*\d{2,3}|"
          r"(?:temperature|temp|bukhar|fever)(?:$|[^a-z0-9]).*\d{2,3}|(?:bp|pulse|sugar|oxygen)(?:$|[^a-z0-9]).*\d")
QUESTION = r"^(?:what|which|when|how|kab|kaunsi|kya) "
LAB_PANEL = ("lab report", "blood test", "hba1c", "cholesterol", "creatinine", "lft", "kft", "cbc", "tsh")
NEW_RX = ("prescribed", "doctor ne diya", "naya tablet", "nai medicine", "dosage changed", "dose badh gaya", "started on",
          "band kar di", "discontinued", "medicine changed")
# Ordered routing rules (fixed values); emergencies and command words are decided before them.
ROUTES = (
    Rule("photo_upload", media="^image/"), Rule("audio_note", media="^audio/"), Rule("pdf_upload", media="^application/pdf$"),
    Rule("location_update", any=("maps google", "geo:"), mode="substring"),
    Rule("abusive_language", any=("fuck", "fucking", "shit", "bullshit", "asshole", "bitch", "bastard", "shut up", "idiot", "stupid",
                                  "madarchod", "bhenchod", "behenchod", "chutiya", "chutiye", "gandu", "harami", "kamina", "kamine")),
    Rule("appointment_add", context=("appointment_draft",), regex=DATE_OR_TIME),
    Rule("appointment_confirmed", context=("appointment_confirm",), any=YES),
    Rule("appointment_declined", context=("appointment_confirm",), any=NO),
    Rule("medication_taken_incorrect", context=MED_CONTEXT, any=YES, none=NO,
         also=("before food", "pehle", "galti se", "wrong time", "alag waqt", "subah", "raat ko", "late", "early")),
    Rule("medication_taken_confirm", context=MED_CONTEXT, any=YES, none=NO),
    Rule("medication_missed_confirm", context=MED_CONTEXT, any=NO),
    Rule("caregiver_observation", any=("uncle had", "patient had", "dad had", "he had", "she had", "uncle ko", "patient ko", "dad ko",
                                       "uncle ne", "patient ne", "dad ne", "wo theek nahi lag rahe", "wo kamzor lag rahe",
                                       "wo confused hain", "wo zyada soye", "wo chal nahi pa rahe"),
         also=("dizziness", "fever", "weak", "confused", "fall", "gir", "soye", "sleep", "khana", "eat", "dawai", "medicine", "chakkar",
               "bukhar", "kamzori", "behosh", "walk", "chal")),
    Rule("medication_report", any=("no medications", "missed all", "skipped all", "nahi liya", "medications skipped", "medicine liya",
                                   "medications liya", "tablet liya", "tablets liya", "took medicine", "took medications",
                                   "taken medicine", "taken medications", "missed medicine", "skipped medicine")),
    Rule("medication_report", regex="^(?:yes|haan|ha|liya|le liya|kha liya|taken|took it|done|ho gaya|no|nahi|nai|nhi|missed|bhool gaya|skip|skipped|took)$"),
    Rule("clarification_response", context=("clarification_question",)),
    Rule("refill_confirmed", context=("refill_confirm",), any=YES), Rule("refill_declined", context=("refill_confirm",), any=NO),
    Rule("vital_report", regex=VITALS, none=LAB_PANEL),
    Rule("lab_report", any=(*LAB_PANEL, "report aaya", "results"), regex=r"\d"),
    Rule("new_prescription", any=NEW_RX),
    Rule("discharge_summary", any=("discharge", "hospital se aaye", "discharged", "admitted", "admit hua", "released from hospital", "discharge summary")),
    Rule("appointment_add", any=("appointment", "checkup", "follow up", "visit", "tele consult"), regex=DATE_OR_TIME,
         also=("create", "add", "book", "schedule", "fix", "karna", "karo", "bulaya", "on", "ko", "cardiology", "cardiologist",
               "nephrologist", "endocrinologist", "neurologist", "psychiatrist", "dentist", "doctor", "dr"),
         none=("when", "kab", "show", "list", "any", "what", "does", "is there", "hai kya", "bhejo")),
    Rule("appointment_query", any=("appointment", "appointments", "next visit", "doctor kab", "schedule", "kab jaana hai", "doctor visit",
                                   "follow up", "checkup", "doctor ke paas", "doctor visits")),
    Rule("medication_query", any=("kab lena hai", "kitni dose", "dose kya hai", "kab tak lena hai", "kitne din", "instructions", "how to take",
                                  "before or after food", "what should i take now", "what medicine now", "present tablets",
                                  "medicine due now", "tablets to be taken", "take now", "due now")),
    Rule("refill_request", any=("medicine khatam", "stock low", "refill", "khatam hone wali hai", "order karna hai", "pharmacy", "chemist")),
    Rule("status_query", any=("medications", "medication", "medicine", "kya le raha", "list", "tablet list", "currently on")),
    Rule("doctor_visit_update", any=("doctor se mile", "doctor visit hua", "clinic gaye", "hospital gaye", "appointment hua", "doctor bole",
                                     "doctor ne kaha", "checkup hua", "cardiologist se mile"), none=NEW_RX),
    Rule("symptom_report", any=("dard", "dardh", "dardd", "pain", "headache", "head ache", "sir dard", "sar dard", "body ache", "dizzy", "chakkar",
                                "chakar", "nausea", "ulti", "vomiting", "swelling", "sojan", "weak", "kamzori", "thakaan", "tired",
                                "breathless", "saans", "saan", "sans", "saas", "constipation", "diarrhea", "loose motion", "rash",
                                "khujli", "fever", "bukhar", "chest pain", "seene mein dard", "seene me dard"),
         not_both=(("dard", "dardh", "dardd", "pain", "chest pain", "seene mein dard", "seene me dard", "saans", "saan", "sans", "saas",
                    "breathless"), PRESENT_WORDS)),
    Rule("diet_report", any=("khana khaya", "breakfast", "lunch", "dinner", "kha liya", "nahi khaya", "diet", "bhookha", "fasting",
                             "fast kar raha", "khana skip kiya")),
    Rule("sleep_report", any=("neend", "soya", "sleeping", "neend nahi aayi", "raat ko jaaga", "uthh gaye", "insomnia", "raat bhar")),
    Rule("emotional_checkin", any=("feeling tensed", "feeling anxious", "heart break", "i am worried", "feeling low today",
                                   "not feeling good mentally", "feeling stressed", "i am upset", "feeling lonely", "i miss her",
                                   "i miss him", "feeling empty", "not in a good mood", "feeling down", "mai udas hoon",
                                   "tension ho rahi hai", "dil toot gaya", "pareshan hoon", "mann nahi lag raha",
                                   "akela feel kar raha hoon", "bechaini ho rahi hai", "mood off hai", "depressed feel kar raha hoon",
                                   "stress mein hoon", "stress me hoon")),
    Rule("mood_report", any=("mood", "khush", "upset", "sad", "roya", "dara hua", "anxious", "confused", "irritated", "gussa", "depressed",
                             "pareshan", "ghabra raha")),
    Rule("exercise_report", any=("walk", "exercise", "chala", "gaya bahar", "workout", "stairs", "chalte hain", "physical activity")),
    Rule("caregiver_schedule_update", any=("nahi aa paunga", "nahi aa paungi", "chutti", "leave", "absent", "late aaunga", "replace", "backup",
                                           "koi aur aayega", "available nahi")),
    Rule("family_member_query", any=("how is dad", "kaisa hai", "kya hua", "update do", "sab theek", "dad kaise hain", "patient kaisa hai", "health update",
                                     "any change"), max_words=8),
    Rule("caregiver_update", any=("gaye", "aaye", "kiya", "hua", "bataya"),
         none=("khana", "breakfast", "lunch", "dinner", "diet", "neend", "sleep", "mood", "walk", "exercise", "medicine", "appointment",
               "doctor", "hospital")),
    Rule("greeting", regex="^(?:hi|hello|namaste|help|what can you do|help chahiye|who are you|who r u|who are u|what are you)$"),
)
CONFIDENCE = {
    "crisis": 1.0, "approve_command": 0.95, "veto_command": 0.95, "approval_context_missing": 0.9, "approval_context_expired": 0.9,
    "medication_taken_incorrect": 0.93, "medication_taken_confirm": 0.93, "medication_missed_confirm": 0.93, "medication_report": 0.86,
    "caregiver_observation": 0.88, "medication_query": 0.86, "status_query": 0.86, "emotional_checkin": 0.78, "greeting": 0.9,
    "appointment_query": 0.84, "appointment_add": 0.84, "photo_upload": 0.95, "audio_note": 0.95, "pdf_upload": 0.95,
    "location_update": 0.95, "vital_report": 0.92, "lab_report": 0.92, "abusive_language": 0.9, "unknown": 0.35,
}
APPROVAL_CONTEXT = ("veto_window", "interaction_alert", "new_med", "approval_window", "pending_approval")


def route(routed: Column, *, context: Column | None = None, media: Column | None = None, active: Column | None = None,
          rules: Sequence[Rule] = ROUTES, screen: Column | None = None) -> Column:
    """Intent of routing text: emergency, then command words, then the ordered rules. ``screen`` is a bound :func:`emergency`."""
    screen = emergency(routed) if screen is None else screen
    in_window = context.isin(*APPROVAL_CONTEXT) if context is not None else F.lit(False)
    live = in_window & (F.coalesce(active, F.lit(True)) if active is not None else F.lit(True))
    def command(intent):
        return F.when(live, intent).when(in_window, "approval_context_expired").otherwise("approval_context_missing")
    media_rules = [(r.column(routed, context, media), r.intent) for r in rules if r.media]
    rest = [(r.column(routed, context, media), r.intent) for r in rules if not r.media]
    return first_match([*media_rules, (screen["is_emergency"], "crisis"),
                        (routed.rlike(APPROVE_SHAPE), command("approve_command")), (routed.rlike(REJECT_SHAPE), command("veto_command")),
                        *rest], "unknown")


def route_confidence(intent: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CONFIDENCE), intent), F.lit(0.78))


def classify(df: DataFrame, text: str, *, context: str | None = None, media: str | None = None, active: str | None = None) -> DataFrame:
    """Add routing text, intent, confidence and the emergency reason. Stateless, so streams take it too."""
    routed = df.withColumn("routed", routing_text(text)).withColumn("__screen", emergency(F.col("routed")))
    opt = lambda n: F.col(n) if n else None
    out = routed.withColumns({"intent": route(F.col("routed"), context=opt(context), media=opt(media), active=opt(active), screen=F.col("__screen")),
                              "emergency_reason": F.col("__screen")["reason"]}).drop("__screen")
    return out.withColumn("intent_confidence", route_confidence(F.col("intent")))


# Caregiver questions, first hit wins (fixed values).
CAREGIVER_RULES = (
    Rule("approval_action", any=("approve", "veto", "confirm", "theek hai", "cancel", "nahi chahiye", "reject")),
    Rule("adherence_check", any=("did he take", "morning liya", "missed kya", "kab li", "schedule check", "dawai li", "took", "skip")),
    Rule("lab_check", any=("report aaya", "test results", "hba1c kya hai", "lab pending", "blood test", "test update")),
    Rule("status_summary", any=("kaisa hai", "aaj ka haal", "health update", "what needs attention", "how is", "update do")),
    Rule("schedule_update", any=("main nahi hoon", "leave", "rahu nahi", "covering", "shift change", "available nahi", "aaj nahi aa")),
    Rule("notification_rule", any=("notify me if", "alert me when", "miss hone par", "jab tak", "when to alert")),
)


def caregiver_intent(text: str | Column, context: Column | None = None) -> Column:
    """Struct (intent, confidence) of a caregiver's question, null when none fits."""
    low = F.lower(c(text))
    conf = F.lit(0.85) if context is None else F.when(context.isin("interaction_alert", "new_med"), 0.95).otherwise(0.85)
    return first_match([(r.column(low, None, None), F.struct(F.lit(r.intent).alias("intent"), (
        conf if r.intent == "approval_action" else F.lit(0.85)).alias("confidence"))) for r in CAREGIVER_RULES])


def report_severity(routed: Column, intent: Column) -> Column:
    """Struct (level, confidence) of a health report."""
    mild, moderate, severe = has_word(routed, MILD), has_word(routed, MODERATE), has_word(routed, SEVERE)
    acute, chronic, critical = has_word(routed, ACUTE), has_word(routed, CHRONIC), has_word(routed, CRITICAL_SYMPTOMS)
    symptom = intent == "symptom_report"
    def row(level, conf):
        return F.struct(F.lit(level).alias("level"), F.lit(conf).alias("confidence"))
    return first_match([
        (emergency(routed)["is_emergency"], row("severe_acute", 1.0)),
        (symptom & critical & (acute | severe), row("severe_acute", 0.95)),
        (severe & (chronic | ~acute), row("severe_chronic", 0.86)),
        (moderate | (severe & intent.isin("mood_report", "emotional_checkin", "sleep_report")), row("moderate", 0.78)),
        (mild, row("mild", 0.72)), (intent.isin("diet_report", "exercise_report"), row("mild", 0.68)),
        (symptom, row("moderate", 0.65))], row("mild", 0.65))


# --- compound messages --------------------------------------------------------------------------------------

# Words that part clauses, and the most clauses of a message.
CLAUSE_LIMIT = 5
CLAUSE_SPLIT = r"(?i)\s*(?:[,;]|(?:^|\s)(?:and|also|aur|plus)(?:\s|$))\s*"


def clauses(text: str | Column) -> Column:
    """Clauses of at least two words, up to ``CLAUSE_LIMIT``; none for short messages of one or two parts."""
    def split(t: Column) -> Column:
        parts = F.transform(F.split(t, CLAUSE_SPLIT), lambda p: F.regexp_replace(p, r"^[ .!?]+|[ .!?]+$", ""))
        def choose(ps: Column) -> Column:
            long = F.size(F.split(one_space(t), " ")) > 10
            good = F.slice(F.filter(ps, lambda p: p.rlike(r"\S\s+\S")), 1, CLAUSE_LIMIT)
            return F.when((long | (F.size(ps) >= 3)) & t.rlike(CLAUSE_SPLIT), good).otherwise(F.array().cast("array<string>"))
        return let(F.filter(parts, lambda p: p != ""), choose)
    return let(F.coalesce(c(text), F.lit("")), split)


def secondary_intents(df: DataFrame, keys: Sequence[str], text: str, primary: str) -> DataFrame:
    """Distinct further intents of compound messages, in clause order."""
    each = df.select(*keys, primary, F.posexplode_outer(clauses(text)).alias("pos", "clause")).where("pos IS NOT NULL")
    each = each.withColumn("routed", routing_text("clause")).withColumn("__screen", emergency(F.col("routed")))
    each = each.withColumn("secondary", route(F.col("routed"), screen=F.col("__screen"))).drop("__screen")
    each = each.where(~F.col("secondary").isin("unknown", "greeting") & (F.col("secondary") != F.col(primary)))
    return each.groupBy(*keys, "secondary").agg(F.min("pos").alias("pos"))


# Voice events by clause, first kind that hits (fixed values).
# Spoken events and what parts them.
VOICE_EVENTS = (
    ("taken", ("took", "taken", "le li", "liya", "kha li", "done", "de di", "given")),
    ("missed", ("missed", "skipped", "skip", "nahi li", "nhi li", "not taken", "bhool")),
    ("symptom", ("pain", "dard", "fever", "bukhar", "weak", "kamzori", "chakkar", "dizzy", "vomit", "ulti", "nausea", "breathing",
                 "saans", "cough")),
    ("diet", ("breakfast", "lunch", "dinner", "khana", "khaya", "diet", "nahi khaya", "fasting")),
)
VOICE_SPLIT = r"(?i)[,;.]|(?:^|\s)(?:and|also|aur|but|phir)(?:\s|$)"


def voice_events(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Events told in a transcript, one per clause that names one."""
    parts = F.transform(F.split(F.col(text), VOICE_SPLIT), lambda p: F.trim(p))
    each = df.select(*keys, F.posexplode(parts).alias("pos", "clause")).where("clause <> ''")
    kind = first_match([(has_word(F.lower("clause"), words), k) for k, words in VOICE_EVENTS])
    return each.withColumn("event_type", kind).where("event_type IS NOT NULL")
