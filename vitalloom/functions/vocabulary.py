"""The words, phrases and spellings that give the right results.

Plain lists and maps, in the order in which they apply.
"""

# Phrase repairs of short messages (fixed values).
PHRASE_REPAIRS = {
    "heart atack": "heart attack", "hart attack": "heart attack", "heartattacke": "heart attack",
    "heartattack": "heart attack", "chestoain": "chest pain", "chestpain": "chest pain", "chest painn": "chest pain",
    "chest paon": "chest pain", "chest pan": "chest pain", "heart fail": "heart failure", "heart pain": "heart pain",
    "ambu lance": "ambulance", "call ambu": "call ambulance", "saansein atak gayi": "breathing stuck",
    "saanse atak gayi": "breathing stuck", "saans ruk rahi": "breathing stopping",
    "saans nahi aa rahi": "breathing not coming", "mai build pe sey kudh liya": "i jumped from building",
    "building se kuda": "jumped from building", "fell from building": "fell from building",
    "fell from a building": "fell from a building", "some one raped": "someone raped",
    "koi ghar me ghus aaya": "koi ghar mein ghus aaya", "le liya": "le li", "nahi khai": "nahi li",
    "nhi khai": "nahi li", "nai li": "nahi li", "bhool gya": "bhool gaya", "bhul gaya": "bhool gaya",
    "skip kar diya": "skip kar di", "no medication all today": "no medications today",
    "no medicines all today": "no medications today", "what med now": "what medicine now",
    "what med to afternoon": "what medicine for afternoon",
    "what med now i want ot take": "what medicine now i want to take",
    "what meds now i should take": "what medicines now i should take", "present tablet": "present medicine",
    "present tablets": "present medicines", "appmnt": "appointment", "followup": "follow up", "check up": "checkup",
    "heloo": "hello", "helloo": "hello", "who r u": "who are you", "who are u": "who are you",
    "who you are": "who are you", "i dont want my life": "i do not want my life",
    "i don t want my life": "i do not want my life",
}

# Token repairs (fixed values).
TOKEN_REPAIRS = {
    "saansein": "saans", "saanse": "saans", "sans": "saans", "saan": "saans", "dardh": "dard", "drd": "dard",
    "doctar": "doctor", "docotr": "doctor", "medicne": "medicine", "medicin": "medicine", "meds": "medicine",
    "tabs": "medicine", "tablt": "tablet", "appoinment": "appointment", "appointmnt": "appointment",
    "appt": "appointment", "rprt": "report", "suger": "sugar", "bukharh": "bukhar", "chakar": "chakkar",
    "chkr": "chakkar", "udas": "sad", "tensed": "anxious", "ot": "to",
}

# Short-message shorthand (fixed values).
SHORTHAND = {"u": "you", "plz": "please", "r": "are", "2": "to", "4": "for", "gr8": "great", "thx": "thanks",
             "msg": "message", "txt": "text"}

# Everyday aliases (fixed values).
ALIASES = {
    "nhi": "nahi", "dawa": "medicine", "dawai": "medicine", "tablet": "medicine", "med": "medicine", "doc": "doctor",
    "apt": "appointment", "rprt": "report", "seene": "chest", "mein": "in", "dard": "pain", "behosh": "unconscious",
    "kud": "suicide", "kushi": "suicide", "mar": "died", "gaye": "died", "intqaal": "died", "li": "taken",
    "kha": "taken", "skip": "missed", "dil": "heart", "daura": "attack", "saans": "breathing",
    "chakkar": "dizziness", "ulti": "vomiting", "bukhar": "fever", "kal": "yesterday",
    "parso": "day after tomorrow", "abhi": "now", "iss waqt": "now", "ho raha": "happening",
}

# Words split by typing (fixed values).
SPLIT_REPAIRS = {
    "tab let": "tablet", "ambu lance": "ambulance", "heart atack": "heart attack", "chest painn": "chest pain",
    "medicne": "medicine", "doctar": "doctor", "appoinment": "appointment", "bloo d": "blood", "suger": "sugar",
    "prescrip tion": "prescription",
}

NEGATED_TOKENS = ("li", "khai", "kha", "taken")
NEGATORS = ("nahi", "nai", "no", "not")

# Voice fillers (fixed values).
FILLERS = ("um", "umm", "uh", "haan ji", "haan haan", "matlab", "actually", "please note")

# Item-name aliases in the order of the contained-name search (fixed values).
ITEM_ALIASES = {
    "ecosprin": "aspirin", "ecosprin av": "aspirin+atorvastatin", "aspirin": "aspirin", "clopivas": "clopidogrel",
    "clopidogrel": "clopidogrel", "telma": "telmisartan", "telma am": "telmisartan+amlodipine",
    "telmisartan": "telmisartan", "amlodipine": "amlodipine", "rosuvastatin": "rosuvastatin",
    "pantoprazode": "pantoprazole", "pantoprazole": "pantoprazole", "metformin": "metformin", "warfarin": "warfarin",
    "furosemide": "furosemide", "digoxin": "digoxin", "metoprolol": "metoprolol",
    "metoprolol succinate": "metoprolol", "metoprodol": "metoprolol", "metoprodol succinate": "metoprolol",
    "metolar": "metoprolol", "met xl": "metoprolol", "ivabradine": "ivabradine",
}

# Document types by their telling words (fixed values).
TYPE_WORDS = {
    "prescription": (
        "tablet", "capsule", "dose", "frequency", "doctor", "patient", "Rx", "1-0-0", "after", "food", "before", "food",
        "dawai", "goli", "syrup", "chashma", "morning", "night", "tab", "tab.", "cap", "cap.", "od", "bd", "tds", "mg",
    ),
    "lab_report": (
        "test", "result", "value", "unit", "reference", "range", "mg/dL", "g/dL", "CBC", "creatinine", "haemoglobin", "low",
        "high", "normal", "report", "hb", "rbc", "sgpt", "sgot", "hdl", "ldl", "triglycerides",
    ),
    "voice_note": (
        "feeling", "took", "missed", "dizzy", "pain", "yesterday", "morning", "night", "dad", "uncle", "patient", "symptom",
        "kaisa", "hai",
    ),
    "advice_note": (
        "diet", "lifestyle", "walk", "exercise", "avoid", "stress", "smoking", "low", "salt", "follow-up", "review", "parhez",
    ),
    "discharge_summary": (
        "discharged", "admitted", "condition", "follow-up", "appointment", "diagnosis", "hospital", "stay", "chuthi",
        "discharge", "follow up",
    ),
    "referral_letter": (
        "referral", "specialist", "consult", "urgent", "reason", "evaluation", "assessment", "visheshagya", "refer",
        "referred", "consultation",
    ),
    "medical_history": (
        "history", "of", "past", "surgery", "diabetes", "hypertension", "allergy", "family", "history", "patient", "has",
        "known", "case", "of", "purana", "rog",
    ),
    "general_note": (
        "note", "message", "update", "information", "record", "miscellaneous",
    ),
}

# Kept lines when a text must be shortened, by document type (fixed values).
KEEP_WORDS = ("tab", "cap", "inj", "mg/dl", "g/dl", "mmol", "patient", "name:", "date:", "test", "result", "discharge",
              "referral")
KEEP_WORDS_BY_TYPE = {
    "prescription": ("rx", "dose", "od", "bd", "tds", "after food", "before food"),
    "lab_report": ("reference", "range", "high", "low", "creatinine", "hba1c"),
    "discharge_summary": ("diagnosis", "follow-up", "follow up", "hospital", "admitted"),
}

# Two-class evidence words (fixed values).
RX_WORDS = ("mg", "tablet", "tab", "capsule", "cap", "syrup", "prescribed", "prescription", " od", " bd", " tds", " sos",
            "doctor", "dr.", "dose", "once daily", "twice daily", "before food", "after food")
RX_PATTERNS = ((r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b", 2), (r"\b(?:od|bd|tds|qid|sos|hs)\b", 1))
LAB_WORDS = ("hba1c", "creatinine", "glucose", "mg/dl", "mmol/l", "reference", "range", "lab", "report", "blood test",
             "normal", "high", "low", "thyroid", "tsh", "t3", "t4", "hemoglobin", "cholesterol")
LAB_PATTERNS = ((r"\b(?:hba1c|creatinine|glucose|tsh|cholesterol|hemoglobin)\b[^\n]{0,30}\d", 2),
                (r"\d{2,3}/\d{2,3}", 2), (r"\bbp\s*:?\s*\d+", 2), (r"\bpulse\s*:?\s*\d+", 2),
                (r"\bsugar\s*:?\s*\d+", 2), (r"\bspo2\s*:?\s*\d+", 2))

# Specialties by their words, first hit wins (fixed values).
SPECIALTIES = (
    ("cardiologist", ("cardiologist", "cardiology", "heart specialist", "interventional cardiology")),
    ("dentist", ("dentist", "dental", "orthodontist", "endodontist", "periodontist")),
    ("endocrinologist", ("endocrinologist", "diabetologist", "diabetes", "thyroid")),
    ("pulmonologist", ("pulmonologist", "pulmonology", "chest physician", "respiratory", "asthma")),
    ("ent specialist", ("ent", "ear nose throat", "otorhinolaryngology")),
    ("pediatrician", ("pediatrician", "paediatrician", "pediatrics", "paediatrics", "child specialist")),
    ("dermatologist", ("dermatologist", "dermatology", "skin")),
    ("orthopedist", ("orthopedic", "orthopaedic", "orthopedist", "orthopaedist", "bone", "joint replacement")),
    ("neurologist", ("neurologist", "neurology", "neuro physician")),
    ("nephrologist", ("nephrologist", "nephrology", "renal", "kidney")),
    ("gastroenterologist", ("gastroenterologist", "gastroenterology", "hepatologist", "liver specialist")),
    ("gynecologist", ("gynecologist", "gynaecologist", "obstetrician", "obstetrics")),
    ("urologist", ("urologist", "urology")),
    ("ophthalmologist", ("ophthalmologist", "ophthalmology", "eye specialist")),
    ("psychiatrist", ("psychiatrist", "psychiatry")),
    ("oncologist", ("oncologist", "oncology", "cancer")),
    ("general physician", ("general physician", "internal medicine", "consultant physician", "family physician", "mbbs")),
)
SYMPTOM_ALERT_WORDS = ("severe", "bahut", "zyada", "chest pain", "seene mein dard", "saans nahi", "breathing",
                       "unconscious", "behosh", "collapse", "heart attack", "emergency")

# Side-effect hints: item and symptom, in order (fixed values).
SIDE_EFFECT_HINTS = (
    ("amlodipine", "dizziness"), ("amlodipine", "chakkar"), ("amlodipine", "swelling"), ("amlodipine", "sojan"),
    ("amlodipine", "headache"), ("metformin", "nausea"), ("metformin", "vomiting"), ("metformin", "ulti"),
    ("metformin", "diarrhea"), ("metformin", "loose motion"), ("ramipril", "cough"), ("ramipril", "dizziness"),
    ("ramipril", "chakkar"), ("glimepiride", "dizziness"), ("glimepiride", "chakkar"), ("glimepiride", "sweating"),
    ("glimepiride", "kamzori"), ("glimepiride", "weak"),
)
SYMPTOM_SYNONYMS = {
    "dizziness": ("dizziness", "dizzy", "lightheaded", "light headed", "chakkar"),
    "chakkar": ("chakkar", "dizzy", "dizziness"),
    "swelling": ("swelling", "swollen", "sojan", "sujan"),
    "sojan": ("sojan", "sujan", "swelling", "swollen"),
    "nausea": ("nausea", "nauseous", "matli", "jee michla"),
    "vomiting": ("vomiting", "vomit", "throwing up", "ulti"),
    "ulti": ("ulti", "vomit", "vomiting"),
    "diarrhea": ("diarrhea", "loose motion", "loose stools", "dast"),
    "loose motion": ("loose motion", "loose motions", "loose stools", "diarrhea"),
    "headache": ("headache", "head pain", "sir dard", "sar dard"),
    "cough": ("cough", "dry cough", "khansi"),
    "sweating": ("sweating", "sweat", "pasina"),
    "kamzori": ("kamzori", "weak", "weakness"),
    "weak": ("weak", "weakness", "kamzori"),
}

# Lab names: spelling to canonical name (fixed values).
LAB_ALIASES = {
    "hb": "hemoglobin", "haemoglobin": "hemoglobin", "hemoglobin": "hemoglobin", "glycated hemoglobin": "hba1c",
    "glycosylated hemoglobin": "hba1c", "hba1c": "hba1c", "hb a1c": "hba1c", "triiodothyronine t3 free": "free_t3",
    "triiodothyronine free": "free_t3", "t3 free": "free_t3", "free t3": "free_t3", "thyroxine t4 free": "free_t4",
    "thyroxine free": "free_t4", "t4 free": "free_t4", "free t4": "free_t4", "thyroid stimulating hormone": "tsh",
    "thyroid stimulating hormone tsh": "tsh", "tsh": "tsh", "creatinine": "creatinine",
    "serum creatinine": "creatinine", "glucose": "glucose", "blood glucose": "glucose", "blood sugar": "glucose",
    "fasting glucose": "glucose", "fasting blood sugar": "glucose", "random glucose": "glucose",
    "random blood sugar": "glucose", "pulse": "pulse", "spo2": "spo2", "oxygen saturation": "spo2",
    "temperature": "temperature", "temp": "temperature", "systolic bp": "blood_pressure_systolic",
    "blood pressure systolic": "blood_pressure_systolic", "diastolic bp": "blood_pressure_diastolic",
    "blood pressure diastolic": "blood_pressure_diastolic",
}
# Spellings of a laboratory report and their canonical names (fixed values).
REPORT_LAB_ALIASES = {
    "estimated average glucose": "estimated_average_glucose", "fasting blood sugar": "glucose", "random blood sugar": "glucose",
    "blood glucose": "glucose", "blood sugar": "glucose", "serum creatinine": "creatinine", "total leucocyte count": "wbc",
    "total leukocyte count": "wbc", "total wbc count": "wbc", "wbc count": "wbc", "platelet count": "platelets",
    "total cholesterol / hdl ratio": "cholesterol_hdl_ratio", "ldl cholesterol": "ldl_cholesterol", "hdl cholesterol": "hdl_cholesterol",
    "vldl cholesterol": "vldl_cholesterol", "total cholesterol": "cholesterol", "bun / creatinine ratio": "bun_creatinine_ratio",
    "alkaline phosphatase": "alkaline_phosphatase", "total bilirubin": "bilirubin", "total protein": "total_protein",
    "a/g ratio": "albumin_globulin_ratio", "pcv / hematocrit": "hematocrit", "packed cell volume": "hematocrit", "pcv": "hematocrit",
    "mean corpuscular volume": "mcv", "glycated hemoglobin": "hba1c", "hb a1c": "hba1c", "hba1c": "hba1c", "hemoglobin": "hemoglobin",
    "haemoglobin": "hemoglobin", "glucose": "glucose", "creatinine": "creatinine", "blood urea": "blood_urea", "egfr": "egfr",
    "triglycerides": "triglycerides", "neutrophils": "neutrophils", "lymphocytes": "lymphocytes", "eosinophils": "eosinophils",
    "monocytes": "monocytes", "basophils": "basophils", "rbc count": "rbc", "mcv": "mcv", "mchc": "mchc", "mch": "mch", "rdw": "rdw",
    "sgot": "sgot_ast", "ast": "sgot_ast", "sgpt": "sgpt_alt", "alt": "sgpt_alt", "albumin": "albumin", "globulin": "globulin",
    "sodium": "sodium", "potassium": "potassium", "tsh": "tsh", "free t3": "free_t3", "t3": "free_t3", "free t4": "free_t4",
    "t4": "free_t4", "pulse": "pulse", "spo2": "spo2", "temperature": "temperature",
}
# Every spelling, signs as blanks.
ALL_LAB_ALIASES = {**LAB_ALIASES, **{" ".join(k.replace("/", " ").split()): x for k, x in REPORT_LAB_ALIASES.items()}}
REPORT_NAME_PATTERN = "|".join(k.replace(" ", r"\s*" if "/" in k else r"\s+") for k in sorted(REPORT_LAB_ALIASES, key=lambda k: (-len(k), k)))
# Names a lab row may start with, longest first within a family (fixed pattern).
LAB_NAME_PATTERN = (rf"\b(?:{REPORT_NAME_PATTERN})\b|" r"triiodothyronine\s*(?:\(?t3\)?)?,?\s*free|thyroxine\s*(?:\(?t4\)?)?,?\s*free|"
                    r"thyroid stimulating hormone(?:\s*\(tsh\))?|\btsh\b|\bt3\b|\bt4\b|hba1c|hb a1c|glycated hemoglobin|"
                    r"glycosylated hemoglobin|serum creatinine|creatinine|hemoglobin|haemoglobin|\bhb\b|"
                    r"fasting blood sugar|random blood sugar|blood sugar|blood glucose|fasting glucose|random glucose|"
                    r"glucose|spo2|oxygen saturation|temperature|temp|pulse|systolic bp|diastolic bp")

# Dose units and frequencies (fixed values).
UNIT_ALIASES = {
    "microgram": "mcg", "micrograms": "mcg", "µg": "mcg", "milligram": "mg", "milligrams": "mg", "gram": "g",
    "grams": "g", "millilitre": "ml", "millilitres": "ml", "milliliter": "ml", "milliliters": "ml", "tabs": "tablet",
    "tablets": "tablet", "caps": "capsule", "capsules": "capsule", "teaspoons": "teaspoon", "tsp.": "tsp",
    "tablespoons": "tablespoon", "tbsp.": "tbsp", "sprays": "spray", "puffs": "puff",
}
UNITS = ("mg", "mcg", "g", "ml", "iu", "unit", "units", "%", "tablet", "capsule", "drop", "drops", "puff", "puffs",
         "tsp", "teaspoon", "tbsp", "tablespoon", "spoon", "sachet", "vial", "ampoule", "amp", "application",
         "applications", "spray", "sprays")
FREQUENCIES = {
    "1-0-0": "OD", "0-1-0": "OD", "0-0-1": "HS", "1-0-1": "BD", "1-1-0": "BD", "0-1-1": "BD", "1-1-1": "TDS",
    "1-1-1-1": "QID", "od": "OD", "once daily": "OD", "daily": "OD", "bd": "BD", "bid": "BD", "twice daily": "BD",
    "tds": "TDS", "tid": "TDS", "three times daily": "TDS", "qid": "QID", "four times daily": "QID", "hs": "HS",
    "night": "HS", "bedtime": "HS", "sos": "SOS", "prn": "SOS", "as needed": "SOS",
}
FORM_WORDS = ("tab", "tablet", "cap", "capsule", "syrup", "syp", "syr", "inj", "injection", "susp", "suspension", "drop",
              "drops", "cream", "ointment", "gel", "lotion", "spray", "inhaler", "neb", "nebulization",
              "nebulisation", "solution", "soln", "sachet", "vial", "ampoule", "amp", "patch")
INSTRUCTIONS = ("in case of fever", "in case of throat pain", "in case of cough", "before food", "after food",
                "with food", "empty stomach")
ADVICE = ("shake well", "complete course", "avoid alcohol", "do not drive", "apply locally", "gargle",
          "steam inhalation", "dilute before use", "rinse mouth", "keep refrigerated")
