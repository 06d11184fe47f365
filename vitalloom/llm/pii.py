"""Personal data by weak supervision, in DataFrame code.

Patterns with a sure form (e-mail, IP, card, phone) give the base spans, which always stay. Wider patterns give
further candidates. Regex, gazetteer and context labelers vote on every candidate; expectation-maximisation over the
counted vote patterns estimates how reliable each labeler is, without labels; the posterior of each pattern then
trains a naive Bayes span classifier on shape and context features. A wider candidate is kept when the classifier
finds it likelier than not and no base span overlaps it.

The driver sees only counts by vote pattern and by feature value. Their number depends on the labelers, not on the
text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalloom.functions.text import let

from . import common

# Base kinds and their forms, written so that the matcher never backs up over a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
# Wider candidate forms.
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
NUMBER = r"(?<![0-9A-Za-z+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z.-])"
PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?\b"
HIDDEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}"
WIDE_KINDS = ("local_phone", "number", "person", "hidden_email")
KINDS = BASE_KINDS + WIDE_KINDS
# Gazetteer: given names and mail providers.
NAMES = ("james mary john linda robert susan michael sarah david laura anna maria peter paul jean marie pierre claire hans petra klaus ute "
         "jose carmen juan lucia luis elena").split()
PROVIDERS = ("gmail", "yahoo", "hotmail", "outlook", "proton", "icloud", "example", "mail")
# Context words of each kind, looked for in the words before a span.
CUES = {
    "email": "mail email e-mail contact write courriel correo", "hidden_email": "mail email e-mail contact write courriel correo",
    "ip": "ip host server address adresse", "card": "card visa mastercard credit account karte carte tarjeta",
    "phone": "phone tel call mobile fax telefon telephone telefono", "local_phone": "phone tel call mobile fax telefon telephone telefono",
    "number": "ssn social security insurance number", "person": "name patient dear contact by from",
}
#: Column of candidates; a name that no table has.
FOUND = "__pii_candidates"
LABELERS = ("shape", "check", "gazetteer", "cue", "glued")
CONTEXT = 40


def _scan_before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of at least one integer all those before it combined, 0 for none. Results of about the square root of
    n values each keep the work at n times that root, without a list that is copied for each value."""

    def scanned(x: Column) -> Column:
        v, width = x["v"], x["width"]
        over = lambda start, at, n: F.aggregate(F.slice(v, at + 1, n), start, combine)
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), none,
                             lambda s, b: F.struct(over(s["at"], b * width, width).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

        def each(before: Column) -> Column:
            block = lambda k: F.floor(k / width).cast("int")
            return F.transform(v, lambda _, k: over(F.get(before, block(k)), block(k) * width, k - block(k) * width))

        return let(blocks, each)

    return let(F.struct(values.alias("v"), _root(values).alias("width")), scanned)


def _root(values: Column) -> Column:
    return F.ceil(F.sqrt(F.size(values))).cast("int")


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, end, found, before, after) of leftmost non-overlapping matches; places in code points.

    The text is matched twice, however many matches it holds.
    """
    empty = F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>")

    def placed(x: Column) -> Column:
        parts, found = x["parts"], x["found"]
        sizes = F.transform(found, lambda m, k: F.length(F.get(parts, k)) + F.length(m))

        def each(before: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                start = F.get(before, k) + F.length(F.get(parts, k))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"),
                                F.right(F.get(parts, k), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, k + 1), F.lit(1)).alias("after"))

            return F.transform(found, one)

        return F.when(F.size(found) > 0, let(_scan_before(sizes, lambda p, q: p + q), each)).otherwise(empty)

    return let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """16 to 19 digits with a right check sum."""
    d = _digits(found)
    n = F.length(d)

    def weight(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + weight(i))
    return n.between(16, 19) & (F.when(n.between(16, 19), total % 10).otherwise(F.lit(1)) == 0)


def _valid(kind: str, found: Column) -> Column:
    """Check that a base form must pass."""
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(found)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    return F.lit(True)


PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, LOCAL_PHONE, NUMBER, PERSON, HIDDEN_EMAIL), strict=True))
#: A quick test that a text must pass before a form is looked for.
QUICK = {"email": "contains(__t, '@')", "ip": "__t RLIKE '[0-9][.][0-9]'", "card": "__t RLIKE '[0-9][ -]?[0-9]'", "phone": "contains(__t, '+')", "local_phone": "__t RLIKE '[0-9]{3}[)]?[ .-][0-9]{3}'",
         "number": "__t RLIKE '[0-9]-[0-9]{2}-[0-9]'", "person": "__t RLIKE '(Mr|Mrs|Ms|Dr|Prof)[.]? [A-Z]'", "hidden_email": "__t RLIKE '[(\\\\[](at|dot)[)\\\\]]'"}


def _votes(kind: str, m: Column) -> dict[str, Column]:
    """Vote of each labeler on a candidate: 1 personal, -1 not, 0 no opinion."""
    found, before, after = m["found"], F.lower(m["before"]), m["after"]
    tail_words = F.split(F.regexp_replace(before, r"[^\p{L}-]+", " "), " ")
    cue = F.arrays_overlap(tail_words, F.array(*[F.lit(w) for w in CUES[kind].split()]))
    digits = _digits(found)
    shapes = {
        "email": found.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,12}$"),
        "ip": found.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "card": found.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$"),
        "phone": found.rlike(r"^\+[0-9]{1,3}[ (.-]"), "local_phone": found.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$"),
        "number": F.lit(True), "person": found.rlike(r"\. [A-Z][a-z]+ [A-Z]"), "hidden_email": found.rlike(r"(at\)|at\]).*(dot|\.)"),
    }
    if kind in BASE_KINDS:
        check = _valid(kind, found)
    elif kind == "number":
        check = ~found.rlike("^(000|666|9)") & ~found.rlike("-00-") & ~found.rlike("-0000$")
    elif kind == "local_phone":
        check = found.rlike(r"^\(?[2-9]") & (F.size(F.array_distinct(F.split(digits, ""))) > 2)
    else:
        check = F.lit(None).cast("boolean")
    if kind in ("email", "hidden_email"):
        gazetteer = F.lower(found).rlike("(" + "|".join(PROVIDERS) + ")")
    elif kind == "person":
        gazetteer = F.arrays_overlap(F.split(F.lower(found), "[^a-z]+"), F.array(*[F.lit(x) for x in NAMES]))
    else:
        gazetteer = F.lit(None).cast("boolean")
    glued = F.right(before, F.lit(1)).rlike(r"[\p{L}0-9_]") | F.coalesce(after, F.lit("")).rlike(r"^[\p{L}0-9_]")
    yes_no = lambda c: F.when(c, 1).when(~c, -1).otherwise(0)
    return {"shape": yes_no(shapes[kind]), "check": yes_no(check), "gazetteer": F.when(gazetteer, 1).otherwise(0), "cue": F.when(cue, 1).otherwise(0), "glued": F.when(glued, -1).otherwise(0)}


def _described(kind: str, m: Column) -> Column:
    """Candidate struct of a match."""
    votes = _votes(kind, m)
    voted = F.concat_ws(",", F.lit(kind), *[votes[x].cast("string") for x in LABELERS])
    size = F.least(F.length(m["found"]), F.lit(40))

    def feature(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{kind}|{name}|"), F.coalesce(value, F.lit("?")))

    def side(text: Column, end: str, space: str, word: str) -> Column:
        return F.when(text == "", end).when(text.rlike(space), "space").when(text.rlike(word), "word").otherwise("mark")

    features = F.array(
        feature("size", (size - size % 4).cast("string")), feature("digits", F.least(F.length(_digits(m["found"])), F.lit(20)).cast("string")),
        feature("cue", votes["cue"].cast("string")), feature("check", votes["check"].cast("string")), feature("shape", votes["shape"].cast("string")),
        feature("before", side(m["before"], "start", r"\s$", r"[\p{L}0-9]$")), feature("after", side(m["after"], "end", r"^\s", r"^[\p{L}0-9]")))
    base = _valid(kind, m["found"]) if kind in BASE_KINDS else F.lit(False)
    return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), voted.alias("votes"), features.alias("features"))


def candidates(text: Column) -> Column:
    """Array of candidate structs (kind, start, end, base, votes, features) of the column ``__t``."""
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<string>>>")
    kinds = []
    for kind in KINDS:
        described = partial(_described, kind)
        kinds.append(F.when(F.expr(QUICK[kind]), F.transform(_matches(text, PATTERNS[kind]), lambda m: described(m))).otherwise(nothing))
    return F.concat(*kinds)


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``FOUND``, the candidates of the whole text; a null text is empty."""
    return docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn(FOUND, candidates(F.col("__t"))).drop("__t")


@dataclass
class Model:
    """Labeler reliabilities, posterior of each vote pattern, and the classifier's log odds by feature."""

    reliability: dict[tuple[str, int], float]
    posterior: dict[str, float]
    weights: dict[str, float]
    prior: float


def estimate(counts: dict[str, int], rounds: int = 30) -> tuple[dict[tuple[str, int], float], dict[str, float]]:
    """Expectation-maximisation over counted vote patterns ``kind,vote,vote,...``.

    A labeler's reliability is the share of personal candidates among those on which it gives a vote, smoothed and
    started from trust in every vote; votes are taken as independent given the truth.
    """
    rows = [(p.split(",")[0], [int(v) for v in p.split(",")[1:]], n) for p, n in sorted(counts.items())]
    prior = {k: 0.5 for k, _, _ in rows}
    rates = {(j, y, v): (0.6 if (v == 1) == (y == 1) else 0.2) if v else 0.2 for j in range(len(LABELERS)) for y in (0, 1) for v in (-1, 0, 1)}
    post = {}
    for _ in range(rounds):
        for kind, votes, _ in rows:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(rates[j, 1, v] / rates[j, 0, v]) for j, v in enumerate(votes) if v)
            post[kind, tuple(votes)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in prior:
            own = [(post[k, tuple(v)], n) for k, v, n in rows if k == kind]
            prior[kind] = min(0.99, max(0.01, (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                mass = {v: 1.0 + sum((post[k, tuple(w)] if y else 1 - post[k, tuple(w)]) * n for k, w, n in rows if w[j] == v) for v in (-1, 0, 1)}
                # a vote keeps at least its direction
                mass[1 if y else -1] = max(mass[1 if y else -1], 1.5 * mass[-1 if y else 1]) if j else mass[1 if y else -1]
                total = sum(mass.values())
                for v in mass:
                    rates[j, y, v] = mass[v] / total
    reliability = {(LABELERS[j], v): rates[j, 1, v] / (rates[j, 1, v] + rates[j, 0, v]) for j in range(len(LABELERS)) for v in (-1, 1)}
    return reliability, {",".join([k, *map(str, v)]): p for (k, v), p in post.items()}


def fit(found: DataFrame) -> Model:
    """Fit on the candidates of a stored table; without candidates the model keeps no wider span."""
    each = found.select(F.explode(FOUND).alias("c"))
    counts = {r[0]: r[1] for r in each.groupBy("c.votes").count().collect()}
    reliability, posterior = estimate(counts)
    if not counts:
        return Model(reliability, posterior, {}, 0.0)
    p = F.element_at(_literal_map(posterior), F.col("votes"))
    sums = (each.select("c.votes", F.explode("c.features").alias("feature")).groupBy("feature", "votes").count()
            .groupBy("feature").agg(F.sum(p * F.col("count")), F.sum((1 - p) * F.col("count"))).collect())
    yes = sum(posterior[v] * n for v, n in counts.items())
    no = sum((1 - posterior[v]) * n for v, n in counts.items())
    weights = {r[0]: math.log((r[1] + 0.5) / (yes + 1)) - math.log((r[2] + 0.5) / (no + 1)) for r in sums}
    return Model(reliability, posterior, weights, math.log((yes + 1) / (no + 1)))


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def accepted(model: Model) -> Column:
    """All spans of ``FOUND``: base spans, and wider ones that the classifier takes and no base span overlaps."""
    base = F.filter(FOUND, lambda c: c["base"])
    if not model.weights:
        return base
    weights = _literal_map(model.weights)

    def likely(c: Column) -> Column:
        return F.aggregate(c["features"], F.lit(model.prior), lambda s, f: s + F.coalesce(F.try_element_at(weights, f), F.lit(0.0))) > 0

    def wide(c: Column) -> Column:
        clear = ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return c["kind"].isin(*WIDE_KINDS) & likely(c) & clear

    return F.concat(base, F.filter(FOUND, wide))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, in the order of kinds and then of starts, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat(c["kind"], F.lit(":"), c["start"].cast("string"), F.lit(":"), c["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, candidates, found): every row's candidates and accepted spans, places in code points.

    Null and empty texts have none. Repeated rows and null ids are treated like any other; other columns are not read.
    """
    kept = common.stored(with_candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"), "pii-candidates")
    return kept.select("doc_id", F.col(FOUND).alias("candidates"), accepted(fit(kept)).alias("found"))


def masked(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every accepted span of the text replaced by its kind in angle brackets.

    Overlapping spans are masked as one, by the kind of the first. Null texts stay null.
    """
    seen = with_candidates(docs.withColumnRenamed(text_col, "__text"), "__text")
    spans = F.array_sort(F.transform(accepted(model), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    seen = seen.withColumn("__spans", spans)
    out = F.when(F.size("__spans") > 0, _replaced(F.col("__text"), F.col("__spans"))).otherwise(F.col("__text"))
    return seen.select(*[out.alias(text_col) if c == text_col else F.col(c) for c in docs.columns])


def _replaced(text: Column, spans: Column) -> Column:
    """The text with its sorted spans replaced. Whole stretches of it are cut out first, so that a text of very many
    spans is not walked from its start for each."""
    ends = F.transform(spans, lambda c: c["end"])

    def cut(reached: Column) -> Column:
        pieces = F.transform(spans, lambda c, k: F.struct(F.get(reached, k).alias("from"), c["start"].alias("to"), c["kind"].alias("kind")))
        return let(F.filter(pieces, lambda p: p["from"] <= p["to"]), joined_pieces)

    def joined_pieces(pieces: Column) -> Column:
        width = _root(pieces)

        def stretch(b: Column) -> Column:
            some = F.slice(pieces, b * width + 1, width)
            first, last = F.get(some, 0)["from"], F.get(some, F.size(some) - 1)["to"]
            return let(F.struct(some.alias("some"), first.alias("first"), F.substring(text, first + 1, last - first).alias("part")), lambda x: F.array_join(
                F.transform(x["some"], lambda p: F.concat(F.substring(x["part"], p["from"] - x["first"] + 1, p["to"] - p["from"]), F.lit("<"), p["kind"], F.lit(">"))), ""))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / width).cast("int")), stretch), "")

    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.concat(let(_scan_before(ends, lambda p, q: F.greatest(p, q)), cut), rest)
