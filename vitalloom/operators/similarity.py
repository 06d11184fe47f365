"""Near matches of names and sentences, without comparing everything with everything."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.core import c, first_match, has_text, with_lengths
from ..functions.text import one_space, sequence_ratio, soundex_like
from ..session import written
from .containment import names_in_texts
from .joins import contained_names
from .routing import REPAIR_TERMS


def edits_levenshtein(cutoff: float):
    """Most edits a partner of a word of length L can need when the ratio to the longer word must reach ``cutoff``."""
    return lambda n: F.floor(n * ((1 - cutoff) / cutoff) + 1e-9).cast("int")


def edits_sequence(cutoff: float):
    """The same bound for the matching-blocks ratio 2M/(a+b)."""
    return lambda n: F.floor(n * (2 * (1 - cutoff) / cutoff) + 1e-9).cast("int")


def edit_candidates(left: DataFrame, right: DataFrame, a: str, b: str, edits) -> DataFrame:
    """Distinct pairs that may lie within the edit bound: every true pair is among them.

    A word of length L is cut into edits(L)+1 pieces; with that many edits one
    piece must survive unchanged. Counting the edits left and right of the piece
    bounds how far it can have moved, so a probe offers few substrings, and both
    sides meet by equality on (length, piece number, piece).
    """
    words = right.select(F.col(b)).where(F.length(b) > 0).distinct()
    probes = left.select(F.col(a)).where(F.length(a) > 0).distinct()
    n = F.length(b)
    k = F.least(edits(n), n - 1)
    def cut(text: Column, length: Column, count: Column, i: Column, shift: Column) -> Column:
        lo = F.floor(i * length / count)
        size = F.floor((i + 1) * length / count) - lo
        return F.substring(text, (lo + shift + 1).cast("int"), size.cast("int"))
    pieces = words.select(b, n.alias("__len"), F.posexplode(F.transform(
        F.sequence(F.lit(0), k), lambda i: cut(F.col(b), n, k + 1, i, F.lit(0)))).alias("__no", "__piece"))
    m = F.length(a)
    length = F.col("__len")
    kk, gap = F.least(edits(length), length - 1), m - length
    def for_piece(i: Column) -> Column:
        low = F.greatest(-i, gap - (kk - i), -F.floor(i * length / (kk + 1)))
        high = F.least(i, gap + (kk - i), m - F.floor((i + 1) * length / (kk + 1)))
        shifts = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(shifts, lambda s: F.struct(i.alias("i"), cut(F.col(a), length, kk + 1, i, s).alias("p")))
    near = with_lengths(probes, words, b, "__len").where(F.abs(length - m) <= edits(length))
    probe = near.select(a, "__len", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), kk), for_piece)))).alias("__k")).select(
        a, "__len", F.col("__k.i").alias("__no"), F.col("__k.p").alias("__piece"))
    return probe.join(pieces, ["__len", "__no", "__piece"]).select(a, b).distinct()


def levenshtein_ratio(a: str | Column, b: str | Column) -> Column:
    return 1 - F.levenshtein(c(a), c(b)) / F.greatest(F.length(c(a)), F.length(c(b)))


def fuzzy_names(raw: DataFrame, known: DataFrame, name: str, word: str, *, aliases: Mapping[str, str] | None = None,
                cutoff: float = 0.8, exact_ratio: bool = False) -> DataFrame:
    """Best known name of each distinct raw name, by tiers: equal or contained 1.0,
    alias .95, edit ratio from ``cutoff`` on, same sound. ``exact_ratio`` scores with
    matching blocks instead of edits."""
    names = raw.select(F.lower(F.trim(F.col(name))).alias("__n")).where("__n <> ''").distinct()
    words = known.select(F.lower(F.trim(F.col(word))).alias("__w")).where("__w <> ''").distinct()
    inside = contained_names(names, words, "__n", "__w").select("__n", "__w", F.lit(1.0).alias("score"), F.lit(4).alias("tier"))
    parts = [inside]
    if aliases:
        to = first_match([(has_text(F.col("__n"), [k]), x) for k, x in aliases.items()])
        hit = names.withColumn("__w", to).join(words, "__w").select("__n", "__w", F.lit(0.95).alias("score"), F.lit(3).alias("tier"))
        parts.append(hit)
    cand = edit_candidates(names, words, "__n", "__w", edits_sequence(cutoff) if exact_ratio else edits_levenshtein(cutoff))
    ratio = sequence_ratio("__n", "__w") if exact_ratio else levenshtein_ratio("__n", "__w")
    parts.append(cand.withColumn("score", ratio).where(F.col("score") >= cutoff - 1e-12).select(
        "__n", "__w", "score", F.lit(2).alias("tier")))
    same = names.where((F.length("__n") >= 4) & ~F.col("__n").contains(" ")).withColumn("__x", soundex_like("__n")).join(
        words.withColumn("__x", soundex_like("__w")), "__x")
    parts.append(same.select("__n", "__w", F.greatest(F.lit(0.76), levenshtein_ratio("__n", "__w") * 0.9).alias("score"), F.lit(1).alias("tier"))
                 .where(F.col("score") >= max(0.75, cutoff)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("__n").agg(F.max(F.struct("tier", "score", "__w")).alias("__b"))
    return raw.withColumn("__n", F.lower(F.trim(F.col(name)))).join(best, "__n", "left").select(
        *raw.columns, F.col("__b.__w").alias("matched"), F.round("__b.score", 4).alias("score"), F.col("__b.tier").alias("tier"))


# --- token repair -----------------------------------------------------------------------------------

def repair_tokens(df: DataFrame, keys: Sequence[str], text: str, *, terms: Sequence[str] = REPAIR_TERMS, cutoff: float = 0.88,
                  min_length: int = 5, out: str = "repaired") -> DataFrame:
    """Replace close misspellings of ``terms`` inside the text.

    Distinct tokens meet the terms by pieces, the exact ratio runs on those few
    pairs only, and only texts that hold such a token are rebuilt.
    """
    spark = df.sparkSession
    token = F.explode(F.array_distinct(F.split(F.col(text), " ")))
    tokens = df.select(token.alias("__tok")).where(F.length("__tok") >= min_length).distinct()
    words = spark.createDataFrame([(t,) for t in terms], "__term string")
    close = edit_candidates(tokens, words, "__tok", "__term", edits_sequence(cutoff)).where("__tok <> __term")
    scored = close.withColumn("__r", sequence_ratio("__tok", "__term")).where(F.col("__r") >= cutoff)
    fix = scored.groupBy("__tok").agg(F.max_by("__term", F.struct("__r", "__term")).alias("__term"))
    per_text = (df.select(*keys, token.alias("__tok")).join(fix, "__tok").groupBy(*keys)
                .agg(F.map_from_entries(F.collect_list(F.struct("__tok", "__term"))).alias("__fix")))
    joined = df.join(per_text, list(keys), "left")
    new = F.array_join(F.transform(F.split(F.col(text), " "), lambda t: F.coalesce(F.try_element_at("__fix", t), t)), " ")
    return joined.withColumn(out, F.when(F.col("__fix").isNull(), F.col(text)).otherwise(new)).drop("__fix")


def compact_typos(df: DataFrame, keys: Sequence[str], text: str, phrases: Sequence[str], *, cutoff: float = 0.86,
                  max_gap: int = 3) -> DataFrame:
    """Texts with a token, or a whole text run together, close to a phrase without its blanks."""
    spark = df.sparkSession
    compact = sorted({p.replace(" ", "") for p in phrases if len(p.replace(" ", "")) >= 7})
    words = spark.createDataFrame([(p,) for p in compact], "__p string")
    plain = F.regexp_replace(F.col(text), r"[^\p{L}\p{N}\s]", "")
    whole = F.regexp_replace(plain, r"\s+", "")
    longest = max(len(p) for p in compact) + max_gap
    cands = F.filter(F.array_distinct(F.concat(F.split(plain, r"\s+"), F.array(whole))),
                     lambda x: F.length(x).between(5, longest))
    each = df.select(*keys, F.explode(cands).alias("__tok"))
    pairs = edit_candidates(each, words, "__tok", "__p", edits_sequence(cutoff))
    good = pairs.where(F.abs(F.length("__tok") - F.length("__p")) <= max_gap).withColumn(
        "__r", sequence_ratio("__tok", "__p")).where(F.col("__r") >= cutoff).select("__tok").distinct()
    hit = each.join(good, "__tok", "left_semi").select(*keys).distinct().withColumn("typo", F.lit(True))
    return df.join(hit, list(keys), "left").withColumn("typo", F.coalesce("typo", F.lit(False)))


# --- nearest sentence ----------------------------------------------------------------------------------

#: Letters whose counts bound the ratio of two sentences.
COUNTED = "etaoinshrdlucmfp"
RATIO_WEIGHT = 0.82  # fixed value


def sentence_candidates(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """Distinct pairs of sentences whose matching-blocks ratio may reach ``cutoff``: every true pair is among them.

    Sentences meet by length class, a few neighbouring ones each; then lengths and letter counts bound the ratio.
    """
    shorter = cutoff / (2 - cutoff)  # least ratio of the lengths

    def described(df: DataFrame, col: str, n: str) -> DataFrame:
        size = F.length(col)
        counts = F.array(*[size - F.length(F.replace(F.col(col), F.lit(x), F.lit(""))) for x in COUNTED])
        return df.select(col).where(size > 0).distinct().select(col, size.alias(f"__l{n}"), counts.alias(f"__c{n}"))

    classed = lambda n: F.floor(F.log(F.col(n)) / math.log(1 / min(shorter, 0.999)))
    x = described(left, a, "x").withColumn("__k", classed("__lx"))
    near = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: classed("__ly") + d)
    y = described(right, b, "y").withColumn("__k", F.explode(near))
    pairs = x.join(y, "__k").where(F.least("__lx", "__ly") >= F.greatest("__lx", "__ly") * shorter - 1e-9)
    apart = F.aggregate(F.zip_with("__cx", "__cy", lambda u, v_: F.abs(u - v_)), F.lit(0), lambda t, u: t + u)
    return pairs.where(apart <= (F.col("__lx") + F.col("__ly")) * (1 - cutoff) + 1e-9).select(a, b)


class SideBySide:
    """Edit distances of a text to many sentences at once: bit-parallel columns of all of them in one long integer,
    each with a free bit above it that stops carries."""

    def __init__(self, sentences: list[str], own: Sequence[dict[str, int]] | None = None):
        own = own or [self.letters(x) for x in sentences]
        sizes = np.array([len(x) for x in sentences])
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.sizes, self.length = sizes, int((sizes + 1).sum())
        self.bits = self.first = 0
        self.places: dict[str, int] = {}
        for start, x, letters in zip(self.starts.tolist(), sentences, own, strict=True):
            self.bits |= ((1 << len(x)) - 1) << start
            self.first |= 1 << start
            for c_, places in letters.items():
                self.places[c_] = self.places.get(c_, 0) | places << start

    @staticmethod
    def letters(sentence: str) -> dict[str, int]:
        """Places of each letter as bits."""
        own: dict[str, int] = {}
        for i, c_ in enumerate(sentence):
            own[c_] = own.get(c_, 0) | 1 << i
        return own

    def _ones(self, x: int) -> np.ndarray:
        flags = np.unpackbits(np.frombuffer(x.to_bytes(self.length // 8 + 1, "little"), np.uint8), bitorder="little")
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[self.starts + self.sizes] - total[self.starts]

    def distances(self, text: str) -> np.ndarray:
        bits, up, down = self.bits, self.bits, 0
        for c_ in text:
            equal = self.places.get(c_, 0)
            diagonal = ((((equal & up) + up) ^ up) | equal | down) & bits
            right = (((down | (bits ^ (diagonal | up))) << 1) & bits) | self.first
            left = ((diagonal & up) << 1) & bits
            up, down = left | (bits ^ (diagonal | right)), right & diagonal
        return len(text) + self._ones(up) - self._ones(down)


def _against_volumes(left: DataFrame, right: DataFrame, a: str, b: str, volume: int, start, schema: str) -> DataFrame:
    """Distinct texts ``a`` set against volumes of the distinct sentences ``b``, the smaller table: one volume at a time
    goes to every task, where ``start(sentences)`` gives a function from a text to its rows (sentence, ...)."""
    known = right.select(b).where(F.length(b) > 0).distinct()
    parts = max(1, -(-known.count() // volume))
    texts, found = left.select(a).where(F.length(a) > 0).distinct(), None
    for part in range(parts):
        words = [r[0] for r in known.where(F.pmod(F.xxhash64(b), F.lit(parts)) == part).collect()]
        handed = left.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pd.DataFrame], handed=handed) -> Iterator[pd.DataFrame]:
            look = start(sorted(handed.value))
            for batch in batches:
                yield pd.DataFrame([(t, *row) for t in batch[a].tolist() for row in look(t)], columns=[x.split()[0].strip("`") for x in schema.split(", ")])

        one = texts.mapInPandas(run, schema)
        found = one if found is None else found.unionByName(one)
    return found


#: Classes of letters that are counted; several letters may share one.
BAGS = 64


def _bag(text: str) -> np.ndarray:
    """Letters of each class."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % BAGS, minlength=BAGS).astype(np.int32)


def close_sentences(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float, *, volume: int = 20_000) -> DataFrame:
    """(a, b, edits): all pairs whose edit ratio reaches ``cutoff``. A text is set against the sentences that its length
    and its letters allow: an edit changes the length by one at most, and adds and takes one letter at most."""

    def start(sentences: list[str]):
        own, sizes = [SideBySide.letters(x) for x in sentences], np.array([len(x) for x in sentences], np.int64)
        bags = np.array([_bag(x) for x in sentences], np.int32).reshape(-1, BAGS)

        def look(text: str) -> list[tuple[str, int]]:
            allowed = np.floor(np.maximum(sizes, len(text)) * (1 - cutoff) + 1e-9)
            near = np.flatnonzero(np.abs(sizes - len(text)) <= allowed)
            if not len(near):
                return []
            apart = bags[near] - _bag(text)
            near = near[np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1)) <= allowed[near]]
            if not len(near):
                return []
            edits = SideBySide([sentences[i] for i in near], [own[i] for i in near]).distances(text)
            return [(sentences[i], int(e)) for i, e in zip(near, edits, strict=True) if e <= allowed[i]]

        return look

    return _against_volumes(left, right, a, b, volume, start, f"`{a}` string, `{b}` string, edits int")


def sentences_holding(left: DataFrame, right: DataFrame, a: str, b: str, *, volume: int = 20_000) -> DataFrame:
    """(a, b): all pairs where the text ``a`` stands inside the sentence ``b``. The sentences of a volume are searched
    as one string, which few texts are in."""

    def start(sentences: list[str]):
        every = "\0".join(sentences)
        ends = np.cumsum([len(x) + 1 for x in sentences])

        def look(text: str) -> list[tuple[str]]:
            if "\0" in text:
                return [(x,) for x in sentences if text in x]
            rows, at = [], every.find(text)
            while at >= 0:
                i = int(np.searchsorted(ends, at, side="right"))
                rows.append((sentences[i],))
                at = every.find(text, int(ends[i]))
            return rows

        return look

    return _against_volumes(left, right, a, b, volume, start, f"`{a}` string, `{b}` string")


def _shared_token_pairs(m: DataFrame, s: DataFrame, least: float) -> DataFrame:
    """(mid, sid) of token sets (mid, mset) and (sid, sset) whose F1 may reach ``least``: they share one of each
    other's rarest tokens, so frequent tokens never carry a join."""
    every = m.select(F.explode("mset").alias("__t")).unionByName(s.select(F.explode("sset").alias("__t")))
    freq = every.groupBy("__t").agg(F.count("*").alias("__df"))
    alpha = least / (2 - least)

    def rare(df: DataFrame, ident: str, tokens: str) -> DataFrame:
        toks = df.select(ident, F.size(tokens).alias("__n"), F.explode(tokens).alias("__t")).join(freq, "__t")
        lists = toks.groupBy(ident, "__n").agg(F.array_sort(F.collect_list(F.struct("__df", "__t"))).alias("__o"))
        keep = F.col("__n") - F.ceil(F.col("__n") * alpha - 1e-9) + 1
        return lists.select(ident, F.explode(F.slice("__o", 1, F.greatest(keep, F.lit(1)).cast("int"))).alias("__x")).select(ident, F.col("__x.__t").alias("__t"))

    return rare(m, "mid", "mset").join(rare(s, "sid", "sset"), "__t").select("mid", "sid").distinct()


def nearest_seed(messages: DataFrame, seeds: DataFrame, keys: Sequence[str], text: str, label: str, seed: str, *,
                 threshold: float = 0.55, exact_ratio: bool = False) -> DataFrame:
    """Label of the lexically nearest seed: equal .96, one inside the other .88, else the larger of token F1 and .82
    times the edit ratio (``exact_ratio``: matching blocks).

    Distinct texts meet by shared rare tokens, by containment (an automaton of the seeds over the messages, a search of
    the seeds the other way) and by edit distance within the bound; scores run on those pairs only. Digests stand for texts.
    """
    cutoff = threshold / RATIO_WEIGHT
    own = messages.select(*keys, one_space(F.lower(F.col(text))).alias("mt"))
    m = own.select("mt").where("mt <> ''").distinct().select(F.md5("mt").alias("mid"), "mt", F.array_distinct(F.split("mt", " ")).alias("mset"))
    m = written(m, "seed-messages")  # read by every kind of meeting
    named = seeds.select(F.col(label).alias("label"), one_space(F.lower(F.col(seed))).alias("st")).where("st <> ''")
    s = named.select("st").distinct().select(F.md5("st").alias("sid"), "st", F.array_distinct(F.split("st", " ")).alias("sset"))
    s = written(s, "seed-sentences")
    pairs = _shared_token_pairs(m, s, threshold)
    pairs = pairs.unionByName(names_in_texts(m, ["mid"], "mt", s, "st").select("mid", F.md5("st").alias("sid")))
    pairs = pairs.unionByName(sentences_holding(m, s, "mt", "st").select(F.md5("mt").alias("mid"), F.md5("st").alias("sid"))).withColumns({"close": F.lit(False), "edits": F.lit(None).cast("int")})
    if cutoff <= 1:
        close = sentence_candidates(m, s, "mt", "st", cutoff).withColumn("edits", F.lit(None).cast("int")) if exact_ratio else close_sentences(m, s, "mt", "st", cutoff)
        pairs = pairs.unionByName(close.select(F.md5("mt").alias("mid"), F.md5("st").alias("sid"), F.lit(True).alias("close"), "edits"))
    full = pairs.groupBy("mid", "sid").agg(F.max("close").alias("close"), F.max("edits").alias("edits")).join(m, "mid").join(s, "sid")
    ratio = sequence_ratio("mt", "st") if exact_ratio else 1 - F.col("edits") / F.greatest(F.length("mt"), F.length("st"))
    f1 = 2 * F.size(F.array_intersect("mset", "sset")) / (F.size("mset") + F.size("sset"))
    score = (F.when(F.col("mt") == F.col("st"), 0.96).when(F.col("mt").contains(F.col("st")) | F.col("st").contains(F.col("mt")), 0.88)
             .otherwise(F.greatest(f1, RATIO_WEIGHT * F.when(F.col("close"), ratio).otherwise(0.0))))
    # the threshold comes after the aggregate, so that no score is worked out twice
    scored = full.select("mt", "st", score.alias("__sc")).join(named, "st")
    best = scored.groupBy("mt").agg(F.max(F.struct("__sc", "label")).alias("__b")).where(F.col("__b.__sc") >= threshold)
    return own.join(best, "mt", "left").select(
        *keys, F.coalesce(F.col("__b.label").cast("string"), F.lit("unknown")).alias("predicted"), F.round(F.coalesce("__b.__sc", F.lit(0.0)), 4).alias("score"))


# --- hints and mentions --------------------------------------------------------------------------------

def side_effect_hint(item: str | Column, symptom: str | Column, raw: str | Column,
                     hints: Sequence[tuple[str, str]] = v.SIDE_EFFECT_HINTS) -> Column:
    """Struct (item, symptom, confidence) of the first hint: resolved name .95, name in the raw text .90."""
    i, s, r = F.lower(c(item)), F.lower(c(symptom)), F.lower(c(raw))
    def row(drug, sym, conf):
        return F.struct(F.lit(drug).alias("item"), F.lit(sym).alias("symptom"), F.lit(conf).alias("confidence"))
    def syn(sym):
        return v.SYMPTOM_SYNONYMS.get(sym, (sym,))
    return first_match([((i == d) & has_text(s, syn(x)), row(d, x, 0.95)) for d, x in hints]
                       + [(r.contains(d) & has_text(r, syn(x)), row(d, x, 0.90)) for d, x in hints])


def mentioned_item(messages: DataFrame, items: DataFrame, keys: Sequence[str], entity: str, item: str, text: str) -> DataFrame:
    """(keys, matched_item): the entity's active item that is named inside the message, the longest name first.

    An entity with a single item needs no mention. An automaton over all item names reads the whole texts; what it
    finds meets the entity's own items by equality.
    """
    held = items.select(F.col(entity), F.lower(F.trim(F.col(item))).alias("__item")).where("__item <> ''").distinct()
    found = names_in_texts(messages, [*keys, entity], text, held, "__item").join(held, [entity, "__item"], "left_semi")
    best = found.groupBy(*keys).agg(F.min(F.struct(F.negative(F.length("__item")).alias("n"), "__item")).alias("__hit"))
    single = held.groupBy(entity).agg(F.count("*").alias("__n"), F.min("__item").alias("__only")).where("__n = 1").select(entity, "__only")
    return messages.select(*keys, entity).join(best, list(keys), "left").join(single, entity, "left").select(
        *keys, F.coalesce("__hit.__item", "__only").alias("matched_item"))
