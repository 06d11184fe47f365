"""Document and message text: normalising, cleaning, typing, cutting, merging."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as p
from ..functions import vocabulary as v
from ..functions.core import c, first_match, has_word, substring_pattern
from ..functions.text import let, literal_map, nfkc, one_space, replace_phrases, squeeze_runs, token_map


def normalize(text: str | Column, *, compatibility: bool = True) -> Column:
    """Lower, squeeze, strip punctuation, repair phrases and tokens; letterless text is empty.

    ``compatibility`` adds the Unicode step, the only part Spark has no built-in for.
    """
    raw = nfkc(c(text)) if compatibility else c(text)
    cleaned = one_space(F.regexp_replace(squeeze_runs(F.lower(raw)), r"[^\p{L}\p{M}\p{N}_\s]", " "))
    phrases = {k: t for k, t in v.ALIASES.items() if " " in k}
    words = {k: t for k, t in v.ALIASES.items() if " " not in k}
    first = {**{k: v.TOKEN_REPAIRS.get(t, t) for k, t in v.SHORTHAND.items()},
             **{k: t for k, t in v.TOKEN_REPAIRS.items() if k not in v.SHORTHAND}}
    step = replace_phrases(replace_phrases(cleaned, v.PHRASE_REPAIRS), phrases)
    step = token_map(step, first)
    step = token_map(step, words, keep_after=v.NEGATORS, keep_tokens=v.NEGATED_TOKENS)
    step = replace_phrases(replace_phrases(step, v.SPLIT_REPAIRS), v.PHRASE_REPAIRS)
    return F.coalesce(F.when(step.rlike("[a-z]"), step), F.lit(""))


def clean_spoken(text: str | Column, fillers: Sequence[str] = v.FILLERS) -> Column:
    """Drop fillers, collapse repeated words, keep word characters and : / . - only."""
    t = F.lower(c(text))
    for filler in fillers:
        t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}_]){filler}(?![\p{{L}}\p{{N}}_])", " ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]+)(\s+\1(?![\p{L}\p{N}_]))+", "$1")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_\s:/.-]", " "))


FORMS_TO_STRIP = ("tab", "tablet", "cap", "capsule", "inj", "syrup", "fab", "pab")  # fixed values


def strip_item_name(name: str | Column) -> Column:
    t = F.lower(F.trim(c(name)))
    t = F.regexp_replace(t, r"\b(?:" + "|".join(FORMS_TO_STRIP) + r")\.?\s+", "")
    t = F.regexp_replace(t, r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|units?)\b", "")
    return one_space(F.regexp_replace(t, "[^a-z0-9+ ]+", " "))


def normalize_item(name: str | Column, aliases: Mapping[str, str] = v.ITEM_ALIASES) -> Column:
    """Item name without form and dose; exact alias, else the first alias it contains."""
    def resolve(t: Column) -> Column:
        exact = F.try_element_at(literal_map(aliases), t)
        contained = first_match([(t.contains(a), to) for a, to in aliases.items()])
        return F.coalesce(exact, contained, t)
    return F.coalesce(let(strip_item_name(name), resolve), F.lit(""))


def components(name: str | Column, aliases: Mapping[str, str] = v.ITEM_ALIASES) -> Column:
    """Component list: split first, then each part normalised, so it is stable when applied again."""
    parts = F.filter(F.split(F.replace(normalize_item(name, aliases), F.lit("/"), F.lit("+")), r"\+"), lambda x: F.trim(x) != "")
    exact = literal_map(aliases)
    return F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.try_element_at(exact, F.trim(p)), F.trim(p))))


def split_components(name: str | Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(c(name)), "[/+]"), lambda x: F.trim(x)), lambda x: x != "")


def canonical_lab(name: str | Column, aliases: Mapping[str, str] = v.ALL_LAB_ALIASES) -> Column:
    t = one_space(F.regexp_replace(F.lower(c(name)), "[^a-z0-9% ]+", " "))
    return F.coalesce(F.try_element_at(literal_map(aliases), t), F.replace(t, F.lit(" "), F.lit("_")))


# --- typing ----------------------------------------------------------------------

def type_words(kind: str, table: Mapping[str, Sequence[str]] = v.TYPE_WORDS) -> list[str]:
    """Distinct words and phrases of a type, in lower case."""
    return sorted({w.lower() for w in table[kind]})


def held_counts(text: str | Column, table: Mapping[str, Sequence[str]] = v.TYPE_WORDS) -> Column:
    """How many distinct words and phrases of each type a lower-case text holds, in the table's order: one pass for all words."""
    kinds: dict[str, list[int]] = {}
    for n, k in enumerate(table):
        for w in type_words(k, table):
            kinds.setdefault(w, []).append(n)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count(texts: pa.Array) -> pa.Array:
        import ahocorasick
        made = ahocorasick.Automaton()
        for w, ns in kinds.items():
            made.add_word(w, (w, ns))
        made.make_automaton()
        out: list[list[int] | None] = []
        for t in texts.to_pylist():
            counts = [0] * len(table)
            for ns in dict(hit for _, hit in made.iter(t or "")).values():
                for n in ns:
                    counts[n] += 1
            out.append(None if t is None else counts)
        return pa.array(out, pa.list_(pa.int32()))

    return count(c(text))


def document_type(df: DataFrame, text: str, *, table: Mapping[str, str] = v.TYPE_WORDS, vector_type: str | None = None,
                  vector_score: str | None = None, vector_floor: float = 0.70) -> DataFrame:
    """Type by the share of telling words; a good enough vector match goes first."""
    scored = df.withColumn("__held", held_counts(F.lower(text), table))
    best = F.array_max(F.array(*[F.struct(
        (F.get("__held", F.lit(n)) / float(max(3, min(len(type_words(k, table)), 8)))).alias("score"), F.lit(-n).alias("n"), F.lit(k).alias("kind"))
        for n, k in enumerate(table)]))
    scored = scored.withColumn("__best", best).drop("__held")
    kind, score, method = F.col("__best.kind"), F.col("__best.score"), F.lit("keyword")
    if vector_type:
        good = F.coalesce(F.col(vector_score) >= vector_floor, F.lit(False))
        kind, score = F.when(good, F.col(vector_type)).otherwise(kind), F.when(good, F.col(vector_score)).otherwise(score)
        method = F.when(good, "vector").otherwise("keyword")
    return scored.withColumns({"document_type": F.when(score > 0.1, kind).otherwise("unknown"),
                               "type_confidence": F.round(score, 2), "type_method": method}).drop("__best")


def two_class(text: str | Column) -> Column:
    """prescription / lab_report / general_note by summed evidence."""
    low = F.lower(c(text))
    def score(words, patterns):
        total = sum([low.contains(w).cast("int") for w in words], F.lit(0))
        return total + sum([F.when(low.rlike(p), n).otherwise(0) for p, n in patterns], F.lit(0))
    def decide(s: Column) -> Column:
        rx, lab = s["rx"], s["lab"]
        return (F.when((rx >= 3) & (rx > lab), "prescription").when((lab >= 3) & (lab >= rx), "lab_report")
                .otherwise("general_note"))
    return let(F.struct(score(v.RX_WORDS, v.RX_PATTERNS).alias("rx"), score(v.LAB_WORDS, v.LAB_PATTERNS).alias("lab")), decide)


def specialty(text: str | Column) -> Column:
    low = F.lower(c(text))
    return first_match([(has_word(low, words), name) for name, words in v.SPECIALTIES], "")


def symptom_needs_alert(kind: str | Column, details: str | Column) -> Column:
    return (F.lower(c(kind)) == "symptom") & F.lower(c(details)).rlike(substring_pattern(v.SYMPTOM_ALERT_WORDS))


# --- cleaning, cutting, merging ------------------------------------------------------

# Broken separators and their repair.
MOJIBAKE = (("\0", ""), ("â€“", "-"), ("â€”", "-"), ("–", "-"), ("—", "-"), ("Âµ", "µ"), ("Â°", "°"))


def cleaned(t: pa.Array) -> pa.Array:
    """:func:`clean_extracted` of an Arrow column."""
    t = pc.fill_null(t, "")
    for old, new in MOJIBAKE:
        t = pc.replace_substring(t, old, new)
    for pattern, new in ((r"(?i)\((TSH|T3|T4)\)", "$1"), (r"[ \t]{2,}|\t", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = p.replaced(t, pattern, new)
    return t


@F.arrow_udf(T.StringType())
def _cleaned(texts: pa.Array) -> pa.Array:
    return p.joined([cleaned(t) for t in p.steps(texts)], texts.type)


def clean_extracted(text: str | Column) -> Column:
    """Parser artefacts out, line breaks kept."""
    return _cleaned(c(text))


def word_tokens(text: str | Column) -> Column:
    return F.filter(F.split(F.lower(c(text)), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def best_pass(passes: DataFrame, keys: Sequence[str], text: str, confidence: str, ident: str) -> DataFrame:
    """Best reading of each key: most distinct tokens, then confidence."""
    ranked = passes.withColumn("__rank", F.struct(F.size(F.array_distinct(word_tokens(text))).alias("n"),
                                                  F.coalesce(F.col(confidence), F.lit(0.0)).alias("c"), F.col(ident).alias("i")))
    return ranked.groupBy(*keys).agg(F.max_by(F.struct(ident, text, confidence), "__rank").alias("__r")).select(*keys, "__r.*")


def truncate_keeping(text: str | Column, budget: int, keep: Sequence[str]) -> Column:
    """Lines with a keep-word first, then other words up to the budget: struct (text, truncated).

    Works inside the row: a text never leaves its task.
    """
    pattern = substring_pattern(keep)
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def cut(t: Column) -> Column:
        lines = F.split(t, "\n")
        kept = F.array_join(F.filter(lines, lambda x: F.lower(x).rlike(pattern)), "\n")
        other = F.array_join(F.filter(lines, lambda x: ~F.lower(x).rlike(pattern)), " ")

        def finish(s: Column) -> Column:
            n = F.size(words(s["kept"]))
            rest = F.array_join(F.slice(words(s["other"]), 1, F.greatest(F.lit(budget) - n, F.lit(0))), " ")
            joined = F.regexp_replace(F.concat(s["kept"], F.lit("\n"), rest), r"^\s+|\s+$", "")
            full = F.struct(F.substring(s["kept"], 1, budget * 5).alias("text"), F.lit(True).alias("truncated"))
            part = let(joined, lambda x: F.struct(x.alias("text"), (s["total"] > F.size(words(x))).alias("truncated")))
            return F.when(n >= budget, full).otherwise(part)

        return let(F.struct(kept.alias("kept"), other.alias("other"), F.size(words(t)).alias("total")), finish)

    return let(F.coalesce(c(text), F.lit("")), cut)


def is_cut(text: str | Column, budget: int, keep: Sequence[str]) -> Column:
    """``truncated`` of :func:`truncate_keeping` without the text: more words than the budget, or as many, all in lines
    with a keep-word. A split stops behind the budget, and only texts of just its size are searched for keep-words."""
    pattern = substring_pattern(keep)
    count = lambda s: F.size(F.filter(F.split(s, r"\s+", budget + 3), lambda w: w != ""))

    def cut(t: Column) -> Column:
        kept = F.array_join(F.filter(F.split(t, "\n"), lambda x: F.lower(x).rlike(pattern)), "\n")
        return let(count(t), lambda n: F.when(n == budget, count(kept) == budget).otherwise(n > budget))

    return let(F.coalesce(c(text), F.lit("")), cut)


def keep_words(kind: str | None = None) -> tuple[str, ...]:
    return v.KEEP_WORDS + v.KEEP_WORDS_BY_TYPE.get(kind or "", ())


def chunks(df: DataFrame, ident: str, text: str, size: int = 8000, overlap: int = 200) -> DataFrame:
    """Overlapping chunks that end at a line break, else at a sentence, when that fills 70 %.

    Each cut depends on the one before, so the cutting runs per text inside
    ``mapInPandas``; texts stay in their own partitions.
    """
    lap = max(0, min(overlap, size // 4))
    id_type = df.schema[ident].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, numbers, starts, parts = [], [], [], []
            for key, body in zip(batch[ident], batch[text].fillna("")):
                for n, (at, part) in enumerate(_cuts(body, size, lap)):
                    ids.append(key), numbers.append(n), starts.append(at), parts.append(part)
                    if len(ids) >= 2000:
                        yield pd.DataFrame({ident: ids, "chunk_no": numbers, "start": starts, "chunk": parts})
                        ids, numbers, starts, parts = [], [], [], []
            if ids:
                yield pd.DataFrame({ident: ids, "chunk_no": numbers, "start": starts, "chunk": parts})

    return df.select(ident, text).mapInPandas(cut, f"{ident} {id_type}, chunk_no int, start int, chunk string")


def _cuts(body: str, size: int, lap: int) -> Iterator[tuple[int, str]]:
    at = 0
    while True:
        stop = at + size
        if stop >= len(body):
            if body[at:] or at == 0:
                yield at, body[at:]
            return
        for mark in ("\n", ". "):
            found = body.rfind(mark, at, stop)
            if found != -1 and found - at >= 0.7 * size:
                stop = found
                break
        if stop > at:
            yield at, body[at:stop]
        at = max(stop - lap, at + 1)


def fixed_chunks(df: DataFrame, ident: str, text: str, size: int = 8000, overlap: int = 200) -> DataFrame:
    """Chunks at a fixed stride, by built-ins only."""
    stride = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / stride), F.lit(1)).cast("int")
    return df.select(ident, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no")).select(
        ident, "chunk_no", (F.col("chunk_no") * stride).alias("start"),
        F.substring(F.col(text), F.col("chunk_no") * stride + 1, F.lit(size)).alias("chunk"))


def merge_chunk_rows(rows: DataFrame, keys: Sequence[str], key_columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of all chunks of a document, the first of equal (name, value) kept; nameless rows go."""
    low = [F.lower(F.trim(F.col(k).cast("string"))).alias(f"__k{i}") for i, k in enumerate(key_columns)]
    keyed = rows.select("*", *low).where("__k0 <> ''")
    rest = [x for x in rows.columns if x not in keys]
    kept = keyed.groupBy(*keys, *[f"__k{i}" for i in range(len(low))]).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return kept.select(*keys, "__r.*")


# --- stable keys ------------------------------------------------------------------------

def pair_hash(a: str | Column, b: str | Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array(F.lower(c(a)), F.lower(c(b)))), ":"), 256)


def decision_hash(entity: str | Column, item: str | Column, held: str | Column, markers: str | Column) -> Column:
    """Key of a decision: entity, item, its sorted list of held items, and markers."""
    return F.sha2(F.concat_ws("|", c(entity).cast("string"), c(item), F.array_join(F.array_sort(c(held)), ","), c(markers)), 256)


def corpus_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One order-free digest of a table: whole row digests summed in five parts by their first byte, then hashed.

    Rows fold map-side to 256 sums, so the table is never gathered.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(x).cast("string") for x in columns]), 256)
    parts = [F.conv(F.substring(digest, 3 + 13 * i, 13), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(5)]
    sums = df.select(F.substring(digest, 1, 2).alias("k"), *parts).groupBy("k").agg(
        F.count("*").alias("n"), *[F.sum(f"p{i}").cast("string").alias(f"s{i}") for i in range(5)])
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", "n", *[f"s{i}" for i in range(5)]))), ","), 256)
                    .alias("corpus_hash"))
