"""How far the sources of a language differ in their words, counted exactly over a kept vocabulary.

A language keeps the terms that stand in enough of its documents. Sorted, they are built into minimal acyclic
transducers: one for each volume, a stretch of the vocabulary between two heads (first eight bytes). Text is then
streamed through them: each word is routed to its volume by its head, walked byte by byte, and leaves an ordinal, its
place in the language's vocabulary. Counts, ties and blocks of the comparison use ordinals only.

Volumes are built in tasks and handed out again in passes of bounded size, so no vocabulary is too large; a usual one
takes one pass. Pairs of sources are compared in blocks of ordinals and tiles of sources, each of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, transducer

# Fixed values of the audit.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, SMOOTH = 1_000_000_000, 5
#: Terms after which a volume ends at the next change of head.
VOLUME_TERMS = 200_000
#: Bytes of transducers that one pass over the text carries.
PASS_BYTES = 64_000_000
#: Distinct (group, ordinal) counts that a task holds before it sends them on.
HELD = 2_000_000
BLOCK, TILE = 4096, 256
HEAD = 8
INSIDE = np.ones(256, bool)
INSIDE[:128] = False
INSIDE[65:91] = INSIDE[97:123] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms that stand in at least ``least`` documents (lang, text) of their language."""
    found = F.array_distinct(F.regexp_extract_all(common.lower_ascii(F.col("text")), F.lit(TERM), F.lit(0)))
    return docs.select("lang", F.explode(found).alias("term")).groupBy("lang", "term").count().where(F.col("count") >= least).select("lang", "term")


def _head(term: bytes) -> int:
    return int.from_bytes(term[:HEAD].ljust(HEAD, b"\0"), "big")


def vocabulary(kept: DataFrame, volume_terms: int = VOLUME_TERMS) -> DataFrame:
    """One row per term (lang, head, rank, term) and one per volume (lang, head, terms and its arrays, no term).

    ``head`` is the volume's first head as a hexadecimal string, ``rank`` counts from 0 inside the volume. Terms of
    one head are never split, so a word's head alone says which volume it can be in.
    """

    def volume(lang: str, terms: list[bytes]) -> Iterator[pa.RecordBatch]:
        made = transducer.build(terms)
        head = f"{_head(terms[0]):016x}"
        for at in range(0, len(terms), 10_000):
            part = terms[at:at + 10_000]
            yield rows(lang, head, list(range(at, at + len(part))), [t.decode() for t in part], None)
        yield rows(lang, head, [len(terms)], [None], made)

    def rows(lang, head, ranks, terms, made) -> pa.RecordBatch:
        blobs = [pa.array([None if made is None else getattr(made, c).astype(t).tobytes()] * len(ranks), pa.binary()) for c, t in ARRAYS]
        root = pa.array([None if made is None else made.root] * len(ranks), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(ranks)), pa.array([head] * len(ranks)), pa.array(ranks, pa.int64()), pa.array(terms, pa.string()), *blobs, root],
                                          ["lang", "head", "rank", "term", *[c for c, _ in ARRAYS], "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                term = text.encode()
                if terms and (own != lang or len(terms) >= volume_terms and term[:HEAD] != terms[-1][:HEAD]):
                    yield from volume(lang, terms)
                    terms = []
                lang = own
                terms.append(term)
        if terms:
            yield from volume(lang, terms)

    head = F.substring(F.col("term").cast("binary"), 1, HEAD)
    ordered = kept.withColumn("first", head).repartitionByRange("lang", "first").sortWithinPartitions("lang", "term").select("lang", "term")
    return ordered.mapInArrow(run, "lang string, head string, rank long, term string, keys binary, targets binary, outputs binary, finals binary, root long")


#: Arrays of a stored transducer and their types.
ARRAYS = (("keys", "<i8"), ("targets", "<i8"), ("outputs", "<i8"), ("finals", "?"))


def _passes(volumes: DataFrame, pass_bytes: int) -> list[list[tuple[str, str]]]:
    """Volumes (lang, head) dealt to passes of at most ``pass_bytes``, or of one volume."""
    size = sum((F.length(c) for c, _ in ARRAYS), F.lit(0))
    out: list[list[tuple[str, str]]] = []
    room = 0
    for r in volumes.select("lang", "head", size.alias("size")).orderBy("lang", "head").collect():
        if r.size > room:
            out.append([])
            room = pass_bytes
        out[-1].append((r.lang, r.head))
        room -= r.size
    return out


def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First eight bytes of each word as a big-endian number."""
    padded = np.append(data, np.zeros(HEAD, np.uint8))
    out = np.zeros(len(starts), np.uint64)
    for k in range(HEAD):
        out = (out << np.uint64(8)) | np.where(starts + k < ends, padded[starts + k], 0).astype(np.uint64)
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of terms in rows of text, and the row of each."""
    inside = INSIDE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _recount(docs: DataFrame, volumes: list) -> DataFrame:
    """(lang, source, ordinal, n) of the words of (lang, source, text) that are in ``volumes``, partly summed."""
    load = [transducer.Transducer(*[np.frombuffer(v[c], t) for c, t in ARRAYS], v["root"], v["rank"]) for v in volumes]
    table, roots = transducer.joined(load)
    by_lang: dict[str, tuple[np.ndarray, ...]] = {}
    for lang in {v["lang"] for v in volumes}:
        own = [i for i, v in enumerate(volumes) if v["lang"] == lang]
        by_lang[lang] = (np.array([int(volumes[i]["head"], 16) for i in own], np.uint64), roots[own], np.array([volumes[i]["before"] for i in own], np.int64))
    handed = docs.sparkSession.sparkContext.broadcast((table, by_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, by_lang = handed.value
        groups: dict[tuple[str, str], int] = {}
        key, count, fresh, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge() -> None:
            nonlocal key, count, fresh, waiting
            both = np.concatenate([key, *fresh])
            weight = np.concatenate([count, np.ones(len(both) - len(key), np.int64)])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], weight[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            key, count, fresh, waiting = both[first], np.add.reduceat(weight, first) if len(first) else weight, [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal key, count
            merge()
            names = list(groups)
            langs, sources = pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string())
            for at in range(0, len(key), 50_000):
                part = key[at:at + 50_000]
                which = pa.array(part >> 40)
                yield pa.RecordBatch.from_arrays([langs.take(which), sources.take(which), pa.array(part & ((1 << 40) - 1)), pa.array(count[at:at + 50_000])], ["lang", "source", "ordinal", "n"])
            key, count = key[:0], count[:0]
            groups.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], np.int64)
            member: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                if lang in by_lang:
                    member.setdefault(lang, []).append(i)
            code = np.full(len(langs), -1, np.int64)
            for k, rows in enumerate(member.values()):
                code[rows] = k
            for i, _, data, offsets in common.text_steps(batch, "text"):
                data = LOWERED[data]
                starts, ends, row = _words(data, offsets)
                row = row + i
                heads = _heads(data, starts, ends)
                for k, lang in enumerate(member):
                    pick = np.flatnonzero(code[row] == k)
                    first, root, before = by_lang[lang]
                    volume = np.searchsorted(first, heads[pick], side="right") - 1
                    pick, volume = pick[volume >= 0], volume[volume >= 0]
                    place = transducer.ordinals(table, data, starts[pick], ends[pick], root[volume])
                    good = place >= 0
                    fresh.append((own[row[pick[good]]] << 40) | (place[good] + before[volume[good]]))
                    waiting += len(fresh[-1])
                if waiting > HELD:
                    merge()
                    if len(key) > HELD:
                        yield from send()
                        own = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], np.int64)
        yield from send()

    return common.lean(docs).select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal long, n long")


def counted_terms(docs: DataFrame, least: int = 30, volume_terms: int = VOLUME_TERMS, pass_bytes: int = PASS_BYTES) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, ordinal, n) of kept terms in documents (lang, source, text), and the terms (lang, ordinal, term), both stored."""
    built = common.stored(vocabulary(kept_terms(docs, least), volume_terms), "audit-vocabulary")
    volumes = built.where("term IS NULL")
    offsets = volumes.select("lang", "head", (F.sum("rank").over(Window.partitionBy("lang").orderBy("head")) - F.col("rank")).alias("before"))
    terms = built.where("term IS NOT NULL").join(offsets, ["lang", "head"]).select("lang", (F.col("before") + F.col("rank")).alias("ordinal"), "term")
    passes = _passes(volumes, pass_bytes)
    counts = None
    for some in passes:
        langs, heads = sorted({lang for lang, _ in some}), sorted({head for _, head in some})
        rows = volumes.where(F.col("lang").isin(langs) & F.col("head").isin(heads)).join(offsets, ["lang", "head"]).collect()
        part = _recount(docs, sorted((r for r in rows if (r["lang"], r["head"]) in set(some)), key=lambda r: (r["lang"], r["head"])))
        counts = part if counts is None else counts.union(part)
    if counts is None:
        counts = docs.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")
    return common.stored(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "audit-counts"), common.stored(terms, "audit-terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH terms)), exact."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = F.lit(UNIT).cast("decimal(10,0)") * wide(count + SMOOTH, 19)
    below = wide(total + SMOOTH * terms, 19)
    return F.lit(1) + F.call_function("div", above, below)


def _distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, f): sum of |p - q| over the kept terms of two group numbers a < b.

    ``groups``: lang, number, terms, zero (share of an absent term); ``shares``: lang, number, ordinal, p.
    """
    blocks = shares.groupBy("lang", "number", F.floor(F.col("ordinal") / BLOCK).alias("block")).agg(
        F.collect_list(F.struct((F.col("ordinal") % BLOCK).cast("int").alias("at"), "p")).alias("cells"))
    most = groups.groupBy("lang").agg((F.floor((F.max("number") - 1) / TILE)).cast("int").alias("tiles"))
    every = groups.where("terms > 0").join(most, "lang").select(
        "lang", "number", "zero", "terms", "tiles", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / BLOCK))).alias("block"))
    tile = F.floor((F.col("number") - 1) / TILE).cast("int")
    dealt = every.join(blocks, ["lang", "number", "block"], "left").select(
        "lang", "block", tile.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles"))).alias("other"), "number", "zero", F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).alias("wide"),
        F.col("cells.at").alias("at"), F.col("cells.p").alias("p"))
    dealt = dealt.select("lang", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "number", "zero", "wide", "at", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in common.sorted_groups(batches, 4):
            number, own, wide = np.asarray(group["number"]), np.asarray(group["own"]), group["wide"][0].as_py()
            shares = np.repeat(np.asarray(group["zero"])[:, None], wide, axis=1)
            for i, (at, p) in enumerate(zip(group["at"], group["p"], strict=True)):
                if at.is_valid:
                    shares[i, np.asarray(at.values)] = np.asarray(p.values)
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            for i in np.flatnonzero(own == low):
                other = np.flatnonzero((own == high) & (number > number[i]))
                if len(other):
                    f = np.abs(shares[other] - shares[i]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([group["lang"][0].as_py()] * len(other)), pa.array(np.full(len(other), number[i])), pa.array(number[other]), pa.array(f)], ["lang", "a", "b", "f"])

    keys = ["lang", "block", "low", "high"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "lang string, a int, b int, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, least: int = 30, top: int = 50, volume_terms: int = VOLUME_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's words differ from those of the other sources and of its language.

    Part ``pair``: the summed difference to each other source; part ``term``: the ``top`` terms that stand out against
    the language. Null text, lang and source are ''. A language without kept terms has pairs of value 0. Every row is a
    document, repeated ones too; ids and other columns are not read; empty tables give an empty result. The pairs of a
    language are as many as the result has rows, not more.
    """
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts, terms = counted_terms(text, least, volume_terms, pass_bytes)
    kept = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = text.select("lang", "source").distinct().join(kept, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"]).withColumn("number", number)
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    groups = common.stored(groups.withColumn("zero", zero), "audit-groups")

    own = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    sums = _distances(groups, own.select("lang", "number", "ordinal", "p"))
    names = groups.select("lang", "source", "number")
    ends = names.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    pairs = names.join(ends, "lang").where("number <> other").select("lang", "source", "item", F.least("number", "other").alias("a"), F.greatest("number", "other").alias("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    language = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("m"))
    standing = own.join(language, ["lang", "ordinal"]).join(whole, "lang").withColumn("value", F.col("p") - share(F.col("m"), F.col("all"), F.col("terms"))).where("value > 0")
    best = standing.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    found = best.join(terms, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(found)
