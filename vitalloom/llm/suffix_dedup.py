"""Removal of byte strings that occur more than once in the corpus.

A string of ``length`` bytes counts as repeated if it also starts anywhere else. Which starts are repeated is decided
in three steps:

1. Every start is given to an anchor: the least ``GRAM``-byte gram of its string, by hash. Equal strings have equal
   anchors at equal places, so only anchors that occur twice go on. The starts of one anchor place, with the bytes
   that their strings cover, are its context.
2. Contexts that occur twice are repeated as a whole.
3. Contexts of one anchor that differ go to a task together, each different one once. There a Burrows-Wheeler
   transform of the contexts is extended backward, breadth first: intervals of a common prefix give intervals of
   prefixes longer by one byte, and each boundary gets its common prefix length when it is met first, by increasing
   value. The expansion stops at ``length``; neighbours without a value by then share that many bytes.

Anchors with more different contexts than ``GROUP`` are not gathered: their single strings are counted by hash.
A text is shuffled once: both joins with texts read the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 48
#: Different contexts of one anchor that are gathered at most, and bytes that one transform takes.
GROUP, BATCH_BYTES = 4096, 1_500_000
NO_ID = -(2**63)


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor place, anchor hash, prefix hashes): runs of starts with one anchor, places in ``data``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    prefix = common.prefix_hash(data)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), prefix
    at = np.arange(n - GRAM + 1)
    grams = common.span_hash(prefix, at, at + GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, done = length - GRAM + 1, 1
    while done < width:  # least key of the next ``done`` places, doubled
        step = min(done, width - done)
        low = np.minimum(low[:len(low) - step], low[step:])
        done += step
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    starts = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64), prefix
    place, row = place[starts], row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return row[first], starts[first], starts[last], place[first], grams[place[first]], prefix


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return common.lean(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def anchors(texts: DataFrame, length: int, whole: bool) -> DataFrame:
    """Anchor places of all texts: (anchor) alone, or with (context, id, digest, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in common.text_steps(batch, "text"):
                row, first, last, place, gram, prefix = anchored_runs(data, offsets, length)
                if not len(row):
                    continue
                out = [pa.array(gram.astype(np.int64))]
                if whole:
                    context = common.mix(common.span_hash(prefix, first, last + length) + (place - first).astype(np.uint64) * common.PART_VALUE[1])
                    rows = pa.array(row + i)
                    out += [pa.array(context.astype(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                            pa.array((first - offsets[row]).astype(np.int32)), pa.array((last - offsets[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, ["anchor", "context", "id", "digest", "first", "last"][:len(out)])

    return texts.mapInArrow(run, "anchor long" + ", context long, id long, digest long, first int, last int" * whole)


# ---------------------------------------------------------------------------------------------------------------------
# One transform


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of whole numbers below 2**21, by prefix doubling; no two suffixes may be equal."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for j in range(3):
        part = np.zeros(n, np.int64)
        part[:n - j] = symbols[j:] + 1
        key = (key << 21) | part
    order = np.argsort(key, kind="stable")
    step = 3
    while True:
        sorted_key = key[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is named by its first place
        rank = np.empty(n, np.int64)
        rank[order] = group
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order, rank
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        some = order[at]  # only places that are still tied move, inside their groups
        order[at] = some[np.argsort(key[some], kind="stable")]
        step *= 2


def repeated_starts(symbols: np.ndarray, length: int) -> np.ndarray:
    """Mask of places whose next ``length`` symbols occur at another place too."""
    n = len(symbols)
    order, rank = suffix_order(symbols)
    back = rank[order - 1]  # place of the suffix with the symbol before
    forward = rank[(order + 1) % n]
    head = symbols[order]
    # next and previous place in the transform with the same symbol
    up, down = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = np.flatnonzero(head[1:] == head[:-1])
    up[forward[same]] = forward[same + 1]
    down[forward[same + 1]] = forward[same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(length):
        if not len(low):
            break
        size = high - low + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        last = at[up[at] > np.repeat(high, size)]
        first = at[down[at] < np.repeat(low, size)]
        high, low = np.sort(back[last]), np.sort(back[first])
        fresh = ~known[high + 1]
        known[high[fresh] + 1] = True
        low, high = low[fresh], high[fresh]
    out = np.zeros(n, bool)
    far = ~known
    out[order] = far[:-1] | far[1:]
    return out


def _resolve(rows: list[dict], length: int) -> list[tuple[int, int, int, int]]:
    """(id, digest, start, end) of repeated bytes in the contexts that occur once."""
    parts, borders, at = [], [], 0
    for r in rows:
        borders.append(at)
        parts += [np.frombuffer(r["bytes"], np.uint8).astype(np.int64) + len(rows), np.array([len(parts) // 2])]
        at += len(r["bytes"]) + 1
    mask = repeated_starts(np.concatenate(parts), length)
    out = []
    for r, a in zip(rows, borders, strict=True):
        if r["n"] == 1:
            hit = np.flatnonzero(mask[a:a + len(r["bytes"])])
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for s, e in zip(hit[np.concatenate([[0], cut + 1])].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True):
                    out.append((r["id"], r["digest"], r["first"] + s, r["first"] + e + length))
    return out


SPAN = "id long, digest long, start int, end int"


def _spans(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["id", "digest", "start", "end"])


def gathered(contexts: DataFrame, length: int) -> DataFrame:
    """Spans (id, digest, start, end) decided by transforms of whole anchor groups."""

    def run(batches):
        rows, size = [], 0
        for group in common.sorted_groups(batches, 1):
            rows += group.to_pylist()
            size += sum(map(len, group["bytes"].to_pylist()))
            if size >= BATCH_BYTES:
                yield _spans(_resolve(rows, length))
                rows, size = [], 0
        if rows:
            yield _spans(_resolve(rows, length))

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def counted(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of anchors with very many contexts: each string is counted by its hash, nothing is gathered."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                at = np.arange(len(data) - length + 1)
                h = common.span_hash(common.prefix_hash(data), at, at + length).astype(np.int64)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, r["anchor"])), pa.array(h), pa.array(np.full(k, min(r["n"], 2), np.int32)), pa.array(np.full(k, r["id"])), pa.array(np.full(k, r["digest"])),
                                                  pa.array((at + r["first"]).astype(np.int32))], ["anchor", "string", "n", "id", "digest", "start"])

    strings = contexts.mapInArrow(run, "anchor long, string long, n int, id long, digest long, start int")
    twice = strings.groupBy("anchor", "string").agg(F.sum("n").alias("all")).where("all > 1").select("anchor", "string")
    return strings.where("n = 1").join(twice, ["anchor", "string"]).select("id", "digest", "start", (F.col("start") + length).alias("end"))


def deduplicate(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs``.

    ``spans`` are the maximal removed runs (start, end) in bytes of the UTF-8 text, ``kept`` the remaining bytes.
    A null text is empty. Repeated rows are copies of each other, so all their strings of ``length`` bytes go;
    null ids are allowed; ids are whole numbers. Other columns are not read.
    """
    texts = _texts(docs, id_col, text_col)
    # written, so that Spark can split an anchor that very many places have
    often = common.stored(anchors(texts, length, False).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "suffix-often")
    places = common.stored(anchors(texts, length, True).join(often, "anchor"), "suffix-anchors")
    one = F.min(F.struct("id", "digest", "first", "last")).alias("one")
    kinds = common.stored(places.groupBy("anchor", "context").agg(F.count("*").alias("n"), one), "suffix-contexts")
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("anchor", (F.col("m") > GROUP).alias("many"))
    needed = kinds.join(open_, "anchor").select("one.*", "anchor", "n", "many").groupBy("id", "digest").agg(
        F.collect_list(F.struct("anchor", "first", "last", "n", "many")).alias("contexts"))
    dealt = texts.repartition("id", "digest")

    def cut(batches):
        names = ["anchor", "n", "many", "id", "digest", "first", "bytes"]
        for batch in batches:
            for at in range(batch.num_rows):
                key, text = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py()), batch.column(2)[at].as_py().encode()
                rows = [(c["anchor"], c["n"], c["many"], *key, c["first"], text[c["first"]:c["last"] + length]) for c in batch.column(3)[at].as_py()]
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    contexts = dealt.join(needed, ["id", "digest"]).select("id", "digest", "text", "contexts").mapInArrow(cut, "anchor long, n long, many boolean, id long, digest long, first int, bytes binary")
    contexts = common.stored(contexts, "suffix-bytes")
    whole = places.join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select("id", "digest", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    spans = common.stored(whole.union(gathered(contexts.where("NOT many").drop("many"), length)).union(counted(contexts.where("many").drop("many"), length))
                          .groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "suffix-spans")

    def remove(batches):
        for batch in batches:
            for i, j, data, offsets in common.text_steps(batch, "text"):
                spans, kept = [], []
                for row in range(j - i):
                    a, b = offsets[row], offsets[row + 1]
                    runs: list[list[int]] = []
                    for s in batch.column(1)[i + row].as_py() or []:
                        if runs and s["start"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s["end"])
                        else:
                            runs.append([s["start"], s["end"]])
                    edges = [0, *[x for r in runs for x in r], int(b - a)]
                    text = data[a:b].tobytes()
                    kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": x, "end": y} for x, y in runs])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = texts.join(spans, ["id", "digest"], "left").select("id", "spans", "text").mapInArrow(remove, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "spans", "kept")
