"""Helpers of the language-data operators: stored tables, byte-wise word hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalloom.session import scratch

#: Bytes of text that one numpy step works on; a longer text is one step of its own.
STEP_BYTES = 1_000_000

BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(rows: DataFrame) -> DataFrame:
    """``rows``, with Arrow batches of 1,000 rows in its session unless the session sets its own number.

    Ten thousand long texts would fill a worker and the executor's buffers several times over.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH_KEY) == "10000":
        conf.set(BATCH_KEY, "1000")
    return rows


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


# ---------------------------------------------------------------------------------------------------------------------
# Bytes of a text column as numpy arrays


def text_steps(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows of about ``step`` bytes; a null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind, count=col.offset + n + 1)[col.offset:].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:
        lengths = np.diff(offsets)
        if lengths[np.asarray(col.is_null())].any():  # a null slot may cover bytes
            yield from text_steps(pa.RecordBatch.from_arrays([col.fill_null("")], [column]), column, step)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


_rng = np.random.default_rng(20240817)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PART_VALUE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, STEP_BYTES + 4096)
        made = []
        for base in (BASE, BASE_INVERSE):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 4 * STEP_BYTES:
            return made[0], made[1]  # not kept: one very long text
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Full avalanche of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; see :func:`span_hash`."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64) * PART_VALUE[63])


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER_VALUE = BYTE_VALUE[_lower]
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without space, tab, line and page breaks) and the number of words before each row."""
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word after lower-casing A-Z, and the number of words before each row."""
    starts, ends, before = word_spans(data, offsets)
    return span_hash(prefix_hash(data, LOWER_VALUE), starts, ends), before


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; fewer words give one shingle, none give none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j:n - k + 1 + j] * PART_VALUE[j]
    return mix(total + np.uint64(k))


# ---------------------------------------------------------------------------------------------------------------------
# Connected components


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars; every step is written to the shared
    folder. No neighbour list is built: a step needs each node's smallest neighbour only, a map-side aggregate.
    """
    known = stored(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-edges")
    while not _are_stars(known):
        both = known.union(known.selectExpr("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tops = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        star = large.union(tops).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("low"))
        small = star.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        known = stored(small.union(low).selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-edges")
    return known.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        known.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Every larger end has one edge, and no smaller end is a larger one: each component is known by its smallest node."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


#: Ids up to this number are broadcast (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def with_ids(rows: DataFrame, ids: DataFrame, *keys: str, how: str = "left_semi") -> DataFrame:
    """Rows whose ``keys`` are (or, with ``left_anti``, are not) among ``ids``: broadcast behind a count, else a shuffle."""
    small = ids.select(*keys).distinct()
    return rows.join(F.broadcast(small) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else small, list(keys), how)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their first ``keys`` columns; one group at a time is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change).tolist()
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
