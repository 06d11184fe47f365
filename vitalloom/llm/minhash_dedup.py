"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its smallest and its largest, so a signature takes
half as many permutations. Values are banded; documents that share a band are candidates, and each candidate link is
confirmed on the full shingle sets.

A bucket never gives all its pairs. Documents with equal sets are one class first. Members of a bucket are linked as
candidates with the bucket's smallest member only; components of those links are clusters, and two documents that
share a band are always in one cluster. A cluster is compared block against block: candidates are found from the bands
and confirmed inside the block, most shared bands first, and only while they are not connected yet; a block gives at
most one link for each of its documents. So every candidate pair is confirmed, refused or already connected. With 32
bands of 5 a pair at similarity 0.8 is missed with probability 3e-6, closer pairs less often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BANDS, ROWS = 32, 5
_rng = np.random.default_rng(97)
PERMUTE = _rng.integers(1, 2**63, (BANDS * ROWS // 2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    words, before = common.word_hashes(data, offsets)
    return [np.unique(common.shingle_hashes(words[a:b], size)) for a, b in zip(before, before[1:], strict=False)]


def digest(shingles: bytes) -> bytes:
    """Name of a shingle set."""
    return hashlib.blake2b(shingles, digest_size=16).digest()


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of non-empty sets, one row each: minima and maxima under each permutation, banded."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.empty((2 * len(PERMUTE), len(sets)), np.uint64)
    for k, (flip, factor) in enumerate(PERMUTE):
        h = (flat ^ flip) * factor
        values[2 * k] = np.minimum.reduceat(h, starts)
        values[2 * k + 1] = np.maximum.reduceat(h, starts)
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for j in range(ROWS):
        keys += common.mix(values[j * BANDS:(j + 1) * BANDS]) * common.PART_VALUE[j]
    keys = common.mix(keys + common.PART_VALUE[:BANDS, None])
    return keys.T.astype(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, digest, bands) of every row; no words: n = 0, null digest, no bands."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in common.text_steps(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full).tolist() if full else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))], ["id", "n", "digest", "bands"])

    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, digest, shingles) with the sorted distinct shingle hashes as bytes."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in common.text_steps(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                                                 ["id", "digest", "shingles"])

    return docs.mapInArrow(run, f"id {kind}, digest binary, shingles binary")


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(p) > len(q):
        p, q = q, p
    shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


#: Documents of a cluster that are compared with as many others in one task.
BLOCK = 2048


def block_links(rest: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join similar documents of a cluster; rest: (cluster, size, rep, bands, shingles)."""
    kind = rest.schema["rep"].dataType.simpleString()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "bands", "shingles")

    def run(batches):
        for group in common.sorted_groups(batches, 3):
            found = _block(group, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], ["a", "b"])

    dealt = pairs.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _block(group: pa.Table, percent: int) -> list[tuple]:
    """Links between the two sides of a block, or within it when it is compared with itself."""
    own, reps = np.asarray(group["own"]), group["rep"].to_pylist()
    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(len(own), BANDS)
    sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
    size = np.array([len(x) for x in sets])
    parent = list(range(len(own)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(left), 256):
        some = left[at:at + 256]
        shared = np.zeros((len(some), len(right)), np.int8)
        for k in range(BANDS):
            shared += bands[some, k][:, None] == bands[right, k][None, :]
        p, q = size[some][:, None], size[right][None, :]
        able = (shared > 0) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q))
        if low == high:
            able &= some[:, None] < right[None, :]
        i, j = np.nonzero(able)
        for k in np.argsort(-shared[i, j].astype(int), kind="stable"):
            x, y = some[i[k]], right[j[k]]
            a, b = top(x), top(y)
            if a != b and _similar(sets[x], sets[y], percent):
                parent[b] = a
    least = {}
    for x in range(len(own)):
        a = top(x)
        least[a] = min(reps[x], least.get(a, reps[x]))
    return [(reps[x], least[top(x)]) for x in range(len(own)) if reps[x] != least[top(x)]]


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Null and empty texts, and those of white space, have no shingles and link with nothing. Repeated rows are
    returned each. A row with a null id takes part through its text; it is never kept and its component is the
    smallest id of its group, null if there is none. Other columns are not read.
    """
    docs = common.lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = common.stored(signatures(docs, size), "minhash-signatures")
    classes = common.stored(signed.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "minhash-classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = common.stored(banded.join(crowded, "key"), "minhash-members")
    ids = common.stored(members.select("rep").distinct().join(classes.select("rep", "digest"), "rep").select(F.col("rep").alias("id"), "digest"), "minhash-ids")
    # repeated rows of an id may hold other texts, so the digest decides as well
    sets = common.stored(common.with_ids(full_sets(common.with_ids(docs, ids, "id"), size), ids, "id", "digest"), "minhash-sets")
    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"))
    pairs = members.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a <> b")
    clusters = common.stored(common.components(pairs, "minhash-clusters").select(F.col("node").alias("rep"), F.col("root").alias("cluster")), "minhash-clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    rest = clusters.join(sizes, "cluster").join(classes.select("rep", "bands"), "rep").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    roots = common.components(block_links(rest, percent), "minhash").withColumnsRenamed({"node": "rep"})
    roots = common.stored(roots, "minhash-roots")
    merged = classes.select("digest", "rep").join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    return (signed.select("id", "n", "digest").join(merged, "digest", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
