"""Near-duplicate vectors by sorted projection passes.

Each pass orders all vectors by the signs of random projections, first sign first, and compares every vector with its
neighbours in a window. Verified pairs of all passes are united into components. Equal vectors are one class first.

A pass surely shows a vector all those that share its first signs, as many signs as leave no more of them than a
window holds. Each pass therefore measures, for every vector, how many signs that took, and so the chance that it showed
a partner at the threshold. A vector has done when all its passes together miss one with a chance of at most ``miss``;
pairs need only one side that has done, so the others go on among themselves. Vectors in crowded directions need more
passes and get them; where comparing the rest block by block reads less than the passes it still needs, that is done.

Members of a component are then compared exactly, block against block, so the links of a vector inside its component
are counted whole, also in groups far larger than a window; only counts are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGNS = 48


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, unit): the vector scaled to length one as bytes of doubles; null for a vector that links with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def one(x) -> bytes | None:
        if x is None or not len(x) or any(v is None for v in x):
            return None
        v = np.array(x, dtype=np.float64)
        if not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return (v / np.linalg.norm(v)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "unit"])

    return common.lean(vectors).select(id_col, F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kind}, unit binary")


def passes_for(vectors: int, threshold: float, window: int, miss: float) -> int:
    """Passes that leave a pair at the threshold unseen with a chance of at most ``miss``."""
    signs = max(0.0, math.log2(max(vectors, 2) / window))
    seen = (1 - math.acos(threshold) / math.pi) ** signs
    return max(4, math.ceil(math.log(miss) / math.log1p(-min(seen, 0.999))))


def sorted_passes(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """(pass, signs, rep, unit): every class once for each pass."""
    kind = classes.schema["rep"].dataType.simpleString()
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                units = part.column(1)
                rows = [np.frombuffer(u.as_buffer()) for u in units]
                sizes = np.array([len(r) for r in rows])
                for size in np.unique(sizes):
                    pick = np.flatnonzero(sizes == size)
                    x = np.array([rows[i] for i in pick])
                    if size not in planes:
                        planes[size] = np.random.default_rng([seed, int(size)]).normal(size=(int(size), passes, SIGNS))
                    signs = np.einsum("nd,dps->nps", x, planes[size], optimize=True) > 0
                    some = pa.RecordBatch.from_arrays([part.column(0), units], ["rep", "unit"]).take(pa.array(pick))
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), p, np.int32)), pa.array(np.full(len(pick), size, np.int32)), pa.array(signs[:, p] @ powers), some.column(0), some.column(1)],
                                                         ["pass", "size", "signs", "rep", "unit"])

    return classes.select("rep", "unit").mapInArrow(run, f"pass int, size int, signs long, rep {kind}, unit binary")


def _spanning(reps: np.ndarray, x: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(a, b): each of the vectors with the first of those it is linked with, directly or not, among them."""
    near = x @ x.T >= threshold
    label = np.arange(len(reps))
    while True:
        low = np.where(near, label[None, :], len(reps)).min(axis=1)
        low = np.minimum(low, label)
        if (low == label).all():
            break
        label = low
    other = np.flatnonzero(label != np.arange(len(reps)))
    return pa.RecordBatch.from_arrays([pa.array(reps[other]), pa.array(reps[label[other]])], ["a", "b"])


def shown(signs: np.ndarray, window: int, threshold: float, opened: bool, closed: bool) -> np.ndarray:
    """Log of the chance that a partner at the threshold stays unseen, for each of the sorted ``signs`` of one pass.

    ``opened`` and ``closed`` say that the pass begins and ends here; else rows follow beyond the border, unseen.
    """
    n = len(signs)
    place = np.arange(n)

    def alike(other: np.ndarray, ends: bool) -> np.ndarray:
        within = np.clip(other, 0, n - 1)
        same = SIGNS - np.frexp((signs ^ signs[within]).astype(np.float64))[1]
        return np.where((other != within) & ends, -1, same)

    depth = 1 + np.maximum(alike(place - window - 1, opened), alike(place + window + 1, closed))
    chance = np.where(depth > SIGNS, 0.0, (1 - math.acos(threshold) / math.pi) ** depth)
    return np.log1p(-np.minimum(chance, 1 - 1e-12))


def window_links(ordered: DataFrame, threshold: float, window: int) -> DataFrame:
    """(a, b, unseen): edges that join every vector with the first of those it is linked with within its windows, and,
    with a null ``b``, the log chance of each vector and pass to leave a partner unseen."""
    kind = ordered.schema["rep"].dataType.simpleString()

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
        held, first = None, True
        for group in common.sorted_groups(batches, 2):
            if held is not None:
                yield held, not first, True
                first = False
            held = group.combine_chunks()
        if held is not None:
            yield held, not first, False

    def run(batches):
        for rows, opened, closed in passes(batches):
            n = rows.num_rows
            unseen = shown(np.asarray(rows["signs"]), window, threshold, opened, closed)
            reps = np.asarray(rows["rep"])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.nulls(n, pa.array(reps).type), pa.array(unseen)], ["a", "b", "unseen"])
            for at in range(0, max(1, n - window), window):
                part = rows.slice(at, 2 * window)
                units = np.frombuffer(b"".join(part["unit"].to_pylist())).reshape(part.num_rows, -1)
                found = _spanning(reps[at:at + 2 * window], units, threshold)
                yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.float64())], ["a", "b", "unseen"])

    return ordered.mapInArrow(run, f"a {kind}, b {kind}, unseen double")


def block_links(rest: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(a, b) edges with the components of all pairs of ``rest`` (rep, unit) at the threshold: every two blocks meet once."""
    kind = rest.schema["rep"].dataType.simpleString()
    sized = rest.select("rep", "unit", F.length("unit").alias("size"))
    blocks = sized.groupBy("size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = sized.join(blocks, "size").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "size", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "unit")

    def run(batches):
        for group in common.sorted_groups(batches, 3):
            reps = np.asarray(group["rep"])
            yield _spanning(reps, np.frombuffer(b"".join(group["unit"].to_pylist())).reshape(len(reps), -1), threshold)

    return pairs.repartition("size", "low", "high").sortWithinPartitions("size", "low", "high").mapInArrow(run, f"a {kind}, b {kind}")


def near_edges(classes: DataFrame, threshold: float, window: int, miss: float, seed: int, rounds: int = 8, wide: int = 64) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of ``classes`` (rep, unit) at the threshold, as far as seen.

    Rounds of passes go over the vectors that are not done; a round has ``wide`` passes at most but the first. What
    ``rounds`` leave is compared in blocks.
    """
    goal, block = math.log(miss), 512
    rest, edges = classes.select("rep", "unit"), None
    passes = passes_for(classes.count(), threshold, window, miss)
    for number in range(rounds):
        ordered = sorted_passes(rest, passes, seed + number).repartitionByRange("pass", "size", "signs", "rep").sortWithinPartitions("pass", "size", "signs", "rep")
        seen = common.stored(window_links(ordered, threshold, window), "vector-passes")
        found = seen.where("b is not null").select("a", "b")
        edges = found if edges is None else edges.union(found)
        unseen = seen.where("b is null").groupBy("a").agg(F.sum("unseen").alias("unseen"))
        before = rest.withColumn("done", F.lit(0.0)) if "done" not in rest.columns else rest
        left = before.join(unseen, before["rep"] == unseen["a"]).where(F.col("done") + F.col("unseen") > goal).select(
            "rep", "unit", (F.col("done") + F.col("unseen")).alias("done"), (F.col("unseen") / passes).alias("pace"))
        left = common.stored(left, "vector-rest")
        many, more = left.agg(F.count("*"), F.avg((F.lit(goal) - F.col("done")) / F.least("pace", F.lit(-1e-4)))).first()
        rest, passes = left.select("rep", "unit", "done"), max(4, min(wide, math.ceil(more or 0)))
        if not many:
            return edges
        if many <= block * more:
            break
    return edges.union(block_links(rest, threshold, block))


def component_counts(members: DataFrame, threshold: float, block: int = 512) -> DataFrame:
    """(rep, n): vectors linked with each member (root, rep, unit, weight) inside its component, other classes only."""
    kind = members.schema["rep"].dataType.simpleString()
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "weight", "unit")

    def run(batches):
        for group in common.sorted_groups(batches, 3):
            reps, weight, own = np.asarray(group["rep"]), np.asarray(group["weight"]), np.asarray(group["own"])
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            units = group["unit"].to_pylist()
            sides = [np.flatnonzero(own == low), np.flatnonzero(own == high)]
            x, y = (np.frombuffer(b"".join(units[i] for i in s)).reshape(len(s), -1) if len(s) else np.zeros((0, 1)) for s in sides)
            if not len(x) or not len(y):
                continue
            near = x @ y.T >= threshold
            if low == high:
                np.fill_diagonal(near, False)
            counts = [(reps[sides[0]], near @ weight[sides[1]])]
            if low != high:
                counts.append((reps[sides[1]], near.T @ weight[sides[0]]))
            for r, n in counts:
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n.astype(np.int64))], ["rep", "n"])

    dealt = pairs.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return dealt.mapInArrow(run, f"rep {kind}, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, window: int = 256, miss: float = 5e-4, seed: int = 5,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of
    different sizes are never compared. Each row counts as a vector, repeated rows too; a row with a null id counts
    for the others and is never kept. Other columns are not read.
    """
    units = common.stored(unit_vectors(vectors, id_col, vector_col), "vectors")
    classes = common.stored(units.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("rep is not null"), "vector-classes")
    edges = common.stored(near_edges(classes, threshold, window, miss, seed).distinct(), "vector-edges")
    roots = common.components(edges, "vectors").withColumnsRenamed({"node": "rep"})
    roots = common.stored(roots, "vector-roots")
    members = classes.join(roots, "rep")
    counted = component_counts(members, threshold)
    merged = classes.join(roots, "rep", "left").join(counted, "rep", "left").select(
        "unit", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return (units.join(merged, "unit", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
