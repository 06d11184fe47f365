"""Uniform shuffle into shards of exact sizes, in DataFrame code.

Every partition permutes its rows where they lie. A communication matrix then says how many rows of each partition go
to each shard: it is drawn from the multivariate hypergeometric law, which is the law of these counts under a uniform
permutation of all rows, so its row sums are the partition sizes and its column sums the shard sizes, both exact. Rows
are exchanged by their rank in the partition, and each shard permutes what it received.

A shard may hold far more rows than a task should sort. Its permutation is therefore cut into buckets of random keys,
counted and numbered one after the other. Nothing depends on the rows' content, so equal texts are dealt like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Most partitions that a matrix is drawn for; more are merged without a shuffle.
PARTITIONS = 65_536
#: Numpy's exact sampler takes populations below this.
POPULATION = 1_000_000_000
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = (1 << 33) - 1


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that add up to ``rows`` and differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _large_draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One hypergeometric draw by inversion over all values that have a chance in double precision."""
    total = good + bad
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (good + 1) * (sample + 1) // (total + 2)))
    spread = (sample * (good / total) * (bad / total) * ((total - sample) / max(total - 1, 1))) ** 0.5
    reach = int(40 * spread) + 40
    values = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    k = values[:-1]
    steps = np.log((good - k) / (k + 1)) + np.log((sample - k) / (bad - sample + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(weight - weight.max()))
    return int(values[np.searchsorted(chance, rng.random() * chance[-1], side="right")])


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Exact draws: how many of ``sample`` taken from ``good`` + ``bad`` are good."""
    small = good + bad < POPULATION
    out = np.zeros(len(good), np.int64)
    out[small] = rng.hypergeometric(good[small], bad[small], sample[small])
    for i in np.flatnonzero(~small):
        out[i] = _large_draw(rng, int(good[i]), int(bad[i]), int(sample[i]))
    return out


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows that each partition (of these sizes) sends to each shard (of these sizes) under a uniform permutation.

    Halves the partitions again and again; what a half receives of each shard is drawn shard after shard.
    """
    rng = np.random.default_rng(seed)
    width = 1 << max(0, len(partitions) - 1).bit_length()
    levels = [np.array(partitions + [0] * (width - len(partitions)), np.int64)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    counts = np.array([shards], np.int64)
    for sizes in reversed(levels[:-1]):
        left, need = np.zeros_like(counts), sizes[::2].copy()
        rest = counts.sum(axis=1)
        for s in range(len(shards)):
            rest -= counts[:, s]
            left[:, s] = hypergeometric(rng, counts[:, s], rest, need)
            need -= left[:, s]
        counts = np.stack([left, counts - left], axis=1).reshape(len(sizes), -1)
    return counts[:len(partitions)]


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 11, rows_per_bucket: int = 200_000) -> DataFrame:
    """(row, shard, slot): every row of ``rows`` as a struct, its shard and its place there, gapless from 0.

    Shard sizes differ by one at most. Null, empty, repeated and very long values change nothing; whatever names the
    columns have, they stay inside ``row``. An empty table gives an empty result. The locally permuted rows are
    written once, so a lost executor cannot change a draw. The driver sees one number per partition (at most
    ``PARTITIONS``), and the matrix, as large, is broadcast.
    """
    spark = rows.sparkSession
    numbered = rows.coalesce(PARTITIONS).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    local = numbered.withColumn("draw", F.xxhash64(F.lit(seed), "number")).sortWithinPartitions("draw", "number")
    local = common.stored(local.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("rank")), "shards-permuted")

    sizes = sorted((r[0], r[1]) for r in local.groupBy("part").count().collect())
    total = sum(n for _, n in sizes)
    ends = np.cumsum(communication_matrix([n for _, n in sizes], shard_sizes(total, shards), seed), axis=1) if sizes else np.zeros((0, shards))
    matrix = spark.createDataFrame([(part, row.tolist()) for (part, _), row in zip(sizes, ends, strict=True)], "part int, ends array<bigint>")

    buckets = max(1, -(-total // (shards * rows_per_bucket)))
    key = F.xxhash64(F.lit(seed + 1), "part", "rank")
    sent = local.join(F.broadcast(matrix), "part").select(
        "row", "part", "rank", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"), key.alias("key"), F.pmod(F.shiftright(key, 16), F.lit(buckets)).alias("bucket"))
    counted = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counted.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "part", "rank")) - 1
    return sent.withColumn("place", place).join(before, ["shard", "bucket"]).select("row", "shard", (F.col("before") + F.col("place")).alias("slot"))


def write_shards(dealt: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the result of :func:`shuffled` as Parquet, one folder for each shard, rows in the order of their slots.

    A shard is cut into files of ``rows_per_file`` slots, so no task sorts a whole shard.
    """
    cut = dealt.withColumn("file", F.floor(F.col("slot") / rows_per_file))
    ordered = cut.repartition("shard", "file").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
