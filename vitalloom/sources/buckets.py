"""A table in key buckets that takes updates bucket by bucket.

The table is a folder of parquet files, one partition for each bucket of its keys. A batch of updates reads and writes
the buckets that hold its keys only; files of all others stay as they are. A batch is merged once, however often it is
handed over: the merged buckets are written beside the table first and noted, then put in their place and noted again,
so a replay goes on where the last try stopped, and counters are not raised twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import upsert

BUCKET = "bucket"
BUCKETS = 256


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket number of a row: the same for equal keys in any table; null keys have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _place(rows: DataFrame, path: str, mode: str) -> None:
    """Write rows by bucket; a heavy bucket is split by size, light ones are not."""
    rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(path)


def _side(path: str, part: str, batch: int) -> str:
    return f"{path.rstrip('/')}-merges/{part}/{batch}"


def _noted(spark: SparkSession, path: str, part: str, batch: int) -> bool:
    try:
        return not spark.read.schema("n int").parquet(_side(path, part, batch)).isEmpty()
    except AnalysisException:
        return False


def _note(spark: SparkSession, path: str, part: str, batch: int) -> None:
    spark.range(1).select(F.col("id").cast("int").alias("n")).coalesce(1).write.mode("overwrite").parquet(_side(path, part, batch))


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write ``rows`` as a new table of ``buckets`` buckets. The same number goes to every later call."""
    _place(rows.withColumn(BUCKET, bucket_of(keys, buckets)), path, "static")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole table as it stands."""
    return spark.read.parquet(path).drop(BUCKET)


def merge(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], order: str, policies: Mapping[str, str | tuple], batch: int, *,
          buckets: int = BUCKETS, do_nothing: bool = False) -> None:
    """:func:`~vitalloom.sources.snapshots.upsert` of one batch of updates into the table at ``path``.

    One writer at a time, batches in the order of their numbers. The driver sees the numbers of touched buckets only,
    ``buckets`` at most.
    """
    if _noted(spark, path, "done", batch):
        return
    staged = _side(path, "rows", batch)
    if not _noted(spark, path, "staged", batch):
        dealt = updates.withColumn(BUCKET, bucket_of(keys, buckets))
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]
        if not touched:
            return _note(spark, path, "done", batch)
        stored = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        _place(upsert(stored, dealt, [BUCKET, *keys], order, policies, do_nothing=do_nothing), staged, "static")
        _note(spark, path, "staged", batch)
    _place(spark.read.parquet(staged), path, "dynamic")
    _note(spark, path, "done", batch)
