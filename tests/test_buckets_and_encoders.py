"""Merges touch their own buckets and count once; encoders load once per worker."""

import os

import pytest
from pyspark.sql import functions as F

from vitalloom.functions.encoding import encoder
from vitalloom.sources import buckets as bk
from vitalloom.sources import snapshots as sn

POLICIES = {"v": "overwrite", "n": "increment"}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).cast("long").alias("n"))
    bk.create(base, path, ["k"], 16)
    return path, base


def test_only_touched_buckets_are_written(spark, table):
    path, base = table
    up = spark.createDataFrame([(3, "new", 1, 1), (3, "newer", 1, 2), (500, "in", 1, 1), (None, "none", 1, 1)], "k long, v string, n long, seq int")
    hit = {r[0] for r in up.select(bk.bucket_of(["k"], 16)).distinct().collect()}
    before = files(path)
    want = sorted(map(str, sn.upsert(base, up, ["k"], "seq", POLICIES).collect()))
    for _ in range(3):
        bk.merge(spark, path, up, ["k"], "seq", POLICIES, 0, buckets=16)
    assert sorted(map(str, bk.read(spark, path).select("k", "v", "n").collect())) == want
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in hit}
    assert kept and before & files(path) == kept and len(hit) < 16


def test_a_merge_that_broke_off_goes_on(spark, table, monkeypatch):
    path, base = table
    up = base.select("k", F.lit("x").alias("v"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("seq"))
    place = bk._place

    def broken(rows, where, mode):
        if mode == "dynamic":
            raise OSError("lost")
        place(rows, where, mode)

    for stop in (True, False, False):
        monkeypatch.setattr(bk, "_place", broken if stop else place)
        if stop:
            with pytest.raises(OSError):
                bk.merge(spark, path, up, ["k"], "seq", POLICIES, 4, buckets=16)
        else:
            bk.merge(spark, path, up, ["k"], "seq", POLICIES, 4, buckets=16)
    assert {tuple(r) for r in bk.read(spark, path).groupBy("v", "n").count().collect()} == {("x", 1, 200)}
    before = files(path)
    bk.merge(spark, path, up.limit(0), ["k"], "seq", POLICIES, 5, buckets=16)
    assert files(path) == before


def test_encoder_loads_once_and_leaves_nulls(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import tempfile
        tempfile.mkstemp(dir=log, prefix=f"{os.getpid()}-")
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    rows = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("a"), F.col("id").cast("string"))).alias("t"))
    code = encoder(load, step=100)
    for _ in range(3):
        got = rows.select("t", code("t").alias("v")).collect()
    assert all((r["v"] is None) if r["t"] is None else list(r["v"]) == [len(r["t"]), 1] for r in got)
    loads = [f.split("-")[0] for f in os.listdir(log)]
    assert len(loads) == len(set(loads)) and loads
