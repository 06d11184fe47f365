"""Snapshots, suppression, previous values, tolerance matches and streaming twins."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from vitalloom.functions.neighbours import neighbour, running_sum
from vitalloom.operators import filters as f
from vitalloom.operators import joins as j
from vitalloom.operators import windows as w
from vitalloom.session import scratch
from vitalloom.sources import snapshots as sn
from vitalloom.sources import tables as tb
from vitalloom.streaming import batch as b
from vitalloom.streaming import streams as s

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_upsert_policies_and_replay(rows):
    base = rows([(1, "old", "keep", "pending", 1, False, ["a"]), (2, "old", None, "final", 0, None, None)],
                "k int, o string, s string, st string, n int, f boolean, t array<string>")
    up = rows([(1, "new", "x", "pending", 1, True, ["b"], 1), (2, "new", "x", "final", 1, False, ["c"], 1), (2, "newer", "y", "z", 1, False, ["d"], 2), (3, "in", "i", "pending", 1, True, ["e"], 1)],
              "k int, o string, s string, st string, n int, f boolean, t array<string>, seq int")
    pol = {"o": "overwrite", "s": "keep", "st": ("keep_if_status", "st", ["pending"]), "f": "or", "t": "append"}
    out = sn.upsert(base, up, ["k"], "seq", {**pol, "n": "increment"})
    got = {r["k"]: (r["o"], r["s"], r["st"], r["n"], r["f"], r["t"]) for r in out.collect()}
    assert got == {1: ("new", "keep", "pending", 2, True, ["a", "b"]), 2: ("newer", "x", "z", 2, False, ["c", "d"]), 3: ("in", "i", "pending", 1, True, ["e"])}
    once = sn.upsert(base, up, ["k"], "seq", pol)
    twice = sn.upsert(once, up, ["k"], "seq", pol)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_upsert_do_nothing_and_unordered_pairs(rows):
    base = rows([("Aspirin", "warfarin", "high")], "a string, b string, sev string")
    up = rows([("WARFARIN", "aspirin", "critical", 1), ("x", "y", "low", 1)], "a string, b string, sev string, seq int")
    got = {(r["a"], r["sev"]) for r in sn.upsert_pairs(base, up, "a", "b", "seq", {"sev": "overwrite"}).collect()}
    assert got == {("Aspirin", "critical"), ("x", "low")}
    kept = {r["sev"] for r in sn.upsert(base, up.withColumn("a", F.initcap("b")), ["a"], "seq", {"sev": "overwrite", "b": "overwrite"}, do_nothing=True).collect()}
    assert "high" in kept


def test_transition_reports_applied_and_rejected(rows):
    snap = rows([(1, "queued"), (2, "done")], "k int, st string")
    req = rows([(1, "in_progress", 1), (2, "in_progress", 1), (9, "in_progress", 1)], "k int, to string, at int")
    new, log = sn.transition(snap, req, "k", "st", "to", "at", {"in_progress": ["queued"]}, as_of=T0, stamps={"in_progress": "started_at"})
    assert {(r["k"], r["st"], r["started_at"]) for r in new.collect()} == {(1, "in_progress", T0), (2, "done", None)}
    assert {(r["k"], r["applied"]) for r in log.collect()} == {(1, True), (2, False), (9, False)}


def test_seed_only_when_nothing_is_active(rows):
    seed = rows([(9, True)], "k int, active boolean")
    assert sn.seed_if_empty(rows([(1, True)], "k int, active boolean"), F.col("active"), seed).count() == 1
    assert sn.seed_if_empty(rows([(1, False)], "k int, active boolean"), F.col("active"), seed).count() == 2


def test_nul_is_stripped_from_nested_text(rows):
    df = rows([("a\0b", ["x\0"], ("\0y", 1))], "t string, l array<string>, s struct<u:string,n:int>")
    got = tb.strip_nul(df).first()
    assert (got["t"], got["l"], got["s"]["u"]) == ("ab", ["x"], "y")


def test_tasks_by_media_type(rows):
    got = [r[0] for r in rows([("image/png",), ("AUDIO/ogg",), ("application/pdf",), ("application/pdfx",), (None,)], "m string").select(tb.task_type("m")).collect()]
    assert got == ["ocr_prescription", "transcribe_audio", "parse_pdf", "", ""]


def test_sliced_neighbours_equal_plain_ones(rows):
    rng = random.Random(1)
    data = [(rng.choice("ab"), at(rng.randint(0, 20000)), i, rng.random()) for i in range(300)]
    df = rows(data, "k string, t timestamp, i int, v double")
    for forward in (False, True):
        got = {r["i"]: (r["x"]["v"] if r["x"] else None) for r in neighbour(df, ["k"], ["t", "i"], ["v"], "x", forward=forward).collect()}
        want = {}
        for key in "ab":
            seq = sorted([x for x in data if x[0] == key], key=lambda x: (x[1], x[2]), reverse=forward)
            for prev, cur in zip([None] + seq, seq):
                want[cur[2]] = prev[3] if prev else None
        assert got == want
    got = {r["i"]: r["n"] for r in running_sum(df, ["k"], ["i"], F.lit(1), "n", F.floor(F.col("i") / 50)).collect()}
    assert got == {x[2]: sum(1 for y in data if y[0] == x[0] and y[2] <= x[2]) for x in data}


def test_recent_repeats_equal_brute_force(rows):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), at(rng.randint(0, 600)), i) for i in range(200)]
    df = rows(data, "k string, t timestamp, i int")
    got = {r["i"] for r in j.without_recent(df, df, ["k"], "t", "t", 1800, ident="i").collect()}
    want = {i for k, t, i in data if not any(k2 == k and t2 > t - dt.timedelta(minutes=30) and (t2, i2) < (t, i) for k2, t2, i2 in data)}
    assert got == want


def test_second_equal_decision_within_the_hour_is_skipped(rows):
    df = rows([("h", at(0), 1), ("h", at(59), 2), ("h", at(120), 3), ("g", at(10), 4)], "h string, t timestamp, i int")
    assert {r["i"] for r in b.fresh_decisions(df, "h", "t", "i").collect()} == {1, 3, 4}


def test_greedy_matches_take_each_log_once(rows):
    doses = rows([("m", "d", at(480)), ("m", "d", at(600)), ("n", "d", at(480))], "m string, d string, at timestamp")
    logs = rows([("m", "d", at(540), 1, "taken"), ("m", "d", at(500), 2, "missed"), ("n", "d", at(480 + 181), 3, "taken")], "m string, d string, t timestamp, i int, v string")
    got = {(r["m"], r["at"]): (r["matched_id"], r["matched_value"]) for r in j.match_doses(doses, logs, ["m", "d"], "at", "t", "i", "v").collect()}
    assert got == {("m", at(480)): (1, "taken"), ("m", at(600)): (2, "missed"), ("n", at(480)): (None, None)}


def test_greedy_matches_equal_a_plain_loop(rows):
    rng = random.Random(5)
    times = [at(m) for m in (480, 720, 960, 1200)]
    logs = [(rng.choice("mn"), "d", at(rng.randint(300, 1400)), i, "x") for i in range(14)]
    doses = [(m, "d", t) for m in "mn" for t in times]
    got = {(r["m"], r["at"]): r["matched_id"] for r in j.match_doses(
        rows(doses, "m string, d string, at timestamp"), rows(logs, "m string, d string, t timestamp, i int, v string"), ["m", "d"], "at", "t", "i", "v").collect()}
    want, used = {}, set()
    for m, _, t in sorted(doses, key=lambda x: x[2]):
        pick = next((lg for lg in sorted(logs, key=lambda x: (x[2], x[3]), reverse=True)
                     if lg[3] not in used and lg[0] == m and abs((lg[2] - t).total_seconds()) <= 10800), None)
        want[(m, t)] = pick[3] if pick else None
        if pick:
            used.add(pick[3])
    assert got == want


def walk(data, gap):
    out, last = set(), {}
    for k, t, i, forced in sorted(data, key=lambda x: (x[1], x[2])):
        if forced or k not in last or (t - last[k]).total_seconds() >= gap:
            last[k] = t
            out.add(i)
    return out


@pytest.mark.parametrize("batch", [7, 10000])
def test_cooldown_equals_a_plain_loop_over_many_slices(spark, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(7)
    data = [(rng.choice("aab"), at(rng.randint(0, 4000)), i, rng.random() < 0.03) for i in range(600)]
    df = rows(data, "k string, t timestamp, i int, f boolean")
    for gap, width in ((300, 900), (3600, 3600), (600, 100000)):
        got = {r["i"] for r in b.cooldown(df, ["k"], "t", "i", gap, force="f", slice_seconds=width).collect()}
        assert got == walk(data, gap)
    plain = [(k, t, i, False) for k, t, i, _ in data]
    through = {r["i"] for r in b.cooldown(df, ["k"], "t", "i", 300).collect()}
    kept = sorted((x for x in plain if x[2] in through), key=lambda x: (x[0], x[1]))
    assert all((q[1] - p[1]).total_seconds() >= 300 for p, q in zip(kept, kept[1:]) if p[0] == q[0])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_task_sink_joins_each_batch(spark, rows):
    folder = scratch(spark, "test")
    rows([("a", 1), ("b", 2)], "k string, n int").write.parquet(f"{folder}/in")
    rules = rows([("a", "rule")], "k string, r string")
    q = s.task_sink(spark.readStream.schema("k string, n int").parquet(f"{folder}/in"), rules, "k",
                    lambda df, n: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state")
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()] == [("a", 1, "rule")]


def test_stale_tasks_requeue_while_tries_remain(rows):
    df = rows([(1, "in_progress", at(0), 1, None), (2, "in_progress", at(0), 5, None), (3, "in_progress", at(55), 0, 3), (4, "done", at(0), 0, 3)],
              "k int, st string, t timestamp, a int, m int")
    assert {r["k"]: r["st"] for r in b.requeue_stale(df, "st", "t", "a", "m", at(60)).collect()} == {1: "queued", 2: "in_progress", 3: "in_progress", 4: "done"}


def test_context_expires_after_its_span(rows):
    df = rows([("a", "veto_window", at(0), None, 1), ("b", "appointment_confirm", at(0), None, 2), ("c", "veto_window", at(0), at(999), 3)],
              "p string, k string, t timestamp, e timestamp, i int")
    as_of = T0 + dt.timedelta(seconds=181)
    assert {r["p"]: r["active"] for r in w.open_context(df, "p", "k", "t", "e", "i", as_of).collect()} == {"a": False, "b": True, "c": True}


def test_two_days_ahead_is_a_reminder_candidate(rows):
    df = rows([(1, at(48 * 60)), (2, at(120)), (3, at(20 * 60)), (4, at(73 * 60))], "i int, t timestamp")
    got = {r["i"]: r["b"] for r in df.where(f.look_ahead("t", T0, open_start=True, closed_end=True, hours=72)).withColumn("b", b.reminder_bucket("t", T0)).collect()}
    assert got == {1: "72h", 2: "same_day", 3: "24h"}


def test_hot_places_fold_before_the_distance_join(rows):
    pts = rows([(i, 28.6, 77.2) for i in range(50)] + [(99, 89.99, 10.0)], "p int, lat double, lon double")
    places = rows([(i, 28.61, 77.2) for i in range(50, 100)] + [(7, 89.98, -170.0)], "h int, la double, lo double")
    got = {r["p"]: (r["nearest"], round(r["distance_km"], 2)) for r in j.nearest_within(pts, places, "p", "lat", "lon", "h", "la", "lo").collect()}
    assert got[0] == (50, 1.11)
    assert got[99][0] == 7


def test_table_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    part = next((tmp_path / "parts.parquet").glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    for file in ("parts.parquet", "one.parquet"):
        out = s.run_to_table(s.table_stream(spark, str(tmp_path), file, max_files=1), scratch(spark, "test-stream"))
        want = spark.read.parquet(str(tmp_path / file))
        assert sorted(r.id for r in out.collect()) == sorted(r.id for r in want.collect())
