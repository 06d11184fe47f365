"""Sharding, source audit and centroid clustering on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vitalloom.llm import centroid_clustering, sharding, source_audit, transducer

WIDE = "doc_id long, text string, lang string, source string, n_chars long, row string, shard string, slot long, part int, rank long, `a.b` string"


def test_matrix_has_the_law_of_a_uniform_permutation():
    sizes, shards = [3, 2, 4], [5, 4]
    pool = [p for p, n in enumerate(sizes) for _ in range(n)]
    exact = Counter()
    from itertools import combinations
    for chosen in combinations(range(9), 5):
        exact[tuple(sum(pool[i] == p for i in chosen) for p in range(3))] += 1
    drawn = Counter()
    for seed in range(4000):
        m = sharding.communication_matrix(sizes, shards, seed)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == shards and (m >= 0).all()
        drawn[tuple(m[:, 0].tolist())] += 1
    whole = sum(exact.values())
    chi = sum((drawn[k] - 4000 * n / whole) ** 2 / (4000 * n / whole) for k, n in exact.items())
    assert set(drawn) <= set(exact) and chi < 2 * len(exact) + 15


def test_draws_beyond_the_small_population():
    rng = np.random.default_rng(3)
    assert sharding.hypergeometric(rng, np.array([2 * 10**9, 0, 3 * 10**9]), np.array([0, 10**9, 1]), np.array([7, 5, 3 * 10**9 + 1])).tolist() == [7, 0, 3 * 10**9]
    draws = [sharding._large_draw(rng, 3 * 10**9, 10**9, 1000) for _ in range(3000)]
    assert abs(np.mean(draws) - 750) < 1.5 and 0.9 < np.var(draws) / 187.5 < 1.1
    few = Counter(sharding._large_draw(rng, 4, 6, 3) for _ in range(6000))
    for k in range(4):
        assert abs(few[k] / 6000 - math.comb(4, k) * math.comb(6, 3 - k) / math.comb(10, 3)) < 0.03
    m = sharding.communication_matrix([10**10, 5, 3 * 10**9, 0], sharding.shard_sizes(13 * 10**9 + 5, 16), 1)
    assert m.sum(axis=1).tolist() == [10**10, 5, 3 * 10**9, 0] and m.sum(axis=0).tolist() == sharding.shard_sizes(13 * 10**9 + 5, 16)


@pytest.mark.parametrize("bucket", [200_000, 20])
def test_shards_are_exact_gapless_and_mixed(spark, tmp_path, bucket):
    rows = [(i % 900 if i % 7 else None, None if i % 5 == 0 else "same" if i % 3 else "x" * (i * 40), "en", None, 1, "r", "s", 2, 3, 4, "c") for i in range(1003)]
    table = spark.createDataFrame(rows, WIDE).repartition(7)
    got = sharding.shuffled(table, 16, rows_per_bucket=bucket)
    out = got.select("row.doc_id", "row.text", "shard", "slot", "row.`a.b`").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((x[0], x[1]) for x in rows) and all(r["a.b"] == "c" for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and sorted(map(len, by.values())) == sorted(sharding.shard_sizes(1003, 16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    path = str(tmp_path / "shards")
    sharding.write_shards(sharding.shuffled(table.select("doc_id", "text"), 4), path, 100)
    assert spark.read.parquet(path).groupBy("shard").count().where("count >= 250").count() == 4
    assert sharding.shuffled(table.limit(0)).count() == 0 and sharding.shuffled(table.limit(3), 16).where("slot > 0").count() == 0


def test_shuffle_is_uniform_over_seeds(spark):
    table = spark.range(8).repartition(3)
    stays, first = 0, Counter()
    for seed in range(40):
        out = {r.id: (r.shard, r.slot) for r in sharding.shuffled(table, 2, seed).select("row.id", "shard", "slot").collect()}
        stays += sum(out[i][0] == out[i + 1][0] for i in range(7))
        first[[i for i in out if out[i] == (0, 0)][0]] += 1
    assert abs(stays / 280 - 3 / 7) < 0.12 and len(first) >= 6 and max(first.values()) < 15


def test_transducer_is_minimal_and_ordered():
    r = random.Random(1)
    for _ in range(60):
        terms = sorted({"".join(r.choice("abé中") for _ in range(r.randint(1, 6))).encode() for _ in range(r.randint(1, 80))})
        made = transducer.build(terms)
        assert [transducer.term_at(made, made.root, i) for i in range(len(terms))] == terms
        other = [t + b"a" for t in terms] + [t[:-1] for t in terms] + [b"", b"zz"]
        data = np.frombuffer(b"".join(terms + other), np.uint8)
        ends = np.cumsum([len(t) for t in terms + other])
        got = transducer.ordinals(made, data, ends - [len(t) for t in terms + other], ends, np.full(len(ends), made.root))
        place = {t: i for i, t in enumerate(terms)}
        assert got.tolist() == [place.get(t, -1) for t in terms + other]
        tails = set()  # minimal: as many states as different sets of endings
        for t in terms:
            for k in range(len(t) + 1):
                tails.add(frozenset(x[k:] for x in terms if x[:k] == t[:k]))
        assert len(made.finals) == len(tails)
    a, b = transducer.build([b"a", b"ab"]), transducer.build([b"b"])
    table, roots = transducer.joined([a, b])
    assert transducer.ordinals(table, np.frombuffer(b"abb", np.uint8), np.array([0, 2, 2]), np.array([2, 3, 3]), roots[[0, 1, 0]]).tolist() == [1, 0, -1]
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])


def plain_audit(rows, least, top=50):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    df = Counter((lang, t) for lang, _, w in docs for t in set(w))
    out = []
    for lang in {x[0] for x in docs}:
        kept = sorted((t for (own, t), n in df.items() if own == lang and n >= least), key=lambda t: t.encode())
        groups = {s: Counter() for own, s, _ in docs if own == lang}
        for own, s, w in docs:
            if own == lang:
                groups[s].update(t for t in w if t in set(kept))
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "size"), [(200_000, 64_000_000), (5, 1500)])
def test_audit_matches_plain_python(spark, monkeypatch, terms, size):
    r = random.Random(6)
    words = ["a", "ab", "Ab", "abc", "abcdefghij", "abcdefghik", "abcdefghi", "é", "ÉT", "über", "x" * 900, "中文", "😀", "zz"] + ["".join(r.choice("abcé") for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = []
    for i in range(260):
        mine = words[i % 5:] if i % 3 else words[:20]
        text = "".join(r.choice(mine) + r.choice([" ", "1", "_", "\n", "\x7f", "[", "'"]) for _ in range(r.randint(0, 40)))
        rows.append((None if i % 41 == 0 else text, r.choice(["en", "EN", None, ""]), r.choice(["s1", "s10", "s2", None, "é"])))
    rows += [(rows[1][0], "en", "s1")] * 5 + [("123 !", "xx", "only"), ("", "yy", "p"), (None, "yy", "q"), ("Ab " * 60_000, "en", "long")]
    table = spark.createDataFrame([(i, *x, 1, "r", "s", 2, 3, 4, "c") for i, x in enumerate(rows)], WIDE).repartition(5)
    for block, tile, held in ((4096, 256, 2_000_000), (7, 2, 10)):
        for name, value in (("BLOCK", block), ("TILE", tile), ("HELD", held)):
            monkeypatch.setattr(source_audit, name, value)
        got = source_audit.audit(table, 8, 50, terms, size)
        assert sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in got.collect()) == plain_audit(rows, 8)
    assert source_audit.audit(table.limit(0)).count() == 0


def test_shares_stay_exact_beyond_longs(spark):
    n = [(0, 0, 1), (10**16, 3 * 10**17, 12345), (9_999_999_999, 10**10, 7), (4, 9, 3)]
    from pyspark.sql import functions as F
    got = [x[0] for x in spark.createDataFrame(n, "n long, total long, terms long").select(source_audit.share(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in n]


def plain_clusters(rows, clusters, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", np.array(x[1], "<i4").tobytes())
    centres = [list(v) for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for k in range(rounds + 1):
        near = [min((far(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if k < rounds:
            for n in {x[1] for x in near}:
                own = [v for (_, v), x in zip(kept, near, strict=True) if x[1] == n]
                centres[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    inside = Counter()
    for d, n in near:
        inside[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, inside[n], sum(inside.values()), digest[n]) for (i, _), (d, n) in zip(kept, near, strict=True))


def test_clusters_match_plain_python(spark):
    r = np.random.default_rng(8)
    spots = r.normal(size=(5, 6)) * 2
    rows = [(i, (spots[i % 5] + r.normal(size=6) * 0.3).tolist()) for i in range(200)] + [(300 + i, [float(x)] * 6) for i in range(4) for x in (0.5, -0.5)]
    rows += [(None, [1.0] * 6), (None, [2.0] * 6), (400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 5 + [None]), (404, [float("nan")] * 6), (405, [float("-inf")] + [0.0] * 5), (406, [-1e-9] * 6),
             (407, [100_000.0, -100_000.0] * 3)]
    make = lambda x: spark.createDataFrame([(i, v, 1, "x", 2) for i, v in x], "vec_id long, embedding array<double>, cluster int, x string, near int").repartition(4)
    run = lambda x, **k: sorted((str(y.vec_id), y.cluster, y.distance, y.cluster_inertia, y.inertia, y.centroid_sha256) for y in centroid_clustering.with_inertia(*centroid_clustering.cluster(make(x), size=6, **k)).collect())
    assert run(rows) == plain_clusters(rows, 8, 10, 6)
    same = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(12)]
    assert run(same, rounds=2) == plain_clusters(same, 8, 2, 6)
    assert run(rows[:3], rounds=2) == plain_clusters(rows[:3], 8, 2, 6)
    assert run(rows[-6:-4]) == [] and run([]) == []
    with pytest.raises(Exception, match="do not fit a long"):
        run([(1, [1e6] * 6)])


def test_ptolemaic_bounds_are_lower_bounds_and_rule_centroids_out():
    r = np.random.default_rng(4)
    spots = r.normal(size=(8, 64)) * 300
    x = (spots[r.integers(0, 8, 2000)] + r.normal(size=(2000, 64)) * 40).astype(np.int64)
    pivots, centres = x[:8], spots.astype(np.int64)
    near = centroid_clustering.pivot_distances(x, pivots)
    low = centroid_clustering.lower_bounds(near, centroid_clustering.pivot_distances(centres, pivots), centroid_clustering.pivot_distances(pivots, pivots))
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (low <= exact).all()
    cluster, distance, measured = centroid_clustering.nearest(x, near, centres, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and measured < 0.7 * exact.size
