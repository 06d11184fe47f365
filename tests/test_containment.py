"""Names inside texts, names inside names, tiers, mentions, edit distances side by side and the nearest seed, against plain Python."""

import difflib
import random

import numpy as np
import pytest

from vitalloom.operators import containment as k
from vitalloom.operators import joins as j
from vitalloom.operators import similarity as s

rnd = random.Random(4)
LETTERS = "abcé "


def words(n, low, high, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("volume", [200_000, 7])
def test_names_in_texts_match_plain_search(rows, volume):
    names = words(40, 1, 5, 1) + ["AB", " ab ", "", None, "😀x"]
    texts = words(60, 0, 60, 2) + [None, "", "ABC", "z😀X", "a" * 20_000]
    got = k.names_in_texts(rows(list(enumerate(texts)), "i int, t string"), ["i"], "t", rows([(n,) for n in names], "n string"), "n", volume=volume).collect()
    folded = {n.strip().lower() for n in names if n and n.strip()}
    want = sorted((i, n) for i, t in enumerate(texts) for n in folded if t and n in t.lower())
    assert sorted((x.i, x.n) for x in got) == want
    assert k.names_in_texts(rows([(1, "x")], "i int, t string"), ["i"], "t", rows([], "n string"), "n").count() == 0


def test_held_names_match_plain_search(rows):
    inner, outer = words(80, 1, 6, 3) + ["", None, "zzz", "É"], words(80, 1, 12, 4) + ["x", None, "é"]
    got = k.held_names(rows([(x,) for x in inner], "a string"), rows([(x,) for x in outer], "b string"), "a", "b").collect()
    fold = lambda xs: {x.strip().lower() for x in xs if x and x.strip()}
    assert sorted((x.a, x.b) for x in got) == sorted((p, q) for p in fold(inner) for q in fold(outer) if p in q)


def test_tiers_in_order_with_containment_both_ways(rows):
    alias = rows([("telma", "telmisartan"), ("telma am", "telmisartan/amlodipine"), ("dolo", "paracetamol")], "k string, v string")
    rule = rows([("warfarin", "warfarin"), ("warfarin sodium", "warfarin sodium")], "k string, v string")
    hint = rows([("amlodipine", "amlodipine"), ("ramipril", "ramipril")], "k string, v string")
    raw = rows([(1, "Telma 40 tablet"), (2, "telma AM 5 mg"), (3, "Warfarin"), (4, "warfarin tab"), (5, "ramip"), (6, "xx amlodipine besylate"), (7, "zzz"), (8, ""), (9, None), (10, "  DOLO. ")], "i int, raw string")
    tiers = [j.Tier(alias, "k", "v", 0.92, "alias", "inside"), j.Tier(rule, "k", "v", 0.88, "rule"), j.Tier(hint, "k", "v", 0.80, "hint", "either")]
    from pyspark.sql import functions as F
    got = {x.i: (x["name"], x.confidence) for x in j.first_tier(raw.withColumn("raw", j.without_strength(F.col("raw"))), tiers, "raw").collect()}
    assert got == {1: ("telmisartan", 0.92), 2: ("telmisartan/amlodipine", 0.92), 3: ("warfarin", 0.88), 4: ("warfarin tab", 0.5), 5: ("ramipril", 0.8), 6: ("amlodipine", 0.8), 7: ("zzz", 0.5), 8: ("", 0.5),
                   10: ("paracetamol", 0.92)}


def test_mentions_inside_whole_messages(rows):
    items = rows([(1, "Telma"), (1, "telma am"), (1, "dolo"), (2, "dolo"), (3, "dolo"), (3, "DOLO"), (4, None), (4, " ")], "p int, item string")
    msgs = rows([(1, 1, "took TELMA am today"), (2, 1, "no dolor"), (3, 1, "nothing"), (4, 2, "nothing"), (5, 3, None), (6, 4, "dolo"), (7, 9, "dolo"), (8, 2, "x" * 30_000 + "telma")], "m int, p int, t string")
    got = {x.m: x.matched_item for x in s.mentioned_item(msgs, items, ["m"], "p", "item", "t").collect()}
    assert got == {1: "telma am", 2: "dolo", 3: None, 4: "dolo", 5: "dolo", 6: None, 7: None, 8: "dolo"}


def edits(p, q):
    row = list(range(len(q) + 1))
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for n, b in enumerate(q, 1):
            last, row[n] = row[n], min(row[n] + 1, row[n - 1] + 1, last + (a != b))
    return row[-1]


def test_distances_side_by_side():
    for seed in range(40):
        sentences, texts = [x for x in words(9, 1, 90, seed) if x], words(4, 0, 90, seed + 500)
        made = s.SideBySide(sentences)
        for t in texts + sentences[:2]:
            assert made.distances(t).tolist() == [edits(t, x) for x in sentences]


def test_close_sentences_are_all_found(rows):
    base = [x.strip() or "a" for x in words(12, 5, 40, 9)]
    near = ["".join(rnd.choice(LETTERS) if rnd.random() < 0.25 else c for c in x) for x in base for _ in range(6)]
    for volume in (20_000, 3):
        got = s.close_sentences(rows([(x,) for x in near], "a string"), rows([(x,) for x in base], "b string"), "a", "b", 0.67, volume=volume).collect()
        want = sorted((p, q, edits(p, q)) for p in set(near) for q in set(base) if 1 - edits(p, q) / max(len(p), len(q)) >= 0.67 - 1e-12)
        assert sorted(tuple(x) for x in got) == want and len(want) > 20


def test_sentences_that_hold_a_text_are_all_found(rows):
    inner, outer = words(60, 1, 4, 21), words(50, 1, 12, 22) + ["a"]
    for volume in (20_000, 7):
        got = s.sentences_holding(rows([(x,) for x in inner], "a string"), rows([(x,) for x in outer], "b string"), "a", "b", volume=volume).collect()
        assert sorted(tuple(x) for x in got) == sorted((p, q) for p in set(inner) for q in set(outer) if p in q)


def test_only_sentences_that_length_and_letters_allow_are_compared(rows, monkeypatch):
    base = ["abcd" * 10, "wxyz" * 10, "abcd" * 14, "abdc" * 10, "é" * 3]
    compared = []
    monkeypatch.setattr(s.SideBySide, "distances", lambda self, text: compared.append(len(self.sizes)) or np.zeros(len(self.sizes), int))
    monkeypatch.setattr(s, "_against_volumes", lambda left, right, a, b, volume, start, schema: start(base))
    look = s.close_sentences(None, None, "a", "b", 0.8)
    assert {x for x, _ in look("abcd" * 10)} == {base[0], base[3]} and look("q" * 40) == [] and compared == [2]


@pytest.mark.parametrize("exact", [False, True])
def test_nearest_seed_equals_the_rule(rows, exact):
    r = random.Random(11)
    vocab = ["take", "medicine", "today", "appointment", "doctor", "show", "report", "blood", "sugar", "my", "the"]
    seeds = [(n % 4, " ".join(r.choice(vocab) for _ in range(r.randint(1, 5)))) for n in range(14)] + [(5, "medicine today"), (6, ""), (7, None)]
    msgs = [" ".join("".join(r.choice("abcdefg") if r.random() < 0.15 else c for c in r.choice(vocab)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    msgs += ["medicins todays", "Medicine   TODAY", "dicine tod", "please medicine today now", "", None, "medicine today"]
    got = {x.i: (x.predicted, x.score) for x in s.nearest_seed(rows(list(enumerate(msgs)), "i int, t string"), rows(seeds, "l int, s string"), ["i"], "t", "l", "s", exact_ratio=exact).collect()}
    for i, m in enumerate(msgs):
        text, best = " ".join((m or "").lower().split()), (0.0, None)
        for label, seed in seeds:
            if not seed or not text:
                continue
            p, q = set(text.split()), set(seed.split())
            ratio = difflib.SequenceMatcher(None, text, seed).ratio() if exact else 1 - edits(text, seed) / max(len(text), len(seed))
            score = 0.96 if text == seed else 0.88 if seed in text or text in seed else max(2 * len(p & q) / (len(p) + len(q)), 0.82 * ratio)
            best = max(best, (score, label), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
        want = (str(best[1]), round(best[0], 4)) if best[0] >= 0.55 else ("unknown", 0.0)
        assert got[i] == (want[0], pytest.approx(want[1], abs=1e-4)), m
    assert got[60][1] > 0.6
    assert np.isfinite([v for _, v in got.values()]).all()
