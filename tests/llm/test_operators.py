"""Each language-data operator on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vitalloom.llm import (common, decontamination, embedding_dedup, html_extraction, license_scan, minhash_dedup, packing, passage_dedup, pii,
                           quality_classifier, suffix_dedup)
from vitalloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, t string, w string, rep long, key long, start int"
rnd = random.Random(3)
WORDS = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 1000)
TEXTS = [
    (1, prose(120, 1)), (2, prose(120, 1)), (3, prose(120, 1).replace(prose(120, 1).split()[60], "changed", 1)), (4, None), (5, ""), (6, " \t\n"),
    (7, prose(30, 7) + " " + PASSAGE + " " + prose(20, 8)), (8, prose(10, 9) + " " + PASSAGE + " " + prose(40, 10)), (9, "one"), (10, "One two three"), (11, "one TWO three"),
    (None, prose(50, 11)), (None, prose(120, 1)), (12, prose(80, 12)), (12, prose(80, 12)), (13, prose(30_000, 13)), (14, "a" * 5000), (15, "De " * 300),
    (16, "Write to Ann.Lee@mail.example.com or +1 (555) 123-4567, host 10.0.0.255, card 4111 1111 1111 1111. é😀 x@y.z"), (17, "Released under the MIT license. cc by nc; CC-BY-NC!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None, 5, "d", "t", "w", 1, 2, 3) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer
    rows = packing.pack(docs, tokenizer(), 64).collect()
    direct = Tokenizer.from_file(tokenizer())
    want = sorted((str(i), k, zlib.crc32(np.array(part, "<u4").tobytes())) for i, t in TEXTS
                  for ids in [direct.encode(t or "", add_special_tokens=False).ids + [0]] for k, part in enumerate(ids[a:a + 64] for a in range(0, len(ids), 64)))
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(placed) <= math.ceil(sum(r.length for r in rows) / 64) + 1
    assert packing.pack(none, tokenizer()).count() == 0


def test_packing_plan_fills_each_rank_once():
    for seed in range(30):
        r = random.Random(seed)
        counts = {r.randint(1, 50): r.randint(1, 300) for _ in range(r.randint(1, 30))}
        used, ranks = defaultdict(list), defaultdict(list)
        for length, a, b, first, each, base in packing.plan(counts, 50):
            for k in range(b - a):
                ranks[length].append(a + k)
                used[first + k // each].append((base + k % each * length, length))
        assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 50


def test_words_with_odd_marks_encode_as_the_tokenizer_does():
    from tokenizers import Tokenizer
    direct, r = Tokenizer.from_file(tokenizer()), random.Random(5)
    texts = ["".join(r.choice("aZé'sß<|>ıİΣ 1., \x1ć&t\n") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["x<|endoftext|>y", "don't we'll I'M", "ÀÉ. ÿ! straße,,"]
    texts += [None, "", "  \t", "plain", "ABC-- Éß.. ×÷ µm ªº naïve—x İI K K. DON'T", "x" * 30_000 + "  y"]
    want = [np.array(direct.encode(t or "", add_special_tokens=False).ids, "<u4").tolist() for t in texts]
    made = packing.WordEncoder(tokenizer())
    for part in (pa.array(texts), pa.array(["a", *texts, None])[1:-1]):
        ids, begins = made.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == want
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 3], np.int32).tobytes()), pa.py_buffer(b"a\xff ")])
    assert made.encode(broken)[0].tolist() == direct.encode("a\ufffd", add_special_tokens=False).ids


def test_a_small_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    made, fresh = packing.WordEncoder(tokenizer()), packing.WordEncoder(tokenizer())
    for seed in range(12):
        text = pa.array([prose(50, seed % 5) + " Mark?! 12,5"])
        assert made.encode(text)[0].tolist() == fresh.tokenizer.encode(text[0].as_py(), add_special_tokens=False).ids


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            sums = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d))))
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and sums % 10 == 0 or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_match_plain_patterns(spark, docs, none):
    r = random.Random(1)
    odd = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8.9", "x@y..z a@b.c.", "1" * 5000, "999.1.1.1 0000255.0.0.1", "a" * 20000 + "@b.co", "5 " * 2000, "+12"]
    odd += ["".join(r.choice("0123 4-.+()@ab_%é😀") for _ in range(r.randint(5, 120))) for _ in range(300)]
    rows = list(enumerate(odd)) + [(None, "x@y.z"), (1000, None)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for x in found:
        assert [(c.kind, c.start, c.end) for c in x.found if c.base] == base_spans(texts[x.doc_id])
    assert len(found) == len(rows)
    by_id = {x.doc_id: x.found for x in pii.find(docs).collect()}
    assert [c.kind for c in by_id[16]][:4] == ["email", "email", "ip", "card"] and by_id[4] == [] and by_id[13] == []
    assert pii.find(none).count() == 0


def test_pii_wider_spans_and_masks(spark):
    rows = [(i, f"please call mobile (555) 234-98{i:02d} today") for i in range(20)] + [(90, "Dear Dr. Anna Smith, mail bob (at) mail (dot) com"), (91, "plain words"), (92, "a@b.co")]
    docs = spark.createDataFrame([(i, t, "t", "x") for i, t in rows], "doc_id long, text string, t string, candidates string")
    seen = common.stored(pii.with_candidates(docs.select("text")), "test-pii")
    out = {r.doc_id: r for r in pii.masked(docs, pii.fit(seen)).collect()}
    assert out[3].text == "please call mobile <local_phone> today" and out[91].text == "plain words" and out[92].text == "<email>" and out[3].t == "t" and out[3].candidates == "x"


def test_pii_takes_texts_of_very_many_spans(spark):
    many = " ".join(f"u{i}@mail.example.com, +1 (555) 123-{i % 10000:04d}" for i in range(3000))
    rows = [(1, many), (2, "x@y.zz"), (3, "a@b.co+1 555 123 45678 é😀 4111 1111 1111 1111"), (4, "+1 555 123 4567 a@b.co"), (5, "+4111111111111111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(c.kind, c.start, c.end) for c in r.found if c.base] for r in pii.find(docs).collect()}
    assert all(found[i] == base_spans(t) for i, t in rows) and len(found[1]) == 6000
    model = pii.fit(common.stored(pii.with_candidates(docs.select("text")), "test-many"))
    for r in pii.masked(docs, pii.Model({}, {}, {}, 0.0)).collect():
        text, out, at = dict(rows)[r.doc_id], "", 0
        for start, end, kind in sorted((b, c, a) for a, b, c in base_spans(text)):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        assert r.text == out + text[at:]
    assert model.weights


def test_reliability_grows_with_agreement():
    counts = {"email,1,1,1,1,0": 90, "email,-1,1,0,0,-1": 10, "email,1,1,1,0,0": 50, "email,-1,1,0,0,0": 5}
    reliability, posterior = pii.estimate(counts)
    assert posterior["email,1,1,1,1,0"] > 0.9 > 0.5 > posterior["email,-1,1,0,0,-1"]
    assert reliability["shape", 1] > 0.5 > reliability["shape", -1]


def brute_links(sets, percent):
    return {(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def components(n, links):
    top = list(range(n))
    for _ in range(n):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return top


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_matches_all_pairs(spark, docs, none, size):
    base = prose(100, 50).split()
    near = []
    for k in range(60):  # copies at about the threshold of each other
        words, r = list(base), random.Random(k)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        near.append((100 + k, " ".join(words)))
    rows = [x for x in TEXTS if x[0] is not None and x[0] != 12] + near
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    top = components(len(rows), brute_links(sets, 80))
    low = {c: min(rows[i][0] for i in range(len(rows)) if top[i] == c) for c in set(top)}
    want = {rows[i][0]: (len(sets[i]), low[top[i]]) for i in range(len(rows))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(table, size).collect()}
    assert got == want
    odd = minhash_dedup.near_duplicates(docs, size).collect()
    assert len(odd) == len(TEXTS) and sum(r.doc_id == 12 and r.kept for r in odd) == 2
    assert any(r.doc_id is None and r.component_id == 1 and not r.kept for r in odd)
    assert minhash_dedup.near_duplicates(none, size).count() == 0


def test_suffix_removal_matches_all_strings(spark, docs, none, monkeypatch):
    rows = [(i, t) for i, t in TEXTS if t is None or len(t) < 6000] + [(50, "é" * 300), (51, prose(90, 12) + "x"), (52, "abc" * 100), (53, PASSAGE[3:])] + [(60 + k, f"{k:03d} " * 3 + PASSAGE + f" {k}" * 9) for k in range(12)]
    seen = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - 199):
            seen[b[i:i + 200]].add((k, i))
    want = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if len(seen[b[s:s + 200]]) > 1:
                gone[s:s + 200] = True
        want.append((str(i), len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for group in (4096, 2):  # gathered in transforms, and counted string by string
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        got = [(str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.deduplicate(table).collect()]
        assert sorted(got) == sorted(want)
    assert suffix_dedup.deduplicate(docs).count() == len(TEXTS) and suffix_dedup.deduplicate(none).count() == 0


def test_interval_expansion_finds_all_repeats():
    r = np.random.default_rng(0)
    for _ in range(40):
        x = r.integers(5, 8, int(r.integers(5, 200)))
        x = np.concatenate([x, [0], x[:len(x) // 2], [1]])
        length = int(r.integers(2, 12))
        seen = defaultdict(list)
        for i in range(len(x) - length + 1):
            seen[tuple(x[i:i + length])].append(i)
        want = np.zeros(len(x), bool)
        for places in seen.values():
            want[places] |= len(places) > 1
        assert (suffix_dedup.repeated_starts(x, length) == want).all()


def test_passages(spark, docs, none):
    got = {r.doc_id: r for r in passage_dedup.repeated_passages(docs.where("doc_id IS NOT NULL AND doc_id <> 12")).collect()}
    assert [tuple(s) for s in got[7].spans] == [(30, 90)] and [tuple(s) for s in got[8].spans] == [(10, 70)]
    assert got[7].component_id == got[8].component_id == 7 and got[1].component_id == got[2].component_id == got[3].component_id == 1
    assert [tuple(s) for s in got[2].spans] == [(0, 120)] and not got[13].spans and not got[4].spans and got[9].n_words == 1
    assert passage_dedup.repeated_passages(docs).count() == len(TEXTS) and passage_dedup.repeated_passages(none).count() == 0


def test_passages_of_common_lines_match_all_runs(spark):
    r = random.Random(8)
    lines = [prose(r.randint(8, 30), 5000 + k) for k in range(25)]
    rows = [(i, "  ".join(x for _ in range(10) for x in (r.choice(lines), prose(r.choice((0, 0, 0, 1, 2)), 7000 + r.randrange(10**6))))) for i in range(150)]
    rows += [(200 + i, prose(r.randint(0, 60), 9000 + i) + " " + " ".join(lines[:4 + i % 2]) + "\n" + prose(r.randint(0, 60), 9100 + i)) for i in range(6)]
    rows += [(300, prose(40, 9200)), (301, prose(49, 9300)), (302, prose(49, 9300) + " x"), (303, prose(50, 9400)), (304, prose(50, 9400).upper() + "\t")]
    seen = defaultdict(list)
    for i, t in rows:
        w = lower(t).split()
        for k in range(len(w) - 49):
            seen[tuple(w[k:k + 50])].append((i, k))
    want, links = defaultdict(set), set()
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                want[i].update(range(k, k + 50))
                links.add((places[0][0], i))
    got = {x.doc_id: x for x in passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(links) > 50 and len(got) == len(rows)
    lost = {i: n for i, p in want.items() if (n := len(p - {k for s in got[i].spans for k in range(s.start, s.end)}))}
    assert not lost and all(got[a].component_id == got[b].component_id for a, b in links)
    assert not got[300].spans and not got[301].spans and [tuple(s) for s in got[304].spans] == [(0, 50)]


def test_compact_windows_cover_each_sequence_once():
    r = np.random.default_rng(4)
    for _ in range(20):
        v = r.integers(0, 2**63, int(r.integers(3, 60)), dtype=np.uint64) * np.uint64(2)
        v[r.integers(0, len(v), 3)] = v[0]
        least = int(r.integers(1, 8))
        left, c, right = passage_dedup.compact_windows(v, np.array([0]), np.array([len(v)]), least)
        for i in range(len(v)):
            for j in range(i + least - 1, len(v)):
                hit = np.flatnonzero((left <= i) & (i <= c) & (c <= j) & (j <= right))
                assert len(hit) == 1 and v[c[hit[0]]] == v[i:j + 1].min()


def test_html(spark):
    page = ("<!DOCTYPE html><html><head><title>Head</title><script>var t='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><!-- x --><div class=\"top ad\">Buy</div>"
            "<article><h1>Big  title</h1><p>One &amp; <b>tw</b>o.<br>three<p>four<div class='comments'>nice</div></article><footer>&copy; me</footer></body></html>")
    rows = [(i, "u", page) for i in range(40)] + [(90, None, None), (91, "u", ""), (92, "u", "<nav>only a menu</nav>"), (93, "u", "plain words < here"), (94, "u", "<article>never closed <p class='"), (None, "u", page)]
    pages = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], "page_id long, url string, html string, n_chars long, text string")
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    assert got[0].text == got[None].text == "Big title One & two. three four" and got[0].n_chars == len(got[0].text)
    assert got[90].text == got[91].text == got[92].text == "" and got[93].text == "plain words < here" and got[94].text == "never closed"
    assert html_extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p class="notice">Note<p>One</p><p>Two</p></article>', "One Two"),
    ('<article><p>One</p><aside>Gone<p>too</article>', "One"),
    ('<article><ul><li class="share">Gone<b>x</b><li>One<li>Two</ul><p>Three</article>', "One Two Three"),
    ('<article><ul><li class="share">Gone<ul><li>inner</ul><li>One</ul>Two</article>', "One Two"),
    ('<article><table><tr><td class="ad">Gone<td>One<tr class="promo"><td>gone<tr><td>Two</table>Three</article>', "One Two Three"),
    ('<article><table><tr><td class="ad">Gone</div><table><tr><td>in</table>gone<td>One</table>Two</article>', "One Two"),
    ('<article><dl><dt class="promo">Gone<dd>One<dd class="ad">gone<dt>Two</dl>Three</article>', "One Two Three"),
    ('<article><div>One <span class="share">gone <i>x</i></div><p>Two</article>', "One Two"),
    ('<article><div class="ad"><p>Gone<div>gone</div>gone</div>One</article>', "One"),
    ('<article>One<p class="ad">Gone <br> gone <b>gone</b> gone</p> Two</article>', "One Two"),
    ('<body><div class="has-sidebar"><div id="no-comments"><p>One two three<p class="ad">gone<p>four</div><div class="sidebar">gone</div></div><nav>gone</nav>', "One two three four"),
    ('<body><article>One</article><div class="comments">many more words that are gone</div>', "One")])
def test_html_left_out_elements_end_where_html_ends_them(page, text):
    assert html_extraction.main_text(page, {}) == text


def test_decontamination(spark, docs, none, monkeypatch):
    items = [(1, PASSAGE.upper()), (2, "two three"), (3, None), (4, ""), (None, prose(30, 12)), (5, "de de de de de de de de de de de"), (5, prose(300, 13)), (6, "nowhere to be found")]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n long, window string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in TEXTS:
        w, hit, found = rx.findall(lower(t)), set(), set()
        for item, text in items:
            v = rx.findall(lower(text))
            n = min(10, len(v))
            wins = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if v else []:
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    if item is not None:
                        found.add(str(item))
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for few in (decontamination.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", few)
        got = [(str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contaminated(docs, bench).collect()]
        assert sorted(got) == sorted(want)
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0


def test_embeddings_match_all_pairs(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + r.normal(size=16) * (0.15 if i % 3 else 0.6)).tolist()) for i in range(180)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [1.0, None] * 8), (205, rows[0][1]), (206, [x * 1e200 for x in rows[1][1]]), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, rows[0][1])]
    good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {(p, q) for p, (_, x) in enumerate(good) for q, (_, y) in enumerate(good) if p != q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9}
    top = components(len(good), links)
    want = {i: (0, i) for i, _ in rows} | {good[p][0]: (sum(a == p for a, _ in links), min(good[q][0] for q in range(len(good)) if top[q] == top[p])) for p in range(len(good))}
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, unit int")
    for window in (256, 16):
        got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(table, window=window).collect()}
        assert got == want
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0]), (3, [1.0]), (3, [1.0])], "vec_id long, embedding array<float>")).where("n_links = 2").count() == 3


def planted(r, words, changes):
    """A passage and its copy with ``changes`` evenly spread, as word numbers that no other text has."""
    a = [f"p{x}" for x in r.integers(0, 10 ** 6, words)]
    b = list(a)
    for k in range(changes):
        b[(k + 1) * words // (changes + 1)] = f"c{r.integers(0, 10 ** 6)}"
    return a, b


EDITS = ((57, 1), (80, 1), (100, 2), (150, 3), (300, 6), (150, 2), (100, 1), (60, 0))


def test_similar_passages_are_found_down_to_the_similarity():
    r = np.random.default_rng(12)

    def shingles(words):
        return np.array([zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(len(words) - 4)], np.uint64)

    for words, changes in (*EDITS, (57, 3), (100, 5)):
        for _ in range(20):
            a, b = planted(r, words, changes)
            x, y = ([f"{n}{k}" for k in r.integers(0, 10 ** 6, r.integers(0, 150))] + p + [f"{n}{k}" for k in r.integers(0, 10 ** 6, 60)] for n, p in (("x", a), ("y", b)))
            first, second = set(shingles(a)), set(shingles(b))
            alike = len(first & second) / len(first | second) >= 0.8
            found = passage_dedup._passages(shingles(x), shingles(y), 46, 80)
            assert bool(found) == alike
            for i, j, p, q in found:
                one, two = set(shingles(x)[i:j]), set(shingles(y)[p:q])
                assert len(one & two) / len(one | two) >= 0.8 and min(j - i, q - p) >= 46
    total = np.concatenate([[0], np.cumsum(r.choice([1, -3.0], 60))])
    best = max(j - i for i in range(61) for j in range(i, 61) if total[j] >= total[i])
    i, j = passage_dedup._longest(total)
    assert j - i == best and total[j] >= total[i]


def test_similar_passages_link_their_documents(spark):
    """Pairs of each kind of edit among common lines: at least 95 of 100 are linked, and no clean text is."""
    r = np.random.default_rng(21)
    lines = [" ".join(f"l{k}" for k in r.integers(0, 300, 9)) for _ in range(40)]

    def around(n):
        return " ".join(lines[k] if r.random() < 0.3 else " ".join(f"o{w}" for w in r.integers(0, 10 ** 6, 9)) for k in r.integers(0, 40, n))

    rows, kinds = [], [e for e in EDITS if e[1]]
    for k in range(140):
        for n, passage in enumerate(planted(r, *kinds[k % len(kinds)])):
            rows.append((2 * k + n, f"{around(4)} {' '.join(passage)} {around(3)}"))
    rows += [(1000 + k, around(12)) for k in range(60)]
    got = {x.doc_id: x for x in passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(got[2 * k + 1].component_id == got[2 * k].component_id for k in range(140))
    assert linked >= 133, linked
    assert all(len(got[k].spans) == 0 for k in got if k >= 1000)


def test_passages_meet_beyond_the_first_and_last_text(spark):
    """Texts that share a common line, and so most least hashes: each planted pair is linked whatever ids lie around it."""
    r = np.random.default_rng(5)
    lines = [[f"l{n}_{k}" for k in range(12)] for n in range(4)]
    own = iter(range(10 ** 6))

    def fresh(n):
        return [f"w{next(own)}" for _ in range(n)]

    rows = []
    for k in range(40):
        passage = sum((fresh(4) + lines[n] for n in range(4)), fresh(4))
        for n in range(2):
            copy = list(passage)
            if n and k % 2:
                copy[35:35] = fresh(1)
            elif n:
                copy[33] = f"c{next(own)}"
            rows.append((2 * k + n, " ".join(fresh(int(r.integers(0, 40))) + copy + fresh(int(r.integers(0, 40))))))
    rows += [(1000 + k, " ".join(fresh(50) + lines[k % 4] + fresh(50))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def sequence(text):
        return np.array([zlib.crc32(" ".join(w).encode()) for w in zip(*[text.split()[i:] for i in range(5)], strict=False)], np.uint64)

    alike = [k for k in range(40) if passage_dedup._passages(sequence(rows[2 * k][1]), sequence(rows[2 * k + 1][1]), 46, 80)]
    got = {x.doc_id: x for x in passage_dedup.repeated_passages(docs).collect()}
    linked = [k for k in alike if got[2 * k].component_id == got[2 * k + 1].component_id == 2 * k]
    assert len(alike) == 40 and len(linked) >= len(alike) - 1, (len(alike), len(linked))
    assert all(not got[k].spans for k in got if k >= 1000)


def test_passages_may_lack_words_on_one_side_only():
    r = np.random.default_rng(6)

    def shingles(words):
        return np.array([zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(len(words) - 4)], np.uint64)

    for _ in range(20):
        a = [f"p{x}" for x in r.integers(0, 10 ** 6, 57)]
        b = a[:28] + [f"q{x}" for x in r.integers(0, 10 ** 6, 4)] + a[28:]
        one, two = set(shingles(a)), set(shingles(b))
        assert len(one & two) / len(one | two) >= 0.8
        x, y = ([f"{n}{k}" for k in r.integers(0, 10 ** 6, 60)] + p + [f"{n}{k}" for k in r.integers(0, 10 ** 6, 30)] for n, p in (("x", a), ("y", b)))
        assert passage_dedup._passages(shingles(x), shingles(y), 46, 80) and passage_dedup._passages(shingles(y), shingles(x), 46, 80)


def test_a_pass_knows_what_it_showed():
    """Whoever shares the first signs of a vector, as many as its chance counts, is within the window and not beyond a border."""
    r, window, p = np.random.default_rng(8), 3, 1 - np.arccos(0.9) / np.pi
    for n, bits in ((1, 1), (5, 2), (40, 3), (60, 12), (30, 48)):
        signs = np.sort(r.integers(0, 2 ** bits, n)) << (embedding_dedup.SIGNS - bits)
        for opened, closed in ((True, True), (False, True), (True, False)):
            unseen = embedding_dedup.shown(signs, window, 0.9, opened, closed)
            for i in range(n):
                if unseen[i] == 0:
                    continue
                depth = round(np.log(1 - np.exp(unseen[i])) / np.log(p)) if unseen[i] > -20 else 0
                mates = np.flatnonzero(signs >> (embedding_dedup.SIGNS - depth) == signs[i] >> (embedding_dedup.SIGNS - depth))
                assert abs(mates - i).max() <= window
                assert (opened or mates[0] > 0) and (closed or mates[-1] < n - 1)


def test_crowded_vectors_keep_their_links(spark):
    """A third of the vectors in a cone, links planted in and outside it, windows far smaller than the cone."""
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, axis = unit(r.normal(size=(3000, 64))), unit(r.normal(size=64))
    x[:1000] = np.sqrt(0.75) * axis + 0.5 * unit(x[:1000] - np.outer(x[:1000] @ axis, axis))
    near = np.concatenate([x[:300], x[2000:2300]])
    to = np.concatenate([x[500:800], x[2500:2800]])
    to = unit(to - (to * near).sum(1, keepdims=True) * near)
    x = np.vstack([x, 0.91 * near + np.sqrt(1 - 0.91 ** 2) * to])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in embedding_dedup.near_duplicates(table, window=16).collect()}
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.995 * want.sum()
    both = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x[2900:])], "rep long, unit binary")
    edges = embedding_dedup.block_links(both, 0.9, 64)
    y = x[2900:]
    top = components(len(y), {(a, b) for a, b in zip(*np.nonzero(y @ y.T >= 0.9)) if a != b})
    mine = components(len(y), {(e.a, e.b) for e in edges.collect()} | {(e.b, e.a) for e in edges.collect()})
    assert list(top) == list(mine)


def test_quality_learns_and_skips_held_out_rows(spark, docs, none):
    rows = [(i, prose(60, i) + ".") for i in range(300)] + [(1000 + i, " ".join(w + "$$$" for w in prose(60, i).split())) for i in range(300)] + [(5000, None), (5001, ""), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    labels = [(i, 1 if i < 1000 else 0) for i, _ in rows if i is not None and i < 2000] + [(None, 1), (5, None)]
    flipped = [(i, 1 - q) if i in held and q is not None else (i, q) for i, q in labels]
    make = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(table, make(labels)).collect()}
    assert all(got[i].predicted == (i < 1000) for i, _ in rows if i is not None and i < 2000)
    assert {i for i in got if got[i].held_out} == held | {None} and all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in quality_classifier.classify(table, make(flipped)).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})
    assert quality_classifier.classify(docs, make([(1, None)])).where("score = 0.5").count() == len(TEXTS)
    assert quality_classifier.classify(none, make(labels)).count() == 0


def test_licences(spark, docs, none):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[17].n_base, got[17].first_word, got[17].last_word, got[17].base_labels, got[17].labels) == (3, 1, 8, "cc-by-nc,mit", "cc-by-nc,mit") and got[17].score == 1
    assert got[4].n_words == 0 and got[5].n_base == 0 and got[4].first_word is None and got[1].labels == "" and len(got[13].places) == 0
    more = spark.createDataFrame([(1, "This work is licensed under the GNU General Public License, version 3."), (2, "gnu general public license"), (3, "cc by cc by nc nc")], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.n_base) for r in license_scan.scan(more).collect()}
    assert found == {1: ("gpl-3", 0), 2: ("", 0), 3: ("cc-by-nc", 1)}
    assert license_scan.scan(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (98, 99), (7, 7)] + [(500, 501 + k) for k in range(30)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 98 for i in (98, 99, 100)} | {i: 500 for i in range(500, 531)}
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_pairs_are_compared_in_full_only_for_what_they_add(monkeypatch):
    """A family of edited copies: the same words and links as from all pairs, with fewer full comparisons."""
    r, full = np.random.default_rng(9), passage_dedup._passages
    base = [f"b{k}" for k in range(160)]
    texts = [common.shingle_hashes(np.array([zlib.crc32(w.encode()) for w in copy], np.uint64), 5) for copy in (
        [f"e{r.integers(0, 10 ** 6)}" if r.random() < 0.025 else w for w in base] for _ in range(24))]
    pairs = [(x, y) for x in range(24) for y in range(x + 1, 24)]
    want = [np.zeros(160, bool) for _ in texts]
    for x, y in pairs:
        for i, j, p, q in full(texts[x], texts[y], 46, 80):
            want[x][i:j + 4] = want[y][p:q + 4] = True
    calls = []
    monkeypatch.setattr(passage_dedup, "_passages", lambda *a: calls.append(a) or full(*a))
    done = [np.zeros(len(t) + 5, bool) for t in texts]
    found = list(passage_dedup._news(texts, done, list(range(24)), pairs, 5, 46, 80))
    assert all((d[:160] == w).all() for d, w in zip(done, want, strict=True)) and len(calls) < len(pairs)
    assert len({passage for passage in found}) == len(found) and {k for f in found for k in f[:2]} == set(range(24))
    calls.clear()
    assert not list(passage_dedup._news(texts, [np.ones(len(t) + 5, bool) for t in texts], [0] * 24, pairs, 5, 46, 80)) and not calls


def test_no_passage_lies_beyond_its_reach():
    r = np.random.default_rng(10)
    for _ in range(6):
        x, y = np.arange(40), np.arange(40)
        for k in range(int(r.integers(1, 5))):
            x[r.integers(0, 40)], y = 1000 + k, np.insert(y, int(r.integers(0, 40)), 2000 + k)
        met = np.flatnonzero(np.isin(x, y))
        reach = passage_dedup._reach(met, np.flatnonzero(np.isin(y, x)), len(x), len(y), 20, 80)
        for i in range(len(x)):
            for j in range(i + 20, len(x) + 1):
                a = set(x[i:j].tolist())
                for p in range(len(y)):
                    for q in range(p + 20, len(y) + 1):
                        b = set(y[p:q].tolist())
                        if 5 * len(a & b) >= 4 * len(a | b):
                            assert reach[0][i:j].all() and reach[1][p:q].all()


def test_pairs_of_a_family_lie_in_one_cell(spark, monkeypatch):
    """30 families of 4 texts: each text goes to its family's cell alone, and pairs across families still are compared."""
    from vitalloom.llm import common, passage_dedup

    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(f * 4 + m, words(f, 70) + " " + words(1000 + f * 4 + m, 5) + (" " + words(9, 60) if f > 27 else "")) for f in range(30) for m in range(4)]
    pairs = [(f * 4 + m, f * 4 + n) for f in range(30) for m in range(4) for n in range(m + 1, 4)] + [(115, 117), (112, 119)]
    roots = spark.createDataFrame([(u, u // 4 * 4) for u, _ in texts], "uid long, root long")
    kept, put = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: kept.setdefault(name, put(df, name)))
    monkeypatch.setattr(passage_dedup, "SIDE", 4)
    none = spark.createDataFrame([], "uid long, spans array<struct<start:int,end:int>>")
    got = passage_dedup._compared(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "uid long, text string"), none, roots, 5, 46, 80, "few").collect()
    assert {r.uid for r in got if r.a // 4 == r.b // 4} == {u for u, _ in texts}
    assert any((r.a, r.b) == (115, 117) or (r.a, r.b) == (112, 119) for r in got)
    cells = kept["few-cells"].where("a div 4 = b div 4").selectExpr("a div 4 f", "cell").distinct()
    assert cells.count() == 30
