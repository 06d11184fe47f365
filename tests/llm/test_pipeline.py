"""The pipeline against a plain version of its stages on a small corpus, and its stages on an empty one."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from vitalloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(8)
WORDS = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(500)]


def prose(seed, n=70):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus():
    rows = [(i, prose(i)) for i in range(150)]
    rows += [(200 + i, " ".join(w + "$$$" for w in prose(1000 + i).split())) for i in range(100)]
    rows += [(400 + i, prose(i)) for i in range(10)] + [(420 + i, prose(i).replace(prose(i).split()[40], "changed", 1)) for i in range(10)]
    rows += [(450 + i, prose(2000 + i) + " " + prose(9999, 14) + " " + prose(3000 + i, 20)) for i in range(5)]
    rows += [(460 + i, prose(4000 + i) + f" Mail ann{i}@mail.example.com or +1 (555) 123-45{i:02d}. " + prose(5000 + i, 30)) for i in range(10)]
    rows += [(None, prose(6000)), (None, prose(0)), (480, prose(7000)), (480, prose(7000))]
    return rows


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1, 0) for i, _ in rows if i is not None and i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(9999, 14)), (2, "never seen words of an item"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = [(i, t) for i, t in rows if "$$$" not in t]
    kept, sets = [], []
    for i, t in sorted(good, key=lambda x: (x[0] is None, x[0] or 0)):
        s = shingles(t)
        if not any(100 * len(s & o) >= 80 * len(s | o) for o in sets):
            kept.append((i, t))
        sets.append(s)
    leak = re.findall(r"[a-z0-9]+", prose(9999, 14).lower())
    clean = [(i, t) for i, t in kept if not any(" ".join(leak[k:k + 10]) in " ".join(re.findall(r"[a-z0-9]+", t.lower())) for k in range(len(leak) - 9))]
    masked = [(i, re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "<phone>", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>", t))) for i, t in clean]
    from tokenizers import Tokenizer
    direct = Tokenizer.from_file(tokenizer())
    want = sorted((str(i), zlib.crc32(np.array(direct.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in masked)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in out) == want
    placed = defaultdict(int)
    for r in out:
        placed[r.sequence_id] += r.length
    assert max(placed.values()) <= 2048 and len(placed) <= -(-sum(placed.values()) // 2048) + 1


def test_null_ids_and_texts_meet_no_other_rows(spark, tmp_path):
    t, long = prose(1), prose(2, 40_000)
    rows = [(7, t), (42, t), (None, None), (None, None), (None, t), (8, None), (-5, long), (3, long), (None, prose(3)), (None, prose(3)), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, x, "en", None, 1, "k", "d", 5) for i, x in rows], SCHEMA + ", __x string, digest string, id int")
    got = sorted((str(r.doc_id), len(r.text or "")) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == sorted([("7", len(t)), ("None", 0), ("8", 0), ("-5", len(long)), ("None", len(prose(3))), ("9", 0)])
    key = {r.doc_id: r.k for r in docs.where("doc_id IS NOT NULL").select("doc_id", corpus_pipeline.row_key(docs).alias("k")).collect()}
    assert sorted(key, key=key.get) == sorted(key)
    spark.createDataFrame([(1, prose(9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.decontaminate, corpus_pipeline.mask_personal_data):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(i), x or "") for i, x in rows)
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).where("start = 0").count() == len(rows)


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0
