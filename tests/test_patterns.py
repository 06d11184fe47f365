"""Text patterns over Arrow columns: results on odd rows, and time that does not rest on how often Java retries."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalloom.functions import patterns as p
from vitalloom.operators import documents as d
from vitalloom.operators import extraction as x

PROSE = "the old gear of 3 rings was seen on 12 may and 40 more were sold by order, they said to 5 men "


def test_steps_cover_all_rows_and_spaces_fold():
    texts = pa.array(["a" * 50, None, "", "b" * 500, "c \t d", " e\n\n f  "])
    for size in (1, 60, 10_000):
        assert pa.concat_arrays(list(p.steps(texts, size))).equals(texts)
    assert p.one_space(texts).to_pylist()[-2:] == ["c d", "e f"]
    assert p.lists(4, np.array([1, 1, 3]), pa.array([7, 8, 9])).to_pylist() == [[], [7, 8], [], [9]]


def test_long_prose_is_read_in_linear_time():
    long = pa.array([PROSE * 20_000 + " TAB CALPOL 500 mg BD"])
    began = time.process_time()
    found, _ = x.segments(long)
    assert found.to_pylist()[-1] == "TAB CALPOL 500 mg BD" and time.process_time() - began < 8


def test_items_and_labs_of_null_and_mixed_rows(rows):
    texts = [None, "", PROSE, "Rx TAB METFORMIN 500mg BD SYRUP ALEX 2/3 teaspoon", "TSH - 3.5 uIU/mL normal: 0.4-4.0\nHb 9 g/dL"]
    got = rows(list(enumerate(texts)), "i int, t string").select("i", x.item_array("t").alias("a"), x.lab_array("t").alias("b")).orderBy("i").collect()
    assert [len(r.b) for r in got] == [0, 0, 0, 0, 2] and [len(r.a) for r in got[:2]] == [0, 0]
    items = [r for r in got[3].a if r["item"]]
    assert [(r.item, round(r.dose.value, 3), r.dose.unit, r.frequency) for r in items] == [("METFORMIN", 500.0, "mg", "BD"), ("ALEX", 0.667, "teaspoon", None)]
    assert (got[4].b[0].test_name, got[4].b[0].value, got[4].b[0].low, got[4].b[0].high) == ("tsh", 3.5, 0.4, 4.0)


@pytest.mark.parametrize("budget", [1, 3, 5])
def test_is_cut_equals_the_cut_text(rows, budget):
    keep = d.keep_words("prescription")
    texts = ["", " ", "a b c", "\na b c\n", "tab x mg", "tab x mg\nother words", "tab a\ntab b c", "a b c d e f", "tab a b c d", "\x0b a b c \x0b"]
    got = rows([(t,) for t in texts], "t string").select(d.is_cut("t", budget, keep).alias("a"), d.truncate_keeping("t", budget, keep)["truncated"].alias("b"), F.col("t")).collect()
    assert [(r.t, r.a) for r in got] == [(r.t, r.b) for r in got]


def test_words_of_all_types_are_counted_in_one_pass(rows):
    table = {"one": ("ab", "abc", "b"), "two": ("abc", "zz")}
    got = rows([("xabcab",), ("",), (None,)], "t string").select(d.held_counts("t", table).alias("n")).collect()
    assert [r.n for r in got] == [[3, 1], [0, 0], None]
