"""Patterns over Arrow columns of texts, by RE2: time is linear in the text, and a text without a match costs one scan.

Java's patterns try every alternative at every letter, which made long texts of ordinary prose the cost of a job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a step of its own.
STEP_BYTES = 8_000_000


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``size`` bytes."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield texts.slice(i, j - i)
        i = j


def joined(parts: Sequence[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([x.cast(kind) for x in parts]) if parts else pa.array([], kind)


def replaced(s: pa.Array, pattern: str, new: str) -> pa.Array:
    """All matches replaced; groups are $1, $2 as in Spark."""
    return pc.replace_substring_regex(s, pattern, re.sub(r"\$(\d)", r"\\\1", new))


def one_space(s: pa.Array) -> pa.Array:
    # a single blank is no match, for each match costs far more than the letters around it
    return pc.utf8_trim(replaced(s, r"\s{2,}|[\t\n\f\r]", " "), " ")


def group(s: pa.Array, pattern: str, n: int) -> pa.Array:
    """Group ``n`` of the first match; null if it is empty or nothing matches."""
    numbers = iter(range(1, 100))
    named = re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?P<g{next(numbers)}>", pattern)
    found = pc.struct_field(pc.extract_regex(s, named), f"g{n}")
    return pc.if_else(pc.fill_null(pc.not_equal(found, ""), False), found, None)


def doubles(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else float(x) for x in s.to_pylist()], pa.float64())


def before(s: pa.Array, pattern: str) -> pa.Array:
    """The part before the first match."""
    return pc.list_element(pc.split_pattern_regex(s, pattern, max_splits=1), 0)


def mapped(s: pa.Array, table: Mapping[str, object], kind: pa.DataType) -> pa.Array:
    return pa.array([table.get(x) for x in s.to_pylist()], kind)


def phrases(s: pa.Array, words: Sequence[str]) -> pa.Array:
    """Those of the lower-case phrases that a text holds, joined."""
    return pa.array(["; ".join(w for w in words if w in low) for low in pc.utf8_lower(s).to_pylist()], pa.string())


def lists(rows: int, row: np.ndarray, values: pa.Array) -> pa.Array:
    """One list for each of ``rows`` rows, of the values whose ascending ``row`` it is."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)), values)
