"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics come from the whole text. Their Gaussian kernel is approximated by cosines of random
projections; the normal equations of the ridge fit are summed per partition; scores are calibrated by a
monotone step fit over a histogram of raw scores, so the driver only sees arrays of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STATISTICS = ("chars", "words", "word_length", "word_spread", "upper", "digit", "symbol", "bar", "bang", "high", "stop", "comma",
              "distinct", "repeat", "pair_repeat", "line_words", "line_repeat", "symbol_end", "long_word", "top_word", "upper_start", "single")


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)))
    n = np.maximum(np.diff(offsets), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / n

    starts, ends, before = common.word_spans(data, offsets)
    words = common.span_hash(common.prefix_hash(data, common.LOWER_VALUE), starts, ends)
    length = (ends - starts).astype(float)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~<>{}[]=_\\", np.uint8))
    last = data[ends - 1] if len(ends) else data[:0]
    odd_end = ~((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90) | (last >= 128) | (last == 46) | (last == 44)) if len(ends) else np.zeros(0, bool)
    head_upper = upper[starts] if len(starts) else np.zeros(0, bool)
    for k, mask in ((4, upper), (5, digit), (6, symbol), (7, data == 124), (8, data == 33), (9, data >= 128), (10, data == 46), (11, data == 44)):
        out[:, k] = share(mask)
    new_line = data == 10
    line_no = np.cumsum(new_line)
    for i in range(rows):
        a, b = before[i], before[i + 1]
        out[i, 0] = np.log1p(offsets[i + 1] - offsets[i])
        m = b - a
        out[i, 1] = np.log1p(m)
        if m == 0:
            continue
        w, sizes = words[a:b], length[a:b]
        _, counts = np.unique(w, return_counts=True)
        out[i, 2], out[i, 3] = sizes.mean(), sizes.std()
        out[i, 12] = np.log(len(counts)) / np.log(m) if m > 1 else 1.0
        out[i, 13] = (w[1:] == w[:-1]).mean() if m > 1 else 0.0
        out[i, 14] = (w[2:] == w[:-2]).mean() if m > 2 else 0.0
        lines = line_no[starts[a:b]]
        first = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
        out[i, 15] = np.log1p(m / len(first))
        sums = np.add.reduceat(w, first)
        out[i, 16] = 1 - len(np.unique(sums)) / len(sums)
        out[i, 17] = odd_end[a:b].mean()
        out[i, 18] = (sizes > 20).mean()
        out[i, 19] = counts.max() / m
        out[i, 20] = head_upper[a:b].mean()
        out[i, 21] = (sizes == 1).mean()
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in common.text_steps(batch, "text"):
                stats = document_statistics(data, offsets)
                flat = pa.array(stats.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["id", "stats"])

    return common.lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, stats array<double>")


def held_out(id_col: str | Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text is divisible by five. A null id is held out."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    """A fitted classifier; its size depends on the number of features only."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.weights + self.phases)
        return np.hstack([z, x, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(len(col), -1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x; returns block centres and values."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in blocks]), np.array([p[1] / p[2] for p in blocks])


def fit(stats: DataFrame, labels: DataFrame, *, label_id: str = "doc_id", label_col: str = "quality", size: int = 320,
        width: float = 4.0, penalty: float = 1e-3, sums: int = 32, bins: int = 2000, seed: int = 11) -> Model | None:
    """Fit on all labelled rows of ``stats`` (id, stats) that are not held out; None when there are none.

    Null labels are no labels. ``sums`` bounds the number of partial normal equations, ``bins`` the histogram
    that the calibration sees.
    """
    known = (labels.where(F.col(label_col).isNotNull()).select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("label"))
             .where(~held_out("id")))
    rows = common.stored(stats.join(known, "id").select("stats", "label"), "quality-rows")
    k = len(STATISTICS)
    spread = rows.agg(*[F.avg(F.col("stats")[i]) for i in range(k)], *[F.stddev_pop(F.col("stats")[i]) for i in range(k)], F.count("*")).first()
    if not spread[-1]:
        return None
    centre, scale = np.array(spread[:k], float), np.maximum(np.array(spread[k:2 * k], float), 1e-6)
    rng = np.random.default_rng(seed)
    model = Model(centre, scale, rng.normal(0, 1 / width, (k, size)), rng.uniform(0, 2 * np.pi, size), np.zeros(size + k + 1), np.zeros(1), np.zeros(1))
    dim = size + k + 1

    def partial(batches):
        left, right = np.zeros((dim, dim)), np.zeros(dim)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = model.features(_matrix(part))
                left += z.T @ z
                right += z.T @ np.asarray(part.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["left", "right"])

    def total(batches):
        left, right = np.zeros((dim, dim)), np.zeros(dim)
        for batch in batches:
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left += np.frombuffer(p).reshape(dim, dim)
                right += np.frombuffer(q)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], ["left", "right"])

    kind = "left binary, right binary"
    summed = rows.coalesce(sums).mapInArrow(partial, kind).repartition(1).mapInArrow(total, kind).first()
    left, right = np.frombuffer(summed[0]).reshape(dim, dim).copy(), np.frombuffer(summed[1])
    left[np.diag_indices(dim)] += penalty * spread[-1] / size + 1e-9
    model.ridge = np.linalg.solve(left, right)

    def raws(batches):
        for batch in batches:
            x = np.clip(model.raw(_matrix(batch)), -1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint((x + 1) / 3 * bins).astype(np.int32)), batch.column(1)], ["bin", "label"])

    histogram = rows.mapInArrow(raws, "bin int, label double").groupBy("bin").agg(F.avg("label"), F.count("*")).orderBy("bin").collect()
    x = np.array([r[0] for r in histogram]) * 3 / bins - 1
    model.knots, model.values = isotonic(x, np.array([r[1] for r in histogram]), np.array([r[2] for r in histogram], float))
    return model


def score(stats: DataFrame, model: Model | None, default: float = 0.5) -> DataFrame:
    """(id, score) of every row; ``default`` when there was nothing to learn from."""
    if model is None:
        return stats.select("id", F.lit(default).alias("score"))
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(model.score(_matrix(batch)), 0, 1))], ["id", "score"])

    return stats.select("id", "stats").mapInArrow(run, f"id {kind}, score double")


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, that score at least ``threshold``; all of them without a model."""
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in common.text_steps(batch, text_col):
                yield batch.slice(i, j - i).filter(pa.array(model.score(document_statistics(data, offsets)) >= threshold))

    return common.lean(docs).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null or empty text has statistics of zero and is scored like any other; repeated rows are scored each;
    a null id is held out; other columns of either table are not read. No labels: every score is 0.5.
    """
    stats = common.stored(statistics_table(docs), "quality-statistics")
    scored = score(stats, fit(stats, labels))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
