"""Best-fit packing of tokenised documents into sequences of bounded length.

Pieces are packed by a plan over the histogram of their lengths: best fit, longest first, over counts. The plan has
a few rows for each length up to the capacity, whatever the number of documents. Each piece then takes its planned
slot by its rank among the pieces of its length. Ranks are counted within salted parts of a length, so a length that
holds a third of all pieces is dealt over many tasks.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Stems, marks and odd words that a worker remembers with their ids, in each of two generations.
REMEMBERED = 150_000
#: Bytes of text that are encoded together.
STEP_BYTES = 1_500_000
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
MARKS = "-.,:;!?#$%&*()|"
#: A run of letters and a run of marks, a pre-token each. The tokenizer's normaliser only lower-cases such a word.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[" + re.escape(MARKS) + "]*$"
STEM = re.compile(f"[{LETTERS}]+")
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts, from the ids of their distinct words.

    Holds for tokenizers whose normaliser and pre-tokenizer never look across white space, and which drop it; each
    word is then encoded alike wherever it stands. A word of letters and marks is encoded as its two parts. Parts are
    remembered in two generations of bounded size.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.closes[number] = token.endswith("</w>")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of all ``parts``."""
        missing = [p for p in parts if p not in self.new]
        if len(self.new) + len(missing) > REMEMBERED and self.new:
            self.old, self.new, missing = self.new, {}, parts
        again = {p: self.old[p] for p in missing if p in self.old}
        self.new.update(again)
        fresh = [p for p in missing if p not in again] if again else missing
        stems = [p for p in fresh if STEM.fullmatch(p)]
        for at in range(0, len(stems), 2000):
            some = stems[at:at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = [0, *(np.flatnonzero(self.closes[ids]) + 1).tolist()]
            if len(cut) != len(some) + 1:
                raise ValueError("the tokenizer does not close each pre-token with </w>")
            raw = ids.tobytes()
            self.new.update((stem, raw[4 * a:4 * b]) for stem, a, b in zip(some, cut, cut[1:], strict=False))
        other = [p for p in fresh if p not in self.new]
        self.new.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the place where each begins; null is empty."""
        try:
            texts = texts.fill_null("")
            texts.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        plain, low = pc.match_substring_regex(coded.dictionary, PLAIN), pc.utf8_lower(coded.dictionary)
        first = pc.if_else(plain, pc.utf8_rtrim(low, MARKS), coded.dictionary)
        second = pc.if_else(plain, pc.utf8_ltrim(low, LETTERS), "")
        parts = pa.concat_arrays([first, second]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        self.learn(names)
        known = [self.new[p] for p in names]
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of_word = parts.indices.to_numpy().reshape(2, -1).T.ravel()
        ids, ends = _strung(ids, size, of_word)
        bounds = np.append(0, ends[1::2])
        ids, ends = _strung(ids, np.diff(bounds), coded.indices.to_numpy())
        return ids, np.append(0, ends)[words.offsets.to_numpy() - words.offsets[0].as_py()]


def _strung(ids: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids``, of these sizes, strung together in an order, and where each ends."""
    long = size[order]
    ends = np.cumsum(long)
    at = np.repeat((np.cumsum(size) - size)[order] - (ends - long), long)
    at += np.arange(len(at))
    return ids[at], ends


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document: its ids and one id 0, cut every ``capacity`` ids.

    A null or empty text is the id 0 alone. ``ids`` holds little-endian 32-bit ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        for batch in batches:
            for i, j, _, _ in common.text_steps(batch, "text", STEP_BYTES):
                flat, begins = made.encode(batch.column(1).slice(i, j - i))
                rows: list[list] = [[] for _ in range(len(names))]
                for n in range(j - i):
                    ids = flat[begins[n]:begins[n + 1]].tobytes() + b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        for column, value in zip(rows, (i + n, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]], *[pa.array(x, pa.binary()) for x in rows[5:]]], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return common.lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Rows (length, first rank, end rank, first sequence, pieces in each sequence, offset of the first): the pieces of
    ``length`` with ranks from first to end fill consecutive sequences from ``first sequence`` on.
    """
    rows, free, sizes, sequences = [], {}, [], 0  # free: space -> runs (first sequence, number)

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in free:
                bisect.insort(sizes, space)
                free[space] = []
            free[space].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                space = sizes[at]
                first, number = free[space].pop()
                if not free[space]:
                    del free[space]
                    sizes.pop(at)
            else:
                space, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            each = space // length
            full = min(number, left // each)
            base = capacity - space
            if full:
                rows.append((length, rank, rank + full * each, first, each, base))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = number - full
            if rest and 0 < left < each:
                rows.append((length, rank, rank + left, first + full, left, base))
                put(space - left * length, first + full, 1)
                rank, left, rest, full = rank + left, 0, rest - 1, full + 1
            put(space, first + full, rest)
    return rows


def place(pieces: DataFrame, capacity: int = 2048, rows_per_part: int = 200_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of the stored table ``pieces`` (doc_id, piece, start, length, ...).

    Only the histogram (at most ``capacity`` rows) reaches the driver; the plan is broadcast, its size is bounded
    by the capacity. Repeated rows take a slot each.
    """
    spark = pieces.sparkSession
    parts = max(64, -(-pieces.count() // rows_per_part))
    salted = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counted = common.stored(salted.groupBy("length", "__part").agg(F.count("*").alias("__n")), "packing-counts")
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("__n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), T.StructType([T.StructField(x, T.LongType()) for x in ("__length", "__from", "__to", "__first", "__each", "__base")]))
    before = counted.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("__rank", F.row_number().over(within) - 1).join(before.drop("__n"), ["length", "__part"])
              .withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0))))
    step = F.col("__rank") - F.col("__from")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return placed.select(*pieces.columns, (F.col("__first") + F.floor(step / F.col("__each"))).cast("long").alias("sequence_id"),
                         (F.col("__base") + step % F.col("__each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Cut, plan and place whole ``documents``; an empty table gives an empty result.

    One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset. Null ids and repeated
    rows are packed like any other row; other columns are not read.
    """
    return place(common.stored(token_pieces(docs, tokenizer, capacity, keep_ids), "packing-pieces"), capacity)
