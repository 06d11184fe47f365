"""Which names stand inside which texts, exactly and without comparing every name with every text.

Texts are read once by an automaton over the names, built in each task from a volume of bounded size; more names are
read in more passes. Names that hold one another meet by the rarest of their short pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of one automaton, and so of one pass over the texts.
VOLUME = 200_000
#: Length of the pieces by which names meet.
PIECE = 3
_built: dict[str, object] = {}


def _folded(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.select(F.lower(F.trim(F.col(column))).alias(to)).where(F.col(to) != "").distinct()


def _automaton(number: str, names: list[str]):
    """The worker's automaton of a broadcast volume; one is held at a time."""
    if number not in _built:
        import ahocorasick
        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _built.clear()
        _built[number] = made
    return _built[number]


def names_in_texts(texts: DataFrame, keys: Sequence[str], text: str, names: DataFrame, name: str, *, volume: int = VOLUME) -> DataFrame:
    """(keys, name): the lower-case names that occur anywhere in each lower-case text. Null and blank ones occur nowhere.

    The driver sees one volume of names at a time, never the texts.
    """
    spark = texts.sparkSession
    vocabulary = _folded(names, name, "__name")
    parts = max(1, -(-vocabulary.count() // volume))
    rows = texts.select(*keys, F.lower(F.col(text)).alias("__text")).where("__text <> ''")
    schema = ", ".join([*[f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys], "__names array<string>"])
    found = None
    for part in range(parts):
        words = [r[0] for r in vocabulary.where(F.pmod(F.xxhash64("__name"), F.lit(parts)) == part).collect()]
        handed, volume_id = spark.sparkContext.broadcast(words), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], handed=handed, volume_id=volume_id) -> Iterator[pa.RecordBatch]:
            if not handed.value:
                return
            made = _automaton(volume_id, handed.value)
            for batch in batches:
                hits = [sorted({word for _, word in made.iter(t)}) for t in batch.column(batch.num_columns - 1).to_pylist()]
                some = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
                kept = batch.take(some)
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array([h for h in hits if h], pa.list_(pa.string()))], [*keys, "__names"])

        one = rows.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.select(*keys, F.explode("__names").alias(name))


def _pieces(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def held_names(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b) of lower-case names where the inner name ``a`` stands inside the outer name ``b``.

    An inner name is looked up by the piece of it that the fewest outer names have; if one of its pieces is in none,
    it is inside none. Names shorter than a piece are pieces themselves.
    """
    needles, hays = _folded(inner, a, "__a"), _folded(outer, b, "__b")
    every = F.array_distinct(F.concat(*[_pieces(F.col("__b"), n) for n in range(1, PIECE + 1)]))
    hay = hays.select("__b", F.explode(every).alias("__p"))
    spread = hay.groupBy("__p").agg(F.count("*").alias("__m"))
    own = needles.select("__a", F.array_distinct(_pieces(F.col("__a"), PIECE)).alias("__ps"))
    rarest = (own.select("__a", F.size("__ps").alias("__n"), F.explode("__ps").alias("__p")).join(spread, "__p").groupBy("__a", "__n")
              .agg(F.count("*").alias("__known"), F.min(F.struct("__m", "__p")).alias("__low")).where("__known = __n").select("__a", F.col("__low.__p").alias("__p")))
    return rarest.join(hay, "__p").where(F.col("__b").contains(F.col("__a"))).select(F.col("__a").alias(a), F.col("__b").alias(b))
