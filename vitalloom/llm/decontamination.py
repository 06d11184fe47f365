"""Benchmark decontamination: exact containment of item windows in documents by a prefix-filtered join.

A window is ``size`` consecutive words of an item (or a whole shorter item). Words are ordered by their number of
places in the documents; a document that holds a window holds its rarest word, so that word is the prefix of the
window and the join key. Length and position bound the match, and the words themselves confirm it. All of it is
DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to this number are broadcast (about 60 MB); more take the two-step shuffle join.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words of a text; none of a null."""
    return F.array_remove(F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window, n): every window of every item, a window's words joined by a space."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = own.select("item", "w", F.least(F.size("w"), F.lit(size)).alias("n"))
    return (cut.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
            .select("item", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("window"), "n").distinct())


def rarest_words(windows: DataFrame, places: DataFrame) -> DataFrame:
    """(window, n, tokens, rare, at): each window's rarest word and its place; windows with a word that no document has are left out."""
    spread = windows.select("window", "n", F.split("window", " ").alias("tokens")).select("window", "n", "tokens", F.posexplode("tokens").alias("at", "word"))
    return (spread.join(places, "word").groupBy("window", "n", "tokens")
            .agg(F.count("*").alias("known"), F.min(F.struct("places", "word", "at")).alias("low")).where("known = n")
            .select("window", "n", "tokens", F.col("low.word").alias("rare"), F.col("low.at").alias("at")))


def window_hits(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, start, n, window) of every place where a window stands, and the windows of the items."""
    windows = common.stored(item_windows(items, size), "leak-windows")
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    vocabulary = windows.select(F.explode(F.split("window", " ")).alias("word")).distinct()
    few = windows.count() <= BROADCAST_WINDOWS
    places = texts.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary) if few else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    keyed = common.stored(rarest_words(windows.select("window", "n").distinct(), places), "leak-prefixes")
    start = F.col("pos") - F.col("at")
    inside = (F.col("word") == F.col("rare")) & (start >= 0) & (start + F.col("n") <= F.col("m"))
    same = F.slice("w", start + 1, F.col("n")) == F.col("tokens")
    if few:
        spread = texts.select("doc_id", "digest", "w", F.size("w").alias("m"), F.posexplode("w").alias("pos", "word"))
        hits = spread.join(F.broadcast(keyed), inside & same)
    else:
        spread = texts.select("doc_id", "digest", F.size("w").alias("m"), F.posexplode("w").alias("pos", "word"))
        found = spread.join(keyed, inside).drop("word", "rare")
        hits = found.alias("f").join(texts.alias("t"), F.expr("f.doc_id <=> t.doc_id AND f.digest <=> t.digest")).select("f.*", "t.w").where(same)
    return common.stored(hits.select("doc_id", "digest", start.alias("start"), "n", "window"), "leak-hits"), windows


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A null text has no words. Repeated rows and null ids are reported like any other row. Items without words, and
    an empty item table, hit nothing; null item ids are not listed. Other columns are not read.
    """
    hits, windows = window_hits(docs, items, size)
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
                          lambda s, x: F.struct(F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
                                                (s["total"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"]))).alias("total")),
                          lambda s: s["total"])
    spans = hits.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "n")).alias("spans")).select("doc_id", "digest", covered.alias("n_hit"))
    named = (hits.select("doc_id", "digest", "window").distinct().join(windows.select("window", "item"), "window")
             .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items")))
    own = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    key = "{0}.doc_id <=> d.doc_id AND {0}.digest <=> d.digest"
    joined = own.alias("d").join(spans.alias("s"), F.expr(key.format("s")), "left").join(named.alias("i"), F.expr(key.format("i")), "left")
    items_of = F.coalesce(F.col("i.items"), F.array().cast("array<string>"))
    return joined.select("d.doc_id", "d.n_words", F.coalesce(F.col("s.n_hit"), F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce(F.col("s.n_hit"), F.lit(0)) > 0).alias("contaminated"))
