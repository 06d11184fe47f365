"""Corpus preparation: quality filter, near-duplicate removal, decontamination, masking of personal data, packing.

``STAGES`` run in order, each on what the one before kept; ``run`` writes every stage's result to the cluster's
shared folder and reads it back. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalloom.llm import common, decontamination, minhash_dedup, packing, pii, quality_classifier
from vitalloom.llm.queries import tokenizer

#: SQL cannot express the classifier, the fits or the tokenizer; a brute-force version is in tests/llm.
ORACLE_SQL = None
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null texts are judged as empty ones; each row by its text alone,
    however long, so repeated rows stay or go together. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(quality_classifier.statistics_table(docs), labels)
    return quality_classifier.accepted(docs, model)


def row_key(docs: DataFrame) -> Column:
    """A string for each id in the order of ids, and one for each text of a null id after them; neither is ever the other."""
    own = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        own = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.coalesce(F.concat(F.lit("0"), own), F.concat(F.lit("1"), F.sha2("text", 256)), F.lit("1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Documents without words are no duplicates of each other. While groups are formed a row with a null id goes by a
    digest of its text, behind all real ids; of repeated rows one stays. Other columns take no part, whatever their names.
    """
    keyed = docs.withColumn("__key", row_key(docs))
    judged = common.stored(minhash_dedup.near_duplicates(keyed, SHINGLE_WORDS, SIMILARITY, id_col="__key"), "pipeline-near").withColumnRenamed("doc_id", "__key")
    repeated = judged.groupBy("__key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1")
    out = judged.where("NOT kept").select("__key").union(repeated.select("__key"))
    single = common.with_ids(keyed, out, "__key", how="left_anti")
    again = common.with_ids(keyed, repeated.where("kept"), "__key").dropDuplicates(["__key", "text"])
    return single.select(docs.columns).union(again.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay. Of equal texts all stay or all go; repeated rows are rows like others, and
    texts may be of any length. Other columns are passed on whatever their names.
    """
    hits, _ = decontamination.window_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    marked = docs.withColumn("__digest", F.xxhash64("text"))
    return common.with_ids(marked, hits.withColumnRenamed("digest", "__digest"), "__digest", how="left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the new text.

    Null texts stay null. Spans that overlap become one, by the kind of the first. Repeated rows, null ids and texts of
    any length and any number of spans are masked like others; other columns are passed on.
    """
    seen = common.stored(pii.with_candidates(docs.select("doc_id", "text")).select(pii.FOUND), "pipeline-pii")
    masked = pii.masked(docs, pii.fit(seen))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of one id; longer ones are cut, repeated rows are placed each.
    """
    return packing.pack(docs, tokenizer(), keep_ids=False)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontaminate),
          ("pii", mask_personal_data), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; empty tables give an empty result. Rows with null ids or texts, repeated rows and
    very long texts go through every stage as its docstring says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
