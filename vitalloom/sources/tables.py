"""Scans: column lists, pushed filters, tolerant schemas, JSON columns, clean text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import c


def scan(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None,
         fmt: str = "parquet", **options) -> DataFrame:
    """Read only ``columns``; ``where`` reaches the file reader when it can."""
    df = spark.read.format(fmt).options(**options).load(path)
    return (df if where is None else df.where(where)).select(*columns)


def scan_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str],
              where: Column | None = None, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 1,
              **options) -> DataFrame:
    """Read a database table, split into ranges of ``partition_column`` when given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower,
                                upperBound=upper, numPartitions=partitions)
    df = reader.load()
    return (df if where is None else df.where(where)).select(*columns)


def with_optional_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each absent column with its default; present ones get it for nulls."""
    known = set(df.columns)
    return df.withColumns({
        name: F.coalesce(c(name), _lit(value)) if name in known else _lit(value)
        for name, value in defaults.items()
    })


def _lit(value):
    return value if isinstance(value, Column) else F.lit(value)


def read_json_column(col: str | Column, schema: T.StructType | str) -> Column:
    """JSON text as a struct with declared keys; null or broken text gives nulls."""
    return F.coalesce(F.from_json(c(col), schema), F.from_json(F.lit("{}"), schema))


def write_json_column(col: str | Column) -> Column:
    """JSON text of a struct, ``{}`` for null."""
    return F.coalesce(F.to_json(c(col)), F.lit("{}"))


def json_equals(col: str | Column, key: str, value: str) -> Column:
    return F.get_json_object(c(col), f"$.{key}") == F.lit(value)


def strip_nul(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove NUL characters from text columns, nested arrays and structs included."""
    names = columns or [f.name for f in df.schema.fields]
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({n: _strip(F.col(n), types[n]) for n in names if _has_text(types[n])})


def _has_text(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_text(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_text(f.dataType) for f in t.fields)
    return isinstance(t, T.StringType)


def _strip(col: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.replace(col, F.lit("\0"), F.lit(""))
    if isinstance(t, T.ArrayType) and _has_text(t):
        return F.transform(col, lambda x: _strip(x, t.elementType))
    if isinstance(t, T.StructType) and _has_text(t):
        rebuilt = F.struct(*[_strip(col[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(col.isNotNull(), rebuilt)
    return col


# Task type per media type.
IMAGE_TASK, AUDIO_TASK, PDF_TASK = "ocr_prescription", "transcribe_audio", "parse_pdf"


def task_type(mime: str | Column) -> Column:
    """Task type of a media type, empty text for anything else."""
    low = F.lower(F.trim(F.coalesce(c(mime), F.lit(""))))
    return (F.when(low.startswith("image/"), IMAGE_TASK).when(low.startswith("audio/"), AUDIO_TASK)
            .when(low == "application/pdf", PDF_TASK).otherwise(""))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Arriving files as rows (path, time, length, content)."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def new_content(arriving: DataFrame, history: DataFrame, keys: Sequence[str], content: str,
                ident: str) -> DataFrame:
    """Arriving rows whose (keys, SHA-256 of content) is new, the first of equal copies.

    Copies fold on narrow rows (keys, digest, unique ``ident``), map-side first, so
    neither texts nor a group of copies gather in one task; the texts then meet
    the surviving idents once.
    """
    digest = F.sha2(F.col(content).cast("binary"), 256)
    firsts = (arriving.select(*keys, ident, digest.alias("content_hash")).groupBy(*keys, "content_hash")
              .agg(F.min(ident).alias("__first")))
    seen = history.select(*keys, digest.alias("content_hash")).distinct()
    fresh = firsts.join(seen, [*keys, "content_hash"], "left_anti").select("content_hash", "__first")
    return arriving.join(fresh, F.col(ident) == F.col("__first")).drop("__first")
