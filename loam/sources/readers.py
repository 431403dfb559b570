"""Documents from files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 50 << 20
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


def read_text_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(path, text) of whole files; those above the limit come second, unread, as (path, length).

    Bytes that are no UTF-8 read as U+FFFD.
    """
    files = spark.read.format("binaryFile").load(path)
    fits = files.where(F.col("length") <= max_bytes)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return fits.select("path", text.alias("text")), files.where(F.col("length") > max_bytes).select("path", "length")


def read_json(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """One JSON object a line under a fixed schema; what does not fit is null."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, path: str, source: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(source).options(**options).load(path)


def lossy_text(raw: str = "content") -> F.Column:
    return F.make_valid_utf8(F.col(raw).cast("string"))


def within_limit(df: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents within the limit, and the others."""
    size = F.octet_length("text")
    return df.where(size <= max_bytes), df.where(size > max_bytes)
