"""Texts in from any of Spark's sources, and results out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import Extractor


def read_texts(spark: SparkSession, path: str, source: str = "text", text_col: str = "value", whole: bool = False, **options) -> DataFrame:
    """Rows of any file source with its text column as `text`, and the file in `path`; whole: a text file is one row."""
    reader = spark.read.format(source).options(**options)
    if source == "text" and whole:
        reader = reader.option("wholetext", True)
    df = reader.load(path)
    return df.withColumnRenamed(text_col, "text").withColumn("path", F.input_file_name())


def read_chunks(spark: SparkSession, path: str, schema: str, source: str = "json", **options) -> DataFrame:
    """A stream of chunk files."""
    return spark.readStream.format(source).schema(schema).options(**options).load(path)


def write_split(df: DataFrame, shaped: str, good: str, bad: str, source: str = "parquet", mode: str = "errorifexists") -> None:
    """Rows that are ok with their data to one place, the others with raw text and errors to another; df is evaluated once."""
    rest = [c for c in df.columns if c != shaped]
    df = df.persist(StorageLevel.DISK_ONLY)
    kept = df.where(F.col(f"{shaped}.ok"))
    failed = df.where(~F.coalesce(F.col(f"{shaped}.ok"), F.lit(False)))
    kept.select(*rest, F.col(f"{shaped}.data").alias("data"), F.col(f"{shaped}.score").alias("score")).write.format(source).mode(mode).save(good)
    failed.select(*rest, F.col(f"{shaped}.raw").alias("raw"), F.col(f"{shaped}.errors").alias("errors")).write.format(source).mode(mode).save(bad)
    df.unpersist()


def extract_table(spark: SparkSession, path: str, extractor: Extractor, text_col: str, source: str = "parquet", **options) -> DataFrame:
    """A table of any source with the extractor's result beside its columns."""
    return spark.read.format(source).options(**options).load(path).transform(extractor.into(text_col))
