"""Documents to token ids in five stages, each an operator of structcast.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that must be written before the next stage begins: a stage
first deletes the working tables of those before it. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structcast.llm import bpe, decontaminate, line_dedup, ngram_join, weak_quality
from structcast.llm._store import discard, release, shared_dir_path, written
from structcast.llm.queries import vocabulary

_working: list[str] = []  # tables that the stage before has made


def _end(spark: SparkSession) -> None:
    release(spark)
    discard(spark, list(_working))
    _working.clear()


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _end(spark)
        before = set(written())
        out = f(spark, docs, sf_dir)
        _working.extend(p for p in written() if p not in before)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak-label quality classifier: documents that it rejects go."""
    return weak_quality.kept(docs, weak_quality.fit(docs))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later lines that match an earlier one go, and with them documents that have nothing else."""
    out = line_dedup.deduplicated(docs)
    out = out.where((F.col("n_lines_gone") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_lines_gone") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join (five words, similarity 0.8) the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


@_stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    path = vocabulary("byte_bpe_50k.json")
    both = bpe.decode_ids(bpe.encode_texts(docs, path), path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = shared_dir_path(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, [before])
        before = path
    _end(spark)
    return docs
