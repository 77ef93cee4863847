"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import stored

ROUNDS, WALK = 6, 64


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with gapless numbers from 0 in the given order, and how many rows there are.

    Rows are dealt by range, sorted and written once; a partition's first number is the count of rows in the
    partitions before it, so no task sees more than its own range. Equal rows are numbered in any order.
    """
    tie = "__place"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    kept = stored(dealt.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "rows")
    counts = sorted(map(tuple, kept.groupBy("__part").count().collect()))  # a row for each partition
    first, total = [], 0
    for part, count in counts:
        first.append((part, total))
        total += count
    bases = df.sparkSession.createDataFrame(first, "__part int, __first long")
    return kept.join(bases, "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first"), total


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number under a keyed permutation of 0 .. rows - 1.

    Rounds of a Feistel network work on the two digits of a number in mixed base a x b, the least such rectangle that
    holds all rows; a result outside walks on along its cycle until it is inside.
    """
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    b = max(1, -(-rows // a))

    def turn(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        even = k % 2 == 0
        stir = F.pmod(F.xxhash64(F.when(even, right).otherwise(left), k, F.lit(seed)), F.when(even, F.lit(a)).otherwise(F.lit(b)).cast("long"))
        return F.struct(F.when(even, (left + stir) % a).otherwise(left).alias("l"), F.when(even, right).otherwise((right + stir) % b).alias("r"))

    def once(v: Column) -> Column:
        start = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), (v % F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda v, _: F.when(v < F.lit(rows), v).otherwise(once(v)))
    return F.when(walked < F.lit(rows), walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def feistel_shards(docs: DataFrame, n_shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row: place p of the permuted row number goes to shard p mod n, slot p div n.

    Law `rows`: shard counts differ by one at most and slots have no gap. Rows are numbered by id, then crc, size and
    hash of the text; rows equal in all of these are interchangeable. A null id sorts first, a null text has size 1 and
    crc 0, an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__text"),
    )
    numbered, rows = row_numbers(narrow, ["doc_id", "text_crc32", "size", "__text"])
    place = permuted(F.col("row_number"), rows, seed)
    return numbered.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
        "row_number",
    )
