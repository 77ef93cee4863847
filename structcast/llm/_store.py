"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one machine (tests) gets a new temporary folder; a cluster's executors would each write to their own, so there it is an error."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="structcast-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def shared_dir_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that discard() leaves alone unless it is named."""
    return f"{shared_dir(spark)}/structcast/{name}-{uuid.uuid4().hex}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = shared_dir_path(spark, name)
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df, written to the shared folder and read back: later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths that fresh_path() has given and discard() has not taken away."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables; only for callers whose results no longer need them."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written:
            _written.remove(path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as by rows, so that long texts cannot fill a worker's memory."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def maybe_among(keys: DataFrame, column: str, slots: int = 1 << 20):
    """A test for columns: False only for values that aren't in keys[column]; a filter before a join.

    The driver gets the hash slots in use, at most `slots`, and the test holds a bit for each; with very many keys it
    lets everything through.
    """
    rows = keys.select(F.pmod(F.xxhash64(column), F.lit(slots)).alias("slot")).distinct().collect()
    bits = [0] * (slots >> 5)
    for (slot,) in rows:
        bits[slot >> 5] |= 1 << (slot & 31)
    held = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")

    def test(value):
        slot = F.pmod(F.xxhash64(value), F.lit(slots))
        return F.call_function("shiftright", F.element_at(held, F.shiftright(slot, 5).cast("int") + 1), slot.bitwiseAND(F.lit(31)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test


class Slots:
    """A filter by the keys of a stored table: lets through all rows whose key may be among them, for a join that decides.

    A bit for each hash slot, 16 slots or more a key, in words of 64 bits that go to all tasks as a broadcast table of at
    most 2**MOST_BITS / 64 rows; beyond that size it lets more through. The driver holds no keys.
    """

    MOST_BITS = 26

    def __init__(self, keys: DataFrame, *columns: str):
        bits = min(self.MOST_BITS, max(16, (16 * keys.count()).bit_length()))
        self.mask = (1 << bits) - 1
        slot = self._slot(*columns)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        self.words = keys.groupBy(F.shiftright(slot, 6).alias("__word")).agg(F.bit_or(one).alias("__bits"))

    def _slot(self, *columns):
        return F.xxhash64(*columns).bitwiseAND(F.lit(self.mask))

    def marked(self, df: DataFrame, name: str, *columns) -> DataFrame:
        """df with a boolean column that is False only for rows whose key is not there."""
        slot = self._slot(*columns)
        bit = F.call_function("shiftright", F.col("__bits"), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        joined = df.join(F.broadcast(self.words), F.shiftright(slot, 6) == F.col("__word"), "left")
        return joined.select(*[df[c] for c in df.columns], F.coalesce(bit, F.lit(False)).alias(name))

    def among(self, df: DataFrame, *columns) -> DataFrame:
        return self.marked(df, "__maybe", *columns).where("__maybe").drop("__maybe")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of DataFrames that are no longer referred to; its cleaner learns of them by garbage collection."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
