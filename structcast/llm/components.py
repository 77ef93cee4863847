"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around the smallest node that they reach among themselves."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    half = np.cumsum([0] + [len(p[0]) for p in parts for _ in range(2)])
    a = np.concatenate([at[half[2 * k] : half[2 * k + 1]] for k in range(len(parts))])
    b = np.concatenate([at[half[2 * k + 1] : half[2 * k + 2]] for k in range(len(parts))])
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        go = low < high
        if not go.any():
            break
        a, b, low, high = a[go], b[go], low[go], high[go]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    out = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[root[out]]), pa.array(nodes[out])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that links reach) for every node of links (a, b).

    Before the rounds, tasks contract what they hold of the links, dealt by either end in parts that Spark may split.
    Each round takes the smallest root among the neighbours and then the root of the root, which shortens long chains
    about by half; it ends when no root changes. Every round is written to the shared folder. Minima are taken before
    the shuffle, and hot nodes only meet in joins that Spark can split. No links give an empty result.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    for key in ("a", "b", "a"):
        links = links.hint("rebalance", key).mapInArrow(_contracted, "a long, b long")
    links = stored(links, "stars")
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        near = both.join(now.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("low"))
        hooked = now.join(near, "node").select("node", F.least("root", "low").alias("next"), F.col("root").alias("old"))
        of_root = now.select(F.col("node").alias("next"), F.col("root").alias("far"))
        then = stored(hooked.join(of_root, "next", "left").select("node", F.least("next", "far").alias("root"), "old"), "roots")
        moved = then.where("root < old").limit(1).count()
        now = then.select("node", "root")
        if not moved:
            return now
