"""Exact top-k inner-product search: a ball tree for each shard, searched by branch and bound."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import bounded_batches, fresh_path, stored

LEAF = 128


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows without rounding, held to the range of a long."""
    most = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


class BallTree:
    """Distinct vectors in leaves; a node has a centre and a radius, children come after their parent.

    ids[first[v] : first[v + 1]] are the smallest ids of vector v, in order: the first k + 1 are all that a query for k
    can need when it leaves out itself.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        group = np.cumsum(new) - 1
        keep = np.arange(len(ids)) - np.flatnonzero(new)[group] <= k
        points = vectors[new]
        counts = np.bincount(group[keep], minlength=len(points))
        starts = np.cumsum(counts) - counts
        held = ids[keep]
        place, nodes = np.arange(len(points)), []
        real = points.astype(np.float64)

        def grow(lo: int, hi: int) -> int:
            own = real[place[lo:hi]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            n = len(nodes)
            nodes.append([lo, hi, -1, -1, centre, away.max()])
            if hi - lo > LEAF:
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                cut = np.argsort(own @ (b - a), kind="stable")
                place[lo:hi] = place[lo:hi][cut]
                mid = (lo + hi) // 2
                nodes[n][2], nodes[n][3] = grow(lo, mid), grow(mid, hi)
            return n

        if len(points):
            grow(0, len(points))
        self.points = points[place]
        counts, starts = counts[place], starts[place]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ids = held[np.repeat(starts - self.first[:-1], counts) + np.arange(len(held))] if len(held) else held
        self.lo, self.hi, self.left, self.right = (np.array([x[i] for x in nodes], np.int64) for i in range(4))
        self.centre = np.array([x[4] for x in nodes]).reshape(len(nodes), vectors.shape[1])
        self.radius = np.array([x[5] for x in nodes])

    NAMES = ("points", "first", "ids", "lo", "hi", "left", "right", "centre", "radius")

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as found:
            for n in cls.NAMES:
                setattr(tree, n, found[n])
        return tree

    def leaves(self, queries: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, leaf and upper bound for all leaves that may hold a score of at least the query's kth, best bound first."""
        real = queries.astype(np.float64)
        norm = np.sqrt((real**2).sum(1))
        found = []
        front = [(0, np.arange(len(queries)))] if len(self.lo) else []
        while front:
            node, who = front.pop()
            bound = real[who] @ self.centre[node] + norm[who] * self.radius[node]
            bound += 1e-9 * (np.abs(bound) + norm[who] * (np.abs(self.centre[node]).max(initial=0) + self.radius[node])) + 1e-6
            may = bound >= kth[who]
            if not may.any():
                continue
            if self.left[node] < 0:
                found.append((who[may], np.full(may.sum(), node), bound[may]))
            else:
                front += [(self.left[node], who[may]), (self.right[node], who[may])]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        q, leaf, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-bound, q))
        return q[order], leaf[order], bound[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query place, id and score of each query's best k rows here with a score of at least kth.

        In round r every query goes to its leaf with the r-th best bound, unless that bound is under its kth score so
        far; `rounds` ends the search early, for a first estimate.
        """
        kth = kth.copy()
        top_score = np.full((len(queries), k), np.iinfo(np.int64).min)
        top_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        q, leaf, bound = self.leaves(queries, kth)
        start = np.searchsorted(q, np.arange(len(queries)))
        end = np.searchsorted(q, np.arange(len(queries)), "right")
        at, r = start.copy(), 0
        while rounds is None or r < rounds:
            open_ = np.flatnonzero(at < end)
            open_ = open_[bound[at[open_]] >= kth[open_]]
            if not len(open_):
                break
            here = leaf[at[open_]]
            for node in np.unique(here):
                who = open_[here == node]
                lo, hi = self.lo[node], self.hi[node]
                owner = np.repeat(np.arange(hi - lo), np.diff(self.first[lo : hi + 1]))
                ids = self.ids[self.first[lo] : self.first[hi]]
                score = exact(queries[who], self.points[lo:hi])[:, owner]
                score[ids[None, :] == query_ids[who][:, None]] = np.iinfo(np.int64).min
                all_id = np.concatenate([top_id[who], np.broadcast_to(np.where(True, ids, 0), score.shape)], 1)
                all_score = np.concatenate([top_score[who], score], 1)
                all_id[all_score == np.iinfo(np.int64).min] = np.iinfo(np.int64).max
                best = np.lexsort((all_id, -all_score.astype(np.float64) if np.abs(all_score[all_id < np.iinfo(np.int64).max]).max(initial=0) < 2**53 else ~all_score), axis=1)[:, :k]
                top_id[who] = np.take_along_axis(all_id, best, 1)
                top_score[who] = np.take_along_axis(all_score, best, 1)
            full = top_id[:, k - 1] < np.iinfo(np.int64).max
            kth[full] = np.maximum(kth[full], top_score[full, k - 1].astype(np.float64))
            at[open_] += 1
            r += 1
        who, rank = np.nonzero(top_id < np.iinfo(np.int64).max)
        return who, top_id[who, rank], top_score[who, rank]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component; rows with a null id or vector, or a component that is null or not finite, are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def build(rows: DataFrame, k: int, shard_rows: int = 16384) -> DataFrame:
    """One packed tree for each shard and vector length, written to the shared folder. Shards hold about shard_rows rows by hash of the id."""
    bounded_batches(rows.sparkSession)
    shards = int(rows.count() // shard_rows) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            lengths = np.diff(np.asarray(b.column(2).offsets))
            flat = np.asarray(b.column(2).flatten())
            first = np.cumsum(lengths) - lengths
            for n in np.unique(lengths):
                who = np.flatnonzero(lengths == n)
                held.setdefault(int(n), []).append((np.asarray(b.column(0))[who], np.asarray(b.column(1))[who], flat[first[who][:, None] + np.arange(n)]))
        for n, parts in held.items():
            shard, ids, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
            for s in np.unique(shard):
                tree = BallTree(ids[shard == s], vectors[shard == s].reshape(int((shard == s).sum()), n), k)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([tree.pack()], pa.binary())], ["size", "tree"])

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "v").distinct().repartition(shards, "shard")
    return stored(dealt.mapInArrow(run, "size int, tree binary"), "trees")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, shard_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query among all rows but its own.

    Ties go to the smaller id. Queries come in blocks of about `block` rows, the only thing sent to all tasks. For a
    block, every shard first looks into the best leaf of each query; the kth best of these scores over all shards is the
    bound from which every shard then searches to the end. Rows that quantised() leaves out take no part; a vector of
    another length than the query's isn't compared with it; a row that repeats id and vector counts once and every row
    with the query's id is its own. An empty table gives an empty result; other columns are not read. Scores beyond the
    range of a long are held to it.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = stored(quantised(queries, id_col, vector_col, scale).distinct(), "queries")
    trees = build(rows, k, shard_rows)
    blocks = int(asked.count() // block) + 1
    out = fresh_path(spark, "topk")
    result = "query_id long, vec_id long, score long"

    def searched(of: dict, kth: dict, rounds: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, tree in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if n not in of:
                        continue
                    ids, q = of[n]
                    who, vec, score = BallTree.unpack(tree.as_py()).search(ids, q, k, kth[n], rounds)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

        return trees.mapInArrow(run, result)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    schema = "query_id long, rank int, vec_id long, score long"
    for n in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).collect()  # about `block` rows
        of: dict = {}
        for r in some:
            of.setdefault(len(r.v), []).append(r)
        of = {m: (np.array([r.vec_id for r in rs], np.int64), np.array([r.v for r in rs], np.int64).reshape(len(rs), m)) for m, rs in of.items()}
        low = {m: np.full(len(ids), -np.inf) for m, (ids, _) in of.items()}
        place = {i: (m, p) for m, (ids, _) in of.items() for p, i in enumerate(ids.tolist())}
        for r in ranked(searched(of, low, 1)).where(F.col("rank") == k).collect():
            m, p = place[r.query_id]
            low[m][p] = r.score
        ranked(searched(of, low, None)).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
