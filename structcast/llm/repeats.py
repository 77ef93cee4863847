"""Exact removal of long strings that occur more than once, by run-length indexes over what may repeat.

Two equal strings of `length` bytes have equal minimal hashes of their grams, so they share an anchor: a gram that is
the least of all grams in some such string around it. Anchors meet by hash. Where the whole neighbourhood that any string
through an anchor can reach is equal to another's, all of it repeats. The other neighbourhoods of a shared anchor, with
one of each kind of the equal ones, go into a run-length index, whose matching statistics mark what repeats. Anchors
shared by very many different neighbourhoods are settled by the hashes of all their strings instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches, maybe_among, release, stored
from ._text import buffers, mix, slices
from .run_index import RunIndex

GRAM = 64
SLICE_BYTES = 1 << 20
FLUSH = 1 << 20
_FACTOR = 0x2545F4914F6CDD1D
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, f in enumerate((_FACTOR, pow(_FACTOR, -1, 2**64))):
            x = np.full(max(n, 2 * len(_powers[0])), np.uint64(f))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


class Hashed:
    """Hashes of any span of a text, from sums over its beginnings."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, w: int, kind) -> np.ndarray:
    """kind (minimum or maximum) over each w neighbours, by its values up to block ends from either side."""
    n = len(x)
    edge = np.uint64(2**64 - 1) if kind is np.minimum else np.uint64(0)
    padded = np.concatenate([x, np.full(-n % w, edge, np.uint64)]).reshape(-1, w)
    before = kind.accumulate(padded, axis=1).ravel()
    after = kind.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return kind(after[: n - w + 1], before[w - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, gram hash and neighbourhood hash of each anchor of a text of at least `length` bytes.

    A place is an anchor if its gram hash is the least in some string of `length` bytes; all ties are anchors.
    """
    h = Hashed(data)
    g = h.grams(GRAM)
    w = length - GRAM + 1
    low = _least(g, w, np.minimum)
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_least(wide, w, np.maximum) == g)
    a, b = np.maximum(at - w + 1, 0), np.minimum(at + length, len(data))
    return at, g[at], mix(h.spans(a, b) ^ mix((at - a).astype(np.uint64)))


ENTRY = "part long, rows binary"


def _packed(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of numbers, a hash first, in runs by range of the hash."""
    rows = rows[np.argsort(rows[:, 0])]
    part = (((rows[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    end = np.append(edge[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[edge]), pa.array([rows[x:y].tobytes() for x, y in zip(edge, end, strict=True)], pa.binary())], ["part", "rows"])


def _flushed(each: Iterator[tuple[int, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """each: text and its rows. A text is taken once between flushes."""
    held, size, seen = [], 0, set()
    for text, rows in each:
        if text not in seen:
            seen.add(text)
            held.append(rows)
            size += len(rows)
            if size > FLUSH:
                yield _packed(np.concatenate(held), parts)
                held, size, seen = [], 0, set()
    if size:
        yield _packed(np.concatenate(held), parts)


def _meeting(batches: Iterator[pa.RecordBatch], width: int) -> np.ndarray:
    """All rows of a part whose hash occurs again, without repetition, in order of all their numbers."""
    rows = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, width) for b in batches for x in b.column(1)]
    if not rows:
        return np.zeros((0, width), np.uint64)
    hashes = np.concatenate([r[:, 0] for r in rows])
    order = np.argsort(hashes)
    again = np.zeros(len(order) + 1, bool)
    again[1:-1] = hashes[order][1:] == hashes[order][:-1]
    rows = np.concatenate(rows)[order[again[1:] | again[:-1]]]
    rows = rows[np.lexsort(tuple(rows[:, k] for k in range(width - 1, -1, -1)))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])] if len(rows) else rows


FOUND = "text long, place int, kind int, shard long"
WHOLE, OPEN, WIDE = 0, 1, 2


def _settle(batches: Iterator[pa.RecordBatch], shards: int, wide: int) -> Iterator[pa.RecordBatch]:
    """For each anchor that is shared: its neighbourhood repeats as a whole, or goes to an index, or is settled string by string."""
    rows = _meeting(batches, 4)
    if not len(rows):
        return
    new_hash = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
    new_kind = new_hash | np.concatenate([[True], rows[1:, 1] != rows[:-1, 1]])
    kind = np.cumsum(new_kind) - 1
    group = np.cumsum(new_hash) - 1
    same = np.bincount(kind)[kind] > 1
    kinds = np.bincount(group[new_kind])[group]
    opened = np.bincount(group, ~same)[group] > 0
    go = (kinds > 1) & opened & new_kind
    shard = (((rows[:, 0] & np.uint64(2**32 - 1)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    text, place = rows[:, 2].astype(np.int64), rows[:, 3].astype(np.int32)
    for use, what in ((same, np.full(len(rows), WHOLE)), (go, np.where(kinds > wide, WIDE, OPEN))):
        yield pa.RecordBatch.from_arrays([pa.array(text[use]), pa.array(place[use]), pa.array(what[use].astype(np.int32)), pa.array(shard[use])], ["text", "place", "kind", "shard"])



def _with_places(texts: DataFrame, reps: DataFrame, places: DataFrame) -> DataFrame:
    """body, text, places and shards: the text of one document for each text hash that places names."""
    asked = stored(places.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("shard", "place"))).alias("at")).join(reps, "text"), "asked")
    test = maybe_among(asked, "text")
    own = texts.where(test(F.col("text"))).join(asked.withColumnRenamed("doc_id", "rep"), "text").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    return own.select("body", "text", F.col("at.place").alias("places"), F.col("at.shard").alias("shards"))


def repeated_ranges(texts: DataFrame, reps: DataFrame, length: int, part_rows: int, wide: int, shard_bytes: int) -> DataFrame:
    """text, a and b: bytes of a text that are covered by strings that also occur elsewhere. texts: doc_id, text (hash), body."""
    spark = texts.sparkSession
    reach = length - GRAM
    long = texts.where(F.octet_length("body") >= length)
    size = long.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    parts = 4 * (int(size * 2 // (reach * part_rows)) + 64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                data, bounds = buffers(b.column(1))
                for k, text in enumerate(b.column(0).to_pylist()):
                    at, gram, around = anchors(data[bounds[k] : bounds[k + 1]], length)
                    yield text, np.stack([gram, around, np.full(len(at), np.uint64(text % 2**64)), at.astype(np.uint64)], 1)

        return _flushed(each(), parts)

    dealt = long.select("text", "body").mapInArrow(deal, ENTRY)
    shards = max(1, int(size // shard_bytes))
    found = stored(dealt.repartition(parts // 4, "part").mapInArrow(lambda b: _settle(b, shards, wide), FOUND), "found")
    release(spark)
    whole = found.where(F.col("kind") == WHOLE).select("text", (F.greatest(F.col("place") - reach, F.lit(0))).alias("a"), (F.col("place") + length).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbourhoods of a text that go to one shard; those that overlap are one."""
        for b in batches:
            data, bounds = buffers(b.column(0))
            out = []
            for k, (text, places, shard) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
                body = data[bounds[k] : bounds[k + 1]]
                at, of = np.asarray(places.values, np.int64), np.asarray(shard.values)
                lo, hi = np.maximum(at - reach, 0), np.minimum(at + length, len(body))
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] > hi[:-1])])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                out += [(int(of[x]), text, int(lo[x]), body[lo[x] : hi[y]].tobytes()) for x, y in zip(first, last, strict=True)]
                if len(out) > 2000:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    def rows_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "text", "start", "piece"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def ranges() -> Iterator[pa.RecordBatch]:
            where = list(held)
            piece, a, b = RunIndex([held[x] for x in where]).repeated(length)
            text = np.array([x[0] for x in where], np.int64)
            start = np.array([x[1] for x in where], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(text[piece]), pa.array((start[piece] + a).astype(np.int32)), pa.array((start[piece] + b).astype(np.int32))], ["text", "a", "b"])

        for b in batches:
            for shard, text, start, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now and held:
                    yield from ranges()
                    held = {}
                now = shard
                held[text, start] = piece
        if held:
            yield from ranges()

    pieces = _with_places(texts, reps, found.where(F.col("kind") == OPEN)).mapInArrow(cut, "shard long, text long, start int, piece binary")
    indexed = stored(pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(index, "text long, a int, b int"), "indexed")
    release(spark)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of all strings through the places."""

        def each() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                data, bounds = buffers(b.column(0))
                for k, (text, places) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                    body = data[bounds[k] : bounds[k + 1]]
                    h = Hashed(body)
                    at = np.unique((np.asarray(places.values, np.int64)[:, None] - np.arange(reach + 1)).ravel())
                    at = at[(at >= 0) & (at + length <= len(body))]
                    own = h.spans(at, at + length)
                    yield text, np.stack([own, np.full(len(at), np.uint64(text % 2**64)), at.astype(np.uint64)], 1)

        return _flushed(each(), parts)

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _meeting(batches, 3)
        if len(rows):
            more = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0]]) | np.concatenate([rows[1:, 0] == rows[:-1, 0], [False]])
            rows = rows[more].copy()
            rows[:, 0] = mix(rows[:, 1])
            if len(rows):
                yield _packed(rows, parts)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of strings that follow or overlap each other in a text."""
        rows = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 3) for b in batches for x in b.column(1)]
        if not rows:
            return
        text, place = np.concatenate([r[:, 1] for r in rows]), np.concatenate([r[:, 2] for r in rows]).astype(np.int64)
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] > place[:-1] + length)]))
        last = np.append(first[1:], len(text)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(text[first].astype(np.int64)), pa.array(place[first].astype(np.int32)), pa.array((place[last] + length).astype(np.int32))], ["text", "a", "b"])

    wide_places = found.where(F.col("kind") == WIDE)
    by_string = _with_places(texts, reps, wide_places).mapInArrow(strings, ENTRY).repartition(parts // 4, "part").mapInArrow(equal, ENTRY).repartition(parts // 4, "part").mapInArrow(runs, "text long, a int, b int")
    out = whole.unionByName(indexed)
    return out.unionByName(by_string) if wide_places.limit(1).count() else out


def without_repeats(docs: DataFrame, length: int = 400, part_rows: int = 400_000, wide: int = 4096, shard_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, starts and ends of the removed runs, and kept (the bytes that are left) of every row.

    A byte goes if a string of `length` bytes covers it that also begins anywhere else, in the same text or another;
    strings are judged on the input and never reach from one text into another. Texts are UTF-8 bytes, a null is empty.
    Equal texts are looked at once; such texts of at least `length` bytes go as a whole. Any rows, nulls and repeated
    ids included, keep their id; an empty table gives an empty result; other columns are not read. Neighbourhoods of an
    anchor that is shared in more than `wide` ways are compared by 64-bit hashes of their strings.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).withColumn("text", F.xxhash64("body"))
    counted = stored(texts.select("doc_id", "text", F.octet_length("body").alias("n")).where(F.col("n") >= length).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n")), "texts")
    ranges = repeated_ranges(texts, counted.select("text", "doc_id"), length, part_rows, wide, shard_bytes)
    all_ = ranges.unionByName(counted.where("copies > 1").select("text", F.lit(0).alias("a"), F.col("n").alias("b")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, a, e = [], [], []
            for k, rows in enumerate(b.column(1)):
                lo, hi = (np.asarray(x, np.int64) for x in rows.values.flatten())
                hi = np.maximum.accumulate(hi)
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                at.append(first)
                a.append(lo[first].astype(np.int32))
                e.append(hi[np.append(first[1:], len(lo)) - 1].astype(np.int32))
            bounds = pa.array(np.cumsum([0] + [len(x) for x in at]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(a))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(e)))], ["text", "starts", "ends"])

    runs = stored(all_.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("rows")).mapInArrow(joined, "text long, starts array<int>, ends array<int>"), "runs")
    release(docs.sparkSession)
    test = maybe_among(runs, "text")
    none = F.array().cast("array<int>")
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = buffers(b.column(1))
            for i, j in slices(bounds, 4 * SLICE_BYTES):
                n, starts, ends, kept = [], [], [], []
                for k in range(i, j):
                    body = data[bounds[k] : bounds[k + 1]]
                    n.append(len(body))
                    if not b.column(2)[k].is_valid:
                        starts.append([])
                        ends.append([])
                        kept.append(body.tobytes())
                        continue
                    a, e = np.asarray(b.column(2)[k].values), np.minimum(np.asarray(b.column(3)[k].values), len(body))
                    keep = np.zeros(len(body) + 1, np.int32)
                    keep[a] += 1
                    keep[e] -= 1
                    starts.append(a.tolist())
                    ends.append(e.tolist())
                    kept.append(body[np.cumsum(keep[:-1]) == 0].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    maybe = test(F.col("text"))
    changed = texts.where(maybe).join(runs, "text", "left").select("doc_id", "body", "starts", "ends").mapInArrow(remove, f"doc_id {kind}, n_bytes long, starts array<int>, ends array<int>, kept binary")
    same = texts.where(~maybe).select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), none.alias("starts"), none.alias("ends"), F.col("body").alias("kept"))
    return changed.unionByName(same)
