"""Exact Jaccard join of documents on word n-grams by parity sketches.

Each n-gram of a set flips one bit of a sketch, so the Hamming distance of two sketches of equal width is at most the
size of the sets' symmetric difference. For sets of a size band that are similar enough, that difference is at most d:
of d + 1 blocks of their sketches at least one is equal. Documents meet by the hash of such a block and are verified on
their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches, maybe_among, release, stored
from ._text import LOWER, buffers, hash_spans, mix, shingles, slices, words
from .components import components

SLICE_BYTES = 2 << 20
BLOCK_BITS = 32  # so wide that blocks of few bits, too, are equal for equal contents only; a sketch is held as the list of its set bits
FLUSH = 1 << 19
SAMPLE = 64


class Bands:
    """Size bands and their blocks for a similarity of percent / 100.

    A band ends where the partner of a partner of its smallest size can end, so the larger of two similar sets lies in
    the band of the smaller or the next. A band with d differences at most has d + 1 + spare blocks: a set with at most
    `spare` blocks without a set bit skips those, for at least one of the equal blocks of a pair is then another.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.d, self.blocks, self.spare, self.reach = [1], [], [], [], []

    def partner(self, size: int) -> int:
        return size * 100 // self.percent

    def _grow(self) -> None:
        end = self.partner(self.partner(self.low[-1])) + 1
        most = end - 1
        self.reach.append(self.partner(most))
        self.d.append((100 - self.percent) * (most + self.partner(most)) // (100 + self.percent))
        self.spare.append(0 if self.d[-1] < 8 else self.d[-1] // 20 + 2)
        self.blocks.append(self.d[-1] + 1 + self.spare[-1])
        self.low.append(end)

    def of(self, size: int) -> list[int]:
        """The set's own band, and the band below where the set can be the larger partner."""
        while self.low[-1] <= size:
            self._grow()
        own = int(np.searchsorted(self.low, size, "right")) - 1
        return [own] if own == 0 or size > self.reach[own - 1] else [own, own - 1]


def block_keys(grams: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Hashes of the sketch's blocks, each with its band and place."""
    blocks = bands.blocks[band]
    block = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = np.sort((block << np.uint64(BLOCK_BITS)) | (grams & np.uint64((1 << BLOCK_BITS) - 1)))
    edge = np.flatnonzero(np.concatenate([[True], bit[1:] != bit[:-1]]))
    odd = np.diff(np.append(edge, len(bit))) & 1 == 1
    bit = bit[edge[odd]]
    count = np.bincount((bit >> np.uint64(BLOCK_BITS)).astype(np.int64), minlength=blocks)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(bit + np.uint64(1)), dtype=np.uint64)])
    end = np.cumsum(count)
    value = sums[end] - sums[end - count]
    key = mix(value ^ mix(np.arange(blocks, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40))))
    empty = count == 0
    return key[~empty] if empty.sum() <= bands.spare[band] else key


def gram_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text, ascending; with fewer words, all of them as one."""
    low = LOWER[data]
    starts, ends, at = words(low, bounds)
    h = hash_spans(low, starts, ends)
    runs = shingles(h, n) if len(h) >= n else np.zeros(0, np.uint64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield mix(shingles(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """A hash of the whole set with an even value; the last bit is free for a mark."""
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))]))[0] & np.uint64(2**64 - 2)) - 2**63


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity bits of the whole set in words of 64, a power of two of at least twice the set's size; halves fold by exclusive or."""
    words_ = 1 << max(0, (2 * len(grams) - 1).bit_length() - 6)
    out = np.zeros(words_, np.uint64)
    np.bitwise_xor.at(out, ((grams >> np.uint64(6)) & np.uint64(words_ - 1)).astype(np.int64), np.uint64(1) << (grams & np.uint64(63)))
    return out


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _entries(grams: np.ndarray, sid: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Block keys of a set in its bands, and beside each its id with the last bit set in its own band."""
    keys, owners = [], []
    for k, band in enumerate(bands.of(len(grams))):
        keys.append(block_keys(grams, band, bands))
        owners.append(np.full(len(keys[-1]), sid | (k == 0), np.int64))
    return np.concatenate(keys), np.concatenate(owners)


def _distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, sid and sketch of every row; for one set in SAMPLE also its block keys."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for b in batches:
            data, bounds = buffers(b.column(1))
            for i, j in slices(bounds, SLICE_BYTES):
                sizes, sids, sample, bits = [], [], [], []
                for grams in gram_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n):
                    sid = set_id(grams) if len(grams) else None
                    sizes.append(len(grams))
                    sids.append(sid)
                    bits.append(sketch(grams).tobytes() if sid is not None else None)
                    sample.append(np.stack(_entries(grams, sid, bands)).astype("<u8", casting="unsafe").tobytes() if sid is not None and (sid >> 8) % SAMPLE == 0 else None)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), pa.array(sample, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "sid", "sample", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid long, sample binary, bits binary")


def _hot_keys(signed: DataFrame, hot: int) -> dict[int, int]:
    """Keys that about `hot` sets or more share, each with a set of the key's own band; from the sampled sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                keys, owners = np.frombuffer(x, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "owner"])

    seen = signed.where("sample is not null").dropDuplicates(["sid"]).select("sample").mapInArrow(run, "key long, owner long")
    many = seen.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("owner").bitwiseAND(F.lit(1)) == 1, F.col("owner"))).alias("hub"))
    rows = many.where((F.col("n") >= max(1, hot // SAMPLE)) & F.col("hub").isNotNull()).orderBy(F.desc("n"), "key").limit(1 << 16).collect()
    return {r.key: r.hub for r in rows}


def _meet(texts: DataFrame, n: int, percent: int, parts: int, hot: dict[int, int]) -> DataFrame:
    """Sets that share a block: rows (a, b) with a hub a, where key counts blocks, and rows (key, b, own) of groups of three sets or more, where a is null.

    Tasks send their entries as packed runs by range of the key. Entries of a hot key aren't sent: its hub is known to
    all tasks, so each pairs its sets with the hub at once.
    """
    hot_keys = np.array(sorted(hot), np.int64).view(np.uint64)
    hot_hub = np.array([hot[k] for k in sorted(hot)], np.int64)
    order = np.argsort(hot_keys)
    hot_keys, hot_hub = hot_keys[order], hot_hub[order]
    width = np.uint64(2**64 // parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held, count, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owners = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(hot_keys):
                k = np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)
                is_hot = hot_keys[k] == keys
                if is_hot.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(1, np.int32)), pa.array([keys[is_hot].tobytes()]), pa.array([owners[is_hot].tobytes()]), pa.array([hot_hub[k[is_hot]].tobytes()], pa.binary())], ["part", "keys", "owners", "hubs"])
                    keys, owners = keys[~is_hot], owners[~is_hot]
            part = keys // width
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            if len(edge):
                end = np.append(edge[1:], len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[edge].astype(np.int32)), pa.array([keys[x:y].tobytes() for x, y in zip(edge, end, strict=True)], pa.binary()), pa.array([owners[x:y].tobytes() for x, y in zip(edge, end, strict=True)], pa.binary()), pa.nulls(len(edge), pa.binary())],
                    ["part", "keys", "owners", "hubs"],
                )

        for b in batches:
            data, bounds = buffers(b.column(0))
            for i, j in slices(bounds, SLICE_BYTES):
                for grams in gram_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n):
                    if len(grams) and (sid := set_id(grams)) not in seen:
                        seen.add(sid)
                        held.append(_entries(grams, sid, bands))
                        count += len(held[-1][0])
                if count > FLUSH:
                    yield from flush()
                    held, count, seen = [], 0, set()
        if held:
            yield from flush()

    def paired(keys: np.ndarray, owners: np.ndarray, hubs: np.ndarray) -> pa.RecordBatch:
        """(hub, set) rows and how many blocks speak for each."""
        pair = np.stack([hubs & ~1, owners & ~1], 1)[(hubs | 1) != (owners | 1)]
        pair, times = np.unique(pair, axis=0, return_counts=True) if len(pair) else (pair.reshape(0, 2), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(times), pa.nulls(len(pair), pa.bool_())], ["a", "b", "key", "own"])

    def members(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(owners & ~1), pa.array(keys.view(np.int64)), pa.array(owners & 1 == 1)], ["a", "b", "key", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners = [], []
        for b in batches:
            for k, o, h in zip(b.column(1), b.column(2), b.column(3), strict=True):
                key, owner = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(o.as_buffer(), np.int64)
                if h.is_valid:
                    yield paired(key, owner, np.frombuffer(h.as_buffer(), np.int64))
                    yield members(key, owner)
                else:
                    keys.append(key)
                    owners.append(owner)
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        del keys, owners
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        again = np.zeros(len(key) + 1, bool)
        again[1:-1] = sorted_[1:] == sorted_[:-1]
        often = again[1:] | again[:-1]
        key, owner = _distinct(sorted_[often], owner[order[often]])
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        own = np.where(owner & 1 == 1, owner, np.iinfo(np.int64).max)
        hub = np.minimum.reduceat(own, edge)
        good = (hub < np.iinfo(np.int64).max) & (size > 1)
        use = np.repeat(good, size)
        yield paired(key[use], owner[use], np.repeat(hub, size)[use])
        use = np.repeat(good & (size > 2), size)
        yield members(key[use], owner[use])

    dealt = texts.select("text").mapInArrow(deal, "part int, keys binary, owners binary, hubs binary")
    spread = F.when(F.col("hubs").isNull(), F.col("part").cast("long")).otherwise(F.xxhash64("owners"))
    return dealt.repartition(max(1, parts // 4), spread).mapInArrow(meet, "a long, b long, key long, own boolean")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int, per_task: int = 64) -> DataFrame:
    """The pairs (a, b) of a written table that link, from the texts of one document for each set.

    The texts of the sets that b names go to the text of a; where there are many, a copy of a goes to every per_task of
    them or so. A task holds the set of one a at a time.
    """
    fit = pairs.select("a", "b")
    salts = fit.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    members = fit.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("sid"), F.lit(0).alias("hub"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("sid"), F.lit(1).alias("hub"))
    asked = stored(members.unionByName(hubs).join(reps.select("sid", "doc_id"), "sid"), "asked")
    test = maybe_among(asked, "doc_id")
    sent = docs.where(test(F.col("doc_id"))).join(asked, "doc_id").select("a", "salt", "hub", "sid", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            data, bounds = buffers(b.column(4))
            a, is_hub, sid = (np.asarray(b.column(k)) for k in (0, 2, 3))
            links = []
            for i, j in slices(bounds, 1 << 20):
                for k, grams in enumerate(gram_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], n), i):
                    if not len(grams) or set_id(grams) != sid[k]:
                        continue
                    if is_hub[k]:
                        now, own = a[k], grams
                    elif now == a[k]:
                        both = int(np.isin(grams, own, assume_unique=True).sum())
                        if both * (100 + percent) >= (len(grams) + len(own)) * percent:
                            links.append((int(a[k]), int(sid[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return stored(sent.mapInArrow(run, "a long, b long"), "links")


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link, with the distance of their sketches."""
    known = reps.select("sid", "n_shingles", "bits")
    both = pairs.select("a", "b").join(known.withColumnsRenamed({"sid": "a", "n_shingles": "n", "bits": "x"}), "a").join(known.withColumnsRenamed({"sid": "b", "n_shingles": "m", "bits": "y"}), "b")
    fit = both.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (100 - percent) * (np.asarray(b.column(2)) + np.asarray(b.column(3))) // (100 + percent)
            away = np.zeros(len(b), np.int64)
            for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                away[k] = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            keep = pa.array(away <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(away).filter(keep)], ["a", "b", "away"])

    return fit.mapInArrow(run, "a long, b long, away long")


def _within(members: DataFrame, reps: DataFrame, percent: int, nearest: bool, chunk: int = 2048) -> DataFrame:
    """Pairs (a, b, away) of members (key, sid, own, root) that share a key, differ in root, and whose sizes and sketches allow a link.

    nearest: of each key's pairs only the nearest of each root.

    A key's members meet in chunks: those of each two chunks of a key in one place, so that none holds more than two.
    """
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "chunks")
    own = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    spread = members.join(counts, "key").withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = spread.join(reps.select("sid", "n_shingles", "bits"), "sid").select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "sid", "own", "root", "n_shingles", "bits")

    def pairs(rows: list[tuple]) -> np.ndarray:
        sid, own, root, n = (np.array([r[k] for r in rows]) for k in range(4))
        words_ = [np.frombuffer(r[4], np.uint64) for r in rows]
        size = min(map(len, words_))
        bits = np.stack([_folded(x, size) for x in words_])
        out = []
        step = max(1, (1 << 22) // (len(rows) * size))
        for i in range(0, len(rows), step):
            j = slice(i, i + step)
            most = (100 - percent) * (n[j, None] + n[None, :]) // (100 + percent)
            fit = (sid[j, None] < sid[None, :]) & (root[j, None] != root[None, :]) & (own[j, None] | own[None, :]) & (np.minimum(n[j, None], n[None, :]) * 100 >= np.maximum(n[j, None], n[None, :]) * percent)
            x, y = np.nonzero(fit)
            for first in range(0, len(x), 1 << 16):
                p, q = x[first : first + (1 << 16)] + i, y[first : first + (1 << 16)]
                away = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
                good = away <= most[p - i, q]
                p, q, away = p[good], q[good], away[good]
                if nearest:
                    of = np.concatenate([root[p], root[q]])
                    order = np.lexsort((np.concatenate([away, away]), of))
                    first = order[np.concatenate([[True], np.diff(of[order]) != 0])[: len(order)]]
                    keep = np.unique(first % max(len(p), 1))
                    p, q, away = p[keep], q[keep], away[keep]
                out.append(np.stack([sid[p], sid[q], away], 1))
        return np.concatenate(out) if out else np.zeros((0, 3), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found, held = None, [], [], 0

        def out() -> pa.RecordBatch:
            every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every[:, k])) for k in range(3)], ["a", "b", "away"])

        for b in batches:
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, lo, hi) != now:
                    if len(rows) > 1:
                        found.append(pairs(rows))
                        held += len(found[-1])
                    now, rows = (key, lo, hi), []
                rows.append(row)
                if held > 1 << 20:
                    yield out()
                    found, held = [], 0
        if len(rows) > 1:
            found.append(pairs(rows))
        yield out()

    return placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long, away long").distinct()


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, hot: int = 1 << 17, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links reach) of every row.

    Two texts link when the Jaccard similarity of their sets of word n-grams is at least percent / 100. Words are
    lower-cased in A-Z and parted by ASCII white space; a text with fewer words has their whole sequence as its one
    element; an empty or null text has none and links with nothing. Equal sets meet as one, so copies cost nothing.
    Each block pairs its sets with a hub. Of all pairs that share a block, those whose sizes and whole sketches allow a
    link are verified: first each set with its nearest hub, then the nearest pairs of components that are still apart,
    then all pairs that are, so no link between different components stays untested. Rows with a null id get a null component
    and link with nothing; rows that repeat an id are in that id's component if any of their texts is. An empty table
    gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(texts, n, percent), "signed")
    useful = signed.where("sid is not null and doc_id is not null")
    total = useful.agg(F.sum("n_shingles")).first()[0] or 0
    parts = 4 * (int(total * 16 * 3 // (10 * part_bytes)) + 64)
    met = stored(_meet(texts.where("doc_id is not null"), n, percent, parts, _hot_keys(useful, hot)), "met")
    release(docs.sparkSession)
    reps = stored(useful.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "reps")
    pairs = stored(_near(met.where("a is not null").select("a", "b").distinct(), reps, percent), "pairs")
    spark = docs.sparkSession

    ordered = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "away").distinct(), "ordered")
    each = ordered.unionByName(ordered.select(F.col("b").alias("a"), F.col("a").alias("b"), "away"))
    tested = stored(each.groupBy("b").agg(F.min_by("a", F.struct("away", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested")
    links = _verified(texts, reps, tested, n, percent)
    roots = components(links)
    release(spark)
    groups = met.where("a is null").select("key", F.col("b").alias("sid"), "own")
    for nearest in (True, False):
        members = stored(groups.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "own", F.coalesce("root", "sid").alias("root")), "groups")
        found = _within(members, reps, percent, nearest).select("a", "b")
        if nearest:
            of_a, of_b = (roots.withColumnsRenamed({"node": c, "root": f"root_{c}"}) for c in "ab")
            hubs = ordered.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            found = found.unionByName(hubs.select("a", "b")).distinct()
        more = stored(found.join(tested, ["a", "b"], "left_anti"), "more")
        release(spark)
        if more.limit(1).count():
            links = links.unionByName(_verified(texts, reps, more, n, percent))
            roots = components(links)
            tested = tested.unionByName(more)
            release(spark)

    labelled = stored(reps.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = labelled.join(least, "root").select("sid", "component_id")
    own = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("sid")).alias("sid")).join(of_set, "sid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that are the smallest of their component, and those with a null id.

    Of rows that repeat an id all stay or go together.
    """
    id_col = options.get("id_col", "doc_id")
    gone = near_duplicates(docs, **options).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
