"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Every pair of neighbouring words has a restaurant for the words that follow it; each of its tables is a customer of the
restaurant of the nearer word, whose tables are customers of one root restaurant. The root's base is uniform over the
training words and one unknown word. The predictive probabilities of the last sweeps are averaged.

Tokens are dealt by the word before them, so that a context and all longer ones that share it meet in one task; what
follows frequent words (at most 1024) is dealt by both words. What a part needs of other parts, customers and tables of
words in the root and of the contexts that end in a frequent word, is summed by key and sent back to the parts that ask.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches, discard, release, stored, written
from ._text import LOWER, buffers, distinct, hash_spans, mix, slices, words

SLICE_BYTES = 4 << 20
BUCKETS, SLOTS = 1 << 16, 64
FREQUENT = 1024
TRAIN_BIT = 1 << 15
FLUSH_TOKENS, FLUSH_DOCS = 1 << 20, TRAIN_BIT
COUNTED, SEATED, SCORED = 2, 4, 2  # groups of parts in counting, seating (of each counted group the same number) and scoring; one after the other, so that only a share of the entries is on disk at once
CHUNK = 1 << 23  # tokens whose places fit the sorting key
END = np.uint64(0x5EED0E4D)  # the hash of the end token; START is a context only
START = np.uint64(1)


@dataclass
class Setting:
    discount: float = 0.7
    strength: float = 2.0
    root_discount: float = 0.65
    root_strength: float = 50.0
    sweeps: int = 6
    samples: int = 3
    seed: int = 11


def token_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end token after each, and each text's bounds among them."""
    low = LOWER[data]
    starts, ends, at = words(low, bounds)
    h = hash_spans(low, starts, ends)
    h[h == END] = END + np.uint64(1)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def draw_tables(customers: np.ndarray, pull: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each dish when its customers sit down one after the other.

    The next customer opens a table with weight pull (strength of opening times the parent's probability), and joins one
    of t tables of s seated customers with weight s - discount * t. From the 64th customer on, customers sit in blocks
    that grow with those seated, for each of which the weights stay as at its start.
    """
    tables = np.minimum(customers, 1)
    left = np.flatnonzero(customers > 1)
    seated = 1
    while len(left):
        step = 1 if seated < 64 else seated // 16
        n = np.minimum(customers[left] - seated, step)
        join = np.maximum(seated - discount * tables[left], 1e-12)
        opens = pull[left] / (pull[left] + join)
        tables[left] += random.random(len(left)) < opens if step == 1 else random.binomial(n, opens)
        seated += step
        left = left[customers[left] > seated]
    return tables


@dataclass
class Seating:
    """Types (word, context, customers) in order, and their tables in each sample, of contexts of one word that lie in one place."""

    word: np.ndarray  # place of the word among the words
    context: np.ndarray  # 0: the parent itself
    customers: np.ndarray
    n_words: int
    tables: list[np.ndarray] = field(default_factory=list)  # by type
    root: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # customers and tables of each word in the parent

    def sample(self, s: Setting, known: np.ndarray, share: float, vocabulary: float, random: np.random.Generator) -> None:
        """Gibbs sweeps. known: customers of each context in the whole corpus; share: the part of all tokens that is seated here, by which totals over the corpus are reckoned from those here."""
        below = self.context > 0
        w, u, c = self.word[below], self.context[below], self.customers[below]
        direct = np.bincount(self.word[~below], self.customers[~below], self.n_words)
        here = np.bincount(u, c, len(known))
        up = np.where(here > 0, known / np.maximum(here, 1), 0)
        t = np.minimum(c, 1)
        base = 1 / (vocabulary + 1)
        for sweep in range(s.sweeps):
            k = (np.bincount(w, t, self.n_words) + direct).astype(np.int64)
            r = draw_tables(k, np.full(self.n_words, (s.root_strength + s.root_discount * len(k) / share) * base), s.root_discount, random)
            total, opened = k.sum() / share, r.sum() / share
            p = (k - s.root_discount * r + (s.root_strength + s.root_discount * opened) * base) / (s.root_strength + total)
            if sweep >= s.sweeps - s.samples:
                every = np.zeros(len(self.word), np.int64)
                every[below] = t
                self.tables.append(every)
                self.root.append((k, r))
            opened_u = np.maximum(np.bincount(u, t, len(known)) * up, 1)
            t = draw_tables(c, (s.strength + s.discount * opened_u[u]) * p[w], s.discount, random)

    def totals(self, n_contexts: int) -> np.ndarray:
        """For each sample and context the tables; last two columns: customers and tables of the parent."""
        return np.stack([np.append(np.bincount(self.context, t, n_contexts), [k.sum(), r.sum()]) for t, (k, r) in zip(self.tables, self.root, strict=True)])

    def log10(self, s: Setting, customers: np.ndarray, totals: np.ndarray, vocabulary: int, word: np.ndarray, context: np.ndarray, type_: np.ndarray) -> np.ndarray:
        """Averaged predictive log10 probability of words in contexts. word: -1 unknown; type_: the place of the type, -1 if never seen."""
        out = np.zeros(len(word))
        seen, known = type_ >= 0, word >= 0
        c = np.where(seen, self.customers[np.maximum(type_, 0)] if len(self.customers) else 0, 0)
        for t, (k, r), total in zip(self.tables, self.root, totals, strict=True):
            held = np.where(known, (k - s.root_discount * r)[np.maximum(word, 0)] if len(k) else 0, 0)
            p = (held + (s.root_strength + s.root_discount * total[-1]) / (vocabulary + 1)) / (s.root_strength + total[-2])
            own = np.where(seen, c - s.discount * (t[np.maximum(type_, 0)] if len(t) else 0), 0)
            below = (own + (s.strength + s.discount * total[context]) * p) / (s.strength + customers[context])
            out += np.where(context > 0, below, p)
        return np.log10(out / len(self.tables))


def _training(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for b in batches:
        for slot, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total[slot] = total.get(slot, 0) + np.frombuffer(x.as_buffer(), np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slot", "counts"])


def _survey(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the frequent words, their counts or a little less, and the number of training tokens.

    A word is frequent if it is the most frequent of a hash bucket that holds a 1024th of all tokens; for this a bucket
    names only words that hold as much of some task's tokens, which any word with that share of all tokens does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        words_, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = 0
        for b in batches:
            data, bounds = buffers(b.column(0))
            for i, j in slices(bounds, SLICE_BYTES):
                h, _ = token_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                total += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
                n += len(h)
                often = total * (2 * FREQUENT) >= n  # buckets that are frequent so far
                own, times = np.unique(h[often[(h >> np.uint64(48)).astype(np.int64)]], return_counts=True)
                both, at = distinct(np.concatenate([words_, own]))
                counts = np.bincount(at, np.concatenate([counts, times])).astype(np.int64)
                keep = often[(both >> np.uint64(48)).astype(np.int64)]
                words_, counts = both[keep], counts[keep]
        best = np.argsort(-counts, kind="stable")[: 2 * FREQUENT]
        size = BUCKETS // SLOTS
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([total[k * size : (k + 1) * size].tobytes() for k in range(SLOTS)], pa.binary()), pa.nulls(SLOTS, pa.int64()), pa.nulls(SLOTS, pa.int64())], ["slot", "counts", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(best), pa.int32()), pa.nulls(len(best), pa.binary()), pa.array(words_[best].view(np.int64)), pa.array(counts[best])], ["slot", "counts", "word", "n"])

    seen = stored(texts.where("train").select("text").mapInArrow(run, "slot int, counts binary, word long, n long"), "survey")
    rows = seen.where("slot is not null").select("slot", "counts").repartition("slot").mapInArrow(_sum_slots, "slot int, counts binary").collect()  # 64 rows
    buckets = np.zeros((SLOTS, BUCKETS // SLOTS), np.int64)
    for slot, counts in rows:
        buckets[slot] = np.frombuffer(bytes(counts), np.int64)
    buckets = buckets.ravel()
    n = int(buckets.sum())
    named = seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(1 << 16).collect()
    best: dict[int, tuple[int, int]] = {}
    for word, count in named:
        bucket = (word % 2**64) >> 48
        if buckets[bucket] * FREQUENT >= max(n, 1):
            best.setdefault(bucket, (word % 2**64, count))
    found = sorted(best.values())
    return np.array([w for w, _ in found], np.uint64), np.array([c for _, c in found], np.float64), n


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value among ascending keys, or -1."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return np.where(keys[at] == values, at, -1) if len(keys) else np.full(len(values), -1)


def _spread(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


PACKED = ["part", "block", "words", "near", "far", "word", "mark", "count"]
PACKED_SCHEMA = "part long, block long, words binary, near binary, far binary, word binary, mark binary, count binary"


def _row(part: int, block: int, *fields: np.ndarray | None) -> pa.RecordBatch:
    cells = [pa.array([None if x is None else _squeezed(x)], pa.binary()) for x in (*fields, *[None] * (6 - len(fields)))]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), *cells], PACKED)


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, the first bytes of all, then the second ones, compressed."""
    most = int(x.max(initial=0))
    x = x.ravel().astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")
    planes = b"".join((x >> np.array(8 * k, x.dtype)).astype("u1").tobytes() for k in range(x.itemsize))
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _read(cell: bytes | pa.Scalar) -> np.ndarray:
    raw = cell if isinstance(cell, bytes) else cell.as_buffer().to_pybytes()
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], decompressed_size=size * n, codec="zstd"), "u1")
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel()


def _pack(block: int, word: np.ndarray, starts: np.ndarray, mark: np.ndarray, frequent: np.ndarray, parts: int, group: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows for each part: its words, and of each distinct (nearer word, word, farther word, mark) the places and the count. starts: first tokens of texts; group: only parts that leave its first number modulo its second."""

    def part_of(near: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _spread(mix(np.where(_among(frequent, near) >= 0, mix(near) + word, near)), parts)

    near = np.roll(word, 1)
    near[starts] = START
    far = np.roll(near, 1)
    far[starts] = START
    for lo in range(0, len(word), CHUNK):
        hi = min(len(word), lo + CHUNK)
        some = lo + np.flatnonzero(part_of(near[lo:hi], word[lo:hi]) % group[1] == group[0])
        if not len(some):
            continue
        known, place = distinct(np.concatenate([near[some], far[some], word[some]]))
        n, f, w = place.reshape(3, -1)
        m = mark[some]
        bits = len(known).bit_length()
        pairs, pair = distinct((n << bits) | w)
        of_near, of_word = pairs >> bits, pairs & ((1 << bits) - 1)
        part = part_of(known[of_near], known[of_word])
        order = np.argsort(part, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        key, count = np.unique((rank[pair].astype(np.uint64) << np.uint64(40)) | (f.astype(np.uint64) << np.uint64(16)) | m.astype(np.uint64), return_counts=True)
        pair = order[(key >> np.uint64(40)).astype(np.int64)]
        places = [of_near[pair], ((key >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.int64), of_word[pair]]
        mark_ = (key & np.uint64(0xFFFF)).astype("<u2")
        own = part[pair]
        edge = np.append(_runs(own), len(own))
        used, local = np.zeros(len(known), bool), np.zeros(len(known), np.int64)
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            for p in places:
                used[p[x:y]] = True
            here = np.flatnonzero(used)
            used[here], local[here] = False, np.arange(len(here))
            near, far, w = (local[p[x:y]] for p in places)
            often = np.argsort(-np.bincount(np.concatenate([far, w]), minlength=len(here)), kind="stable")  # common words have small places
            to = np.empty_like(often)
            to[often] = np.arange(len(here))
            yield _row(int(own[x]), block, known[here[often]], to[near], to[far], to[w], mark_[x:y], count[x:y])


class Part:
    """All types of a part, in order of nearer word, word and farther word, and where their entries are."""

    def __init__(self, rows: list[pa.RecordBatch], frequent: np.ndarray):
        known = [_read(b.column(2)[0]).astype(np.uint64) for b in rows]
        self.words, place = distinct(np.concatenate(known))
        columns: list[list] = [[], [], [], [], []]
        self.blocks = []  # of each row the block and the number of entries
        for b, own in zip(rows, np.split(place, np.cumsum(list(map(len, known)))[:-1]), strict=True):
            mark = _read(b.column(6)[0])
            for c, x in zip(columns, [*(own[_read(b.column(c)[0])] for c in (3, 4, 5)), mark, _read(b.column(7)[0])], strict=True):
                c.append(x)
            self.blocks.append((b.column(1)[0].as_py(), len(mark)))
        near, far, word, self.mark, self.count = map(np.concatenate, columns)
        self.count = self.count.astype(np.int64)
        del columns, place, known
        bits = len(self.words).bit_length()
        low = (1 << bits) - 1
        pairs, pair = distinct((near << bits) | word)
        types, self.at = distinct((pair << bits) | far)
        train = self.mark >= TRAIN_BIT
        self.n = np.bincount(self.at[train], self.count[train], len(types)).astype(np.int64)  # training customers
        self.pair, self.far = types >> bits, types & low
        self.word, self.near_of_pair = pairs & low, pairs >> bits
        self.near, self.of_near = distinct(self.near_of_pair)  # contexts of one word, and of each pair its own
        contexts, self.of_context = distinct((self.of_near[self.pair] << bits) | self.far)
        self.context_near = contexts >> bits
        self.hot = _among(frequent, self.words[self.near]) >= 0
        self.hot_context = self.hot[self.context_near]
        self.own_words, self.of_word = distinct(self.word)
        keys = [self.words[self.own_words], mix(self.words[self.near[self.hot]] + np.uint64(7)), mix(mix(self.words[self.near[self.context_near[self.hot_context]]]) + self.words[contexts[self.hot_context] & low])]
        self.kinds = np.repeat(np.arange(3), list(map(len, keys)))
        self.keys = np.concatenate(keys)

    def ask(self, part: int, parts: int, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows for the slots that sum the numbers (columns of one for each key); each key of this part is in one."""
        slot = _spread(mix(self.keys), parts)
        order = np.argsort(slot, kind="stable")
        edge = np.append(_runs(slot[order]), len(order))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            at = order[x:y]
            yield _row(int(slot[at[0]]), part, self.keys[at], self.kinds[at], np.stack([c[at] for c in numbers]).astype(np.int64))

    def answers(self, rows: list[pa.RecordBatch]) -> np.ndarray:
        """The sums of all parts for this part's keys, a row for each number."""
        parts = [[_read(b.column(c)[0]) for c in (2, 3, 4)] for b in rows]
        key, kind = np.concatenate([x[0].astype(np.uint64) for x in parts]), np.concatenate([x[1] for x in parts])
        sums = np.concatenate([x[2].astype(np.int64).reshape(-1, len(x[0])) for x in parts], axis=1)
        to, back = np.lexsort((self.keys, self.kinds)), np.lexsort((key, kind))
        if not (np.array_equal(self.keys[to], key[back]) and np.array_equal(self.kinds[to], kind[back])):
            raise ValueError("sums and keys of a part differ")
        out = np.empty_like(sums)
        out[:, to] = sums[:, back]
        return out

    def of_words(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the words' keys, by pair."""
        return x[self.kinds == 0][self.of_word]

    def by_key(self, words_: np.ndarray, near: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """A number for each key, from one for each pair (summed by word), nearer word and context."""
        return np.concatenate([np.bincount(self.of_word, words_, len(self.own_words)), near[self.hot], contexts[self.hot_context]])

    def whole(self, here: tuple[np.ndarray, np.ndarray], sums: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals of nearer words and of contexts: those of all parts where the nearer word is frequent."""
        near, context = (x.astype(float) for x in here)
        near[self.hot], context[self.hot_context] = sums[0][self.kinds == 1], sums[1][self.kinds == 2]
        return near, context

    def totals(self, by_pair: np.ndarray, by_type: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.of_near, by_pair, len(self.near)), np.bincount(self.of_context, by_type, len(self.context_near))

    def per_pair(self, by_type: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, by_type, len(self.word))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Training tokens, and distinct nearer words before each word, by key."""
        n = self.per_pair(self.n)
        return self.by_key(n, *self.totals(n, self.n)), self.by_key(n > 0, np.zeros(len(self.near)), np.zeros(len(self.context_near)))

    def sample(self, s: Setting, sums: np.ndarray, root: Root, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tables of types, customers and tables of pairs in the last sweeps. sums: of counted() over all parts.

        The root is kept as it is with a table for each pair. Totals of contexts of which other parts have a share are
        reckoned from those here, by tokens.
        """
        p1 = root.probability(s, self.of_words(sums[1]), np.minimum(self.of_words(sums[1]), 1), 0)
        here = self.totals(self.per_pair(self.n), self.n)
        up, up_context = (np.divide(a, b, out=np.zeros(len(b)), where=b > 0) for a, b in zip(self.whole(here, (sums[0], sums[0])), here, strict=True))
        t3 = np.minimum(self.n, 1)
        many = np.flatnonzero(self.n > 1)  # the others have a table whatever is drawn
        customers, pair, context = self.n[many], self.pair[many], self.of_context[many]
        once = np.where(self.n > 1, 0, t3)
        fixed, fixed_context = self.per_pair(once).astype(np.int64), np.bincount(self.of_context, once, len(self.context_near))
        k2 = self.per_pair(t3).astype(np.int64)
        t2 = np.minimum(k2, 1)
        out = []
        for sweep in range(s.sweeps):
            opened = np.bincount(self.of_near, t2, len(self.near))
            opened_context = fixed_context + np.bincount(context, t3[many], len(fixed_context))
            weight = (s.strength + s.discount * opened * up)[self.of_near] * p1
            p2 = (k2 - s.discount * t2 + weight) / (s.strength + np.bincount(self.of_near, k2, len(up)) * up)[self.of_near]
            t3 = t3.copy()
            t3[many] = draw_tables(customers, (s.strength + s.discount * opened_context * up_context)[context] * p2[pair], s.discount, random)
            k2 = fixed + np.bincount(pair, t3[many], len(fixed)).astype(np.int64)
            t2 = draw_tables(k2, weight, s.discount, random)
            if sweep >= s.sweeps - s.samples:
                out.append((t3, k2, t2))
        return out

    def seated(self, samples: list) -> list[np.ndarray]:
        """By key: customers in each sample, then tables (of words: none, the root draws them)."""
        nothing, none = np.zeros(len(self.word)), np.zeros(len(self.context_near))
        customers = [self.by_key(t2, self.totals(k2, t3)[0], none) for t3, k2, t2 in samples]
        return customers + [self.by_key(nothing, *self.totals(t2, t3)) for t3, k2, t2 in samples]

    def log10(self, s: Setting, samples: list, sums: np.ndarray, root: Root) -> np.ndarray:
        """Averaged predictive log10 probability of each type. sums: training tokens and seated() over all parts."""
        total = np.zeros(len(self.n))
        for i, (t3, k2, t2) in enumerate(samples):
            customers, tables = sums[2 + i], sums[2 + s.samples + i]
            p = root.probability(s, self.of_words(customers), self.of_words(tables), i)
            held, held_context = self.whole(self.totals(k2, self.n), (customers, sums[0]))
            opened, opened_context = self.whole(self.totals(t2, t3), (tables, tables))
            p = (k2 - s.discount * t2 + (s.strength + s.discount * opened)[self.of_near] * p) / (s.strength + held)[self.of_near]
            total += (self.n - s.discount * t3 + (s.strength + s.discount * opened_context)[self.of_context] * p[self.pair]) / (s.strength + held_context)[self.of_context]
        return np.log10(total / len(samples))


@dataclass
class Root:
    """Words, and in each sample customers and tables of the root."""

    vocabulary: int
    customers: list
    tables: list

    def probability(self, s: Setting, customers: np.ndarray, tables: np.ndarray, sample: int) -> np.ndarray:
        return (customers - s.root_discount * tables + (s.root_strength + s.root_discount * self.tables[sample]) / (self.vocabulary + 1)) / (s.root_strength + self.customers[sample])


def _summed(asked: DataFrame, parts: int, setting: Setting, vocabulary: int | None) -> tuple[DataFrame, np.ndarray]:
    """The sums of all parts for the keys of each part, and of the words' keys: how many were trained on, and the sum of each number. vocabulary: draws the words' tables in the root."""
    samples = setting.samples

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for b in batches:
            for k, slot in enumerate(b.column(0).to_pylist()):
                by.setdefault(slot, []).append(b.slice(k, 1))
        for slot in sorted(by):
            rows = sorted(by.pop(slot), key=lambda b: b.column(1)[0].as_py())
            key, kind = [_read(b.column(2)[0]).astype(np.uint64) for b in rows], [_read(b.column(3)[0]) for b in rows]
            width = 2 if vocabulary is None else 2 + 2 * samples
            numbers = [_read(b.column(4)[0]).reshape(width, -1) for b in rows]
            edge = np.cumsum([0, *map(len, key)])
            first, at = distinct(np.concatenate(key) ^ np.concatenate(kind).astype(np.uint64))
            is_word = np.zeros(len(first), bool)
            is_word[at[np.concatenate(kind) == 0]] = True
            sums = np.stack([np.bincount(at, np.concatenate([n[c] for n in numbers]), len(first)) for c in range(width)]).astype(np.int64)
            if vocabulary is not None:
                random = np.random.default_rng([setting.seed, 2**31, slot])
                pull = np.full(int(is_word.sum()), (setting.root_strength + setting.root_discount * vocabulary) / (vocabulary + 1))
                for i in range(samples):
                    sums[2 + samples + i, is_word] = draw_tables(sums[2 + i, is_word], pull, setting.root_discount, random)
            for x, y, b, k, d in zip(edge[:-1], edge[1:], rows, key, kind, strict=True):
                yield _row(b.column(1)[0].as_py(), -1, k, d, sums[:, at[x:y]])
            yield _row(-1, -1, None, None, np.append((sums[0, is_word] > 0).sum(), sums[:, is_word].sum(1)))

    out = stored(asked.repartition(parts, "part").mapInArrow(add, PACKED_SCHEMA), "sums")
    totals = [_read(bytes(r[0])).astype(np.int64) for r in out.where("part < 0").select("far").collect()]  # a row for each slot
    return out.where("part >= 0"), np.sum(totals, axis=0) if totals else np.zeros(3 + (0 if vocabulary is None else 2 * samples), np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """Of each part the rows of entries and the sums for its keys."""
    by: dict = {}
    for b in batches:
        for k, part in enumerate(b.column(0).to_pylist()):
            by.setdefault(part, ([], []))[0 if b.column(5)[k].is_valid else 1].append(b.slice(k, 1))
    for part in sorted(by):
        yield part, *by.pop(part)


@dataclass
class Model:
    setting: Setting
    frequent: np.ndarray
    tokens: int  # in training
    parts: int
    first: Root | None = None  # with a table for each pair
    root: Root | None = None

    def sampled(self, part: int, p: Part, sums: np.ndarray) -> list:
        return p.sample(self.setting, sums, self.first, np.random.default_rng([self.setting.seed, part]))


def fit(texts: DataFrame, setting: Setting, part_tokens: int = 2_000_000) -> tuple[Model, DataFrame]:
    """The model's totals, and the sums that each part needs. texts: text and train."""
    spark = texts.sparkSession
    frequent, _, tokens = _survey(texts)
    frequent = np.union1d(frequent, [START]).astype(np.uint64)
    parts = int(2 * tokens // part_tokens) + 1  # a part also holds the types of texts that are held out

    def count(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            word, starts, mark = zip(*held, strict=True)
            before = np.cumsum([0, *map(len, word)])
            yield from _pack(0, np.concatenate(word), np.concatenate([a + b for a, b in zip(starts, before, strict=False)]), np.concatenate(mark), frequent, parts, (group, COUNTED))

        for b in batches:
            data, bounds = buffers(b.column(0))
            train = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            for i, j in slices(bounds, SLICE_BYTES):
                h, at = token_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                held.append((h, at[:-1], np.repeat(np.where(train[i:j], TRAIN_BIT, 0).astype("<u2"), np.diff(at))))
                size += len(h)
                if size > FLUSH_TOKENS:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, _ in _grouped(batches):
            p = Part(rows, frequent)
            yield _row(part, 0, p.words, p.near_of_pair[p.pair], p.far, p.word[p.pair], np.full(len(p.n), TRAIN_BIT), p.n)
            yield from p.ask(part, parts, *p.counted())

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, answers in _grouped(batches):
            p = Part(rows, frequent)
            samples = model.sampled(part, p, p.answers(answers))
            yield from p.ask(part, parts, *p.counted(), *p.seated(samples))

    model = Model(setting, frequent, tokens, parts)
    paths, types = [], []
    for group in range(COUNTED):
        dealt = texts.select("text", "train").mapInArrow(partial(count, group=group), PACKED_SCHEMA)
        types.append(stored(dealt.repartition(parts, "part").mapInArrow(gather, PACKED_SCHEMA), "types"))
        paths.append(written()[-1])
        release(spark)
    first, totals = _summed(reduce(DataFrame.unionAll, types).where("word is null"), parts, setting, None)
    first_path = written()[-1]
    model.first = Root(int(totals[0]), [int(totals[2])], [int(totals[0])])
    seated = []
    for group in range(COUNTED):
        for part in range(group, SEATED, COUNTED):
            own = types[group].where("word is not null").unionAll(first).where(F.col("part") % SEATED == part)
            seated.append((stored(own.repartition(parts, "part").mapInArrow(seat, PACKED_SCHEMA), "seated"), written()[-1]))
            release(spark)
        discard(spark, [paths[group]])
    discard(spark, [first_path])
    asked = reduce(DataFrame.unionAll, [df for df, _ in seated])
    sums, totals = _summed(asked, parts, setting, model.first.vocabulary)
    model.root = Root(int(totals[0]), totals[3 : 3 + setting.samples].tolist(), totals[3 + setting.samples :].tolist())
    discard(spark, [path for _, path in seated])
    return model, sums


def scores(docs: DataFrame, setting: Setting | None = None, part_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    Texts whose crc32 of the id as text leaves 2 modulo 7 are held out of training. score: the model's log10 probability
    of the text with its end token; base_score: the same by add-one unigrams; perplexity: 10 ** (-score / n_tokens).
    A null or empty text is its end token alone; a row with a null id is trained on and scored; repeated rows count each
    time; without training tokens every probability is 1 / 1; an empty table gives an empty result; other columns are not
    read.
    """
    setting = setting or Setting()
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _training(F.col(id_col)).alias("train"))
    m, sums = fit(texts, setting, part_tokens)
    sums_path = written()[-1]
    release(docs.sparkSession)
    id_kind = docs.schema[id_col].dataType.simpleString()
    all_ = m.tokens + m.root.vocabulary + 1

    def deal(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
        """Entries of all tokens of a group, and in the first one for each block a row (part -1) of its texts."""
        held, ids, known, size, flush = [], [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            block = (TaskContext.get().partitionId() << 20) + flush
            word, starts, mark = zip(*held, strict=True)
            before = np.cumsum([0, *map(len, word)])
            for row in _pack(block, np.concatenate(word), np.concatenate([a + b for a, b in zip(starts, before, strict=False)]), np.concatenate(mark), m.frequent, m.parts, (group, SCORED)):
                yield with_ids(row, None)
            if group:
                return
            numbers = np.concatenate(known).astype("<f8").tobytes()
            row = pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([block], pa.int64()), pa.array([numbers], pa.binary()), *(pa.nulls(1, pa.binary()) for _ in range(5))], PACKED)
            yield with_ids(row, pa.concat_arrays(ids))

        def with_ids(b: pa.RecordBatch, own: pa.Array | None) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own) if own is not None else pa.nulls(len(b), pa.list_(id_type[0]))
            return pa.RecordBatch.from_arrays([*b.columns, lists], [*PACKED, "ids"])

        id_type: list = []
        for b in batches:
            id_type[:] = [b.column(0).type]
            data, bounds = buffers(b.column(1))
            train = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            for i, j in slices(bounds, SLICE_BYTES):
                for lo in range(i, j, FLUSH_DOCS // 2):
                    hi = min(j, lo + FLUSH_DOCS // 2)
                    h, at = token_hashes(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                    docs_held = sum(map(len, ids))
                    if docs_held and (size > FLUSH_TOKENS or docs_held + hi - lo > FLUSH_DOCS):
                        yield from out()
                        held, ids, known, size, docs_held, flush = [], [], [], 0, 0, flush + 1
                    held.append((h, at[:-1], np.repeat((np.arange(docs_held, docs_held + hi - lo) | np.where(train[lo:hi], TRAIN_BIT, 0)).astype("<u2"), np.diff(at))))
                    none = np.zeros(hi - lo)
                    known.append(np.stack([np.diff(at), none, none, none, ~train[lo:hi]], 1).astype(float))
                    ids.append(b.column(0)[lo:hi])
                    size += len(h)
        if ids:
            yield from out()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the tokens of a part for each text of each block; rows of texts pass."""
        passed = []

        def parts() -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.array(b.column(0).to_pylist(), np.int64) >= 0
                for k in np.flatnonzero(~own):
                    passed.append(pa.RecordBatch.from_arrays([b.column(1)[k : k + 1], b.column(2)[k : k + 1], pa.nulls(1, pa.binary()), b.column(8)[k : k + 1]], ["block", "numbers", "text", "ids"]))
                yield b.filter(pa.array(own))

        for part, rows, answers in _grouped(parts()):
            ids_type = (rows or answers)[0].column(8).type
            p = Part(rows, m.frequent)
            totals = p.answers(answers)
            log = p.log10(setting, m.sampled(part, p, totals), totals, m.root)
            count = p.of_words(totals[0])[p.pair][p.at]
            text = (p.mark & np.uint16(TRAIN_BIT - 1)).astype(np.int64)
            numbers = [p.count * (count > 0), p.count * np.log10((count + 1) / all_), p.count * log[p.at]]
            x = 0
            for block, n in p.blocks:
                t = text[x : x + n]
                own = np.flatnonzero(np.bincount(t))
                sums_ = np.stack([np.bincount(t, c[x : x + n])[own] for c in numbers], 1)
                x += n
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums_.astype("<f8").tobytes()], pa.binary()), pa.array([own.astype("<u2").tobytes()], pa.binary()), pa.nulls(1, ids_type)], ["block", "numbers", "text", "ids"])
        yield from passed

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        ids: dict = {}
        for b in batches:
            for k, block in enumerate(b.column(0).to_pylist()):
                x = np.frombuffer(b.column(1)[k].as_buffer(), "<f8")
                total = sums.setdefault(block, np.zeros((FLUSH_DOCS, 5)))
                if b.column(2)[k].is_valid:
                    total[np.frombuffer(b.column(2)[k].as_buffer(), "<u2"), 1:4] += x.reshape(-1, 3)
                else:
                    x = x.reshape(-1, 5)
                    total[: len(x)] += x
                    ids[block] = b.column(3)[k].values
        for block, own in ids.items():
            x = sums.pop(block)[: len(own)]
            yield pa.RecordBatch.from_arrays([own, pa.array(x[:, 4] > 0), pa.array(x[:, 0].astype(np.int64)), pa.array(np.rint(x[:, 1]).astype(np.int64)), pa.array(x[:, 2]), pa.array(x[:, 3])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    packed = f"{PACKED_SCHEMA}, ids array<{id_kind}>"
    where = F.when(F.col("part") < 0, F.xxhash64("block")).otherwise(F.col("part"))
    summed_kind = f"block long, numbers binary, text binary, ids array<{id_kind}>"
    summed = None
    for group in range(SCORED):
        own = sums.where(F.col("part") % SCORED == group).withColumn("ids", F.lit(None).cast(f"array<{id_kind}>"))
        entries = texts.mapInArrow(partial(deal, group=group), packed).unionAll(own)
        some = stored(entries.repartition(m.parts, where).mapInArrow(score, summed_kind), "scored")
        release(docs.sparkSession)
        summed = some if summed is None else summed.unionAll(some)
    discard(docs.sparkSession, [sums_path])
    done = summed.repartition(m.parts, "block").mapInArrow(finish, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(m.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
