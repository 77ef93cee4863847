"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches, stored
from ._text import LOWER, buffers, hash_spans, shingles, slices, words

SLICE_BYTES = 2 << 20
MATCH, MISS, GAP = 2, -1, -1
FILTER_BITS = 24

# Letters, digits and bytes beyond ASCII are words; all else is replaced by a space.
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


@dataclass
class Items:
    """Words and seeds of a block of benchmark items."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray  # distinct seed hashes, ascending
    of_seed: np.ndarray  # the seed, item and place in the item of each occurrence, ordered by seed
    item: np.ndarray
    place: np.ndarray
    n: int

    def __post_init__(self):
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.seed >> np.uint64(64 - FILTER_BITS)] = True
        self.first = np.searchsorted(self.of_seed, np.arange(len(self.seed) + 1))

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the runs that are seeds, and which."""
        at = np.flatnonzero(self.maybe[runs >> np.uint64(64 - FILTER_BITS)])
        if not len(self.seed) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.seed, runs[at]), len(self.seed) - 1)
        same = self.seed[k] == runs[at]
        return at[same], k[same]


def text_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, without case (A-Z) and marks, and each text's bounds among them."""
    plain = _PLAIN[data]
    starts, ends, at = words(plain, bounds)
    return hash_spans(plain, starts, ends), at


def make_items(rows: list[tuple], n: int) -> Items:
    ids, each = [], []
    for item_id, text in rows:
        h, _ = text_words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        ids.append(item_id)
        each.append(h)
    runs = [shingles(h, n) if len(h) >= n else np.zeros(0, np.uint64) for h in each]
    item = np.repeat(np.arange(len(runs)), list(map(len, runs))).astype(np.int64)
    place = np.concatenate([np.arange(len(r)) for r in runs]) if runs else np.zeros(0, np.int64)
    seed, of_seed = np.unique(np.concatenate(runs), return_inverse=True) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(of_seed, kind="stable")
    return Items(ids, each, seed.astype(np.uint64), of_seed[order], item[order], place[order].astype(np.int64), n)


def _runs(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a batch, each text's bounds among them, and hashes of the runs of n words, zero where a run leaves its text."""
    h, at = text_words(data, bounds)
    runs = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        runs[: len(h) - n + 1] = shingles(h, n)
    for k in range(1, n):
        cut = at[1:] - k
        runs[cut[(cut >= 0)]] = 0
    return h, at, runs


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item with each passage (a row, padded with 0), and the word where it ends.

    One row of the Smith-Waterman table at a time for all passages at once; a gap along the row is a running maximum.
    """
    slope = np.arange(len(item)) * -GAP
    h = np.zeros((len(passages), len(item)), np.int64)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for k in range(passages.shape[1]):
        step = np.where(passages[:, k, None] == item[None, :], MATCH, MISS)
        step[:, 1:] += h[:, :-1]
        np.maximum(step, h + GAP, out=step)
        np.maximum(step, 0, out=step)
        h = np.maximum.accumulate(step + slope, axis=1) - slope
        now = h.max(1)
        end[now > best] = k
        np.maximum(best, now, out=best)
    return best, end


def enough(item: np.ndarray, passages: np.ndarray, threshold: float) -> np.ndarray:
    """Passages that hold words of the item so often that their matches alone reach the threshold; the others cannot."""
    own = np.unique(item)
    k = np.minimum(np.searchsorted(own, passages), len(own) - 1)
    return (own[k] == passages).sum(1) >= threshold * len(item)


def _candidates(items: Items, h: np.ndarray, at: np.ndarray, runs: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By item: text, first and last word of each passage that holds a seed.

    A seed at word p of a text and word q of an item speaks for a copy that begins near word p - q. Beginnings are put
    in bins as long as the item; a passage is such a bin and all that an alignment beginning there can reach, so its
    length is bounded by the item's.
    """
    where, which = items.find(runs)
    if not len(where):
        return {}
    count = items.first[which + 1] - items.first[which]
    occurrence = np.repeat(items.first[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    p = np.repeat(where, count)
    item = items.item[occurrence]
    text = np.searchsorted(at, p, "right") - 1
    length = np.array([len(w) for w in items.words], np.int64)[item]
    begin = p - at[text] - items.place[occurrence]
    found = np.unique(np.stack([item, text, np.floor_divide(begin, length)], 1), axis=0)
    out = {}
    for i in np.unique(found[:, 0]):
        _, t, b = found[found[:, 0] == i].T
        n = len(items.words[i])
        slack = n // 2 + 2
        out[int(i)] = (t, np.maximum(at[t] + b * n - slack, at[t]), np.minimum(at[t] + (b + 2) * n + slack, at[t + 1]))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score and end of the best aligned passage of each text and item whose score reaches the threshold.

    score: Smith-Waterman score over words (match 2, other word -1, gap -1) as a share of the item's score with itself;
    end: the word (from 0) after the passage. Words are without case and marks. Every n-gram of an item is a seed, however
    common; every passage with a seed is aligned unless it has too few of the item's words to reach the threshold. A copy
    without n neighbouring words of the item isn't found. Items go to all tasks in blocks of at most block_items. An item
    of fewer than n words, or null, has no seed and matches nothing; a null or empty text matches nothing; repeated rows
    give repeated results; empty tables give an empty result; other columns are not read. No shuffle of texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    blocks = int(items.count() // block_items) + 1
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, score double, end int"
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = make_items(sorted((tuple(r) for r in part.collect()), key=str), n)
        found = _aligned(texts, block, threshold, schema)
        out = found if out is None else out.unionAll(found)
    return out


def _aligned(texts: DataFrame, items: Items, threshold: float, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = buffers(b.column(1))
            for i, j in slices(bounds, SLICE_BYTES):
                h, at, runs = _runs(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], items.n)
                best: dict = {}
                for item, (text, first, last) in _candidates(items, h, at, runs).items():
                    own = items.words[item]
                    for lo in range(0, len(text), 512):
                        f, e = first[lo : lo + 512], last[lo : lo + 512]
                        cells = f[:, None] + np.arange((e - f).max())
                        passages = np.where(cells < e[:, None], h[np.minimum(cells, len(h) - 1)], 0)
                        some = enough(own, passages, threshold)
                        got, end = align(own, passages[some])
                        t = text[lo : lo + 512][some]
                        for t, s, x in zip(t, got / (MATCH * len(own)), f[some] + end + 1 - at[t], strict=True):
                            if s >= threshold and best.get((t, item), (0,))[0] < s:
                                best[t, item] = (s, x)
                if best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[i:j].take(pa.array([t for t, _ in keys])), pa.array([items.ids[m] for _, m in keys], out_kind), pa.array([best[x][0] for x in keys]), pa.array([int(best[x][1]) for x in keys], pa.int32())],
                        ["doc_id", "item_id", "score", "end"],
                    )

    out_kind = pa.int64() if "item_id bigint" in schema else None
    return texts.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that match no item. Rows whose id is null stay."""
    id_col = options.get("id_col", "doc_id")
    dirty = stored(matches(docs, benchmark, **options).select("doc_id"), "leaks").distinct()
    return docs.join(dirty, docs[id_col] == dirty["doc_id"], "left_anti")
