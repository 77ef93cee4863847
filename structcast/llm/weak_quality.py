"""Quality from weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded_batches
from ._text import LOWER, buffers, hash_spans, mix, shingles, slices, words

SLICE_BYTES = 2 << 20
BUCKETS = 1 << 16
# Frequent function words of English, French, German and Spanish.
STOP = "the of and to in a is that for it as was with be by on not or are from this at le la les de des du et un une que qui dans pour par au aux en der die das und zu den dem nicht von mit auf ein eine el los las y del se con su para es al".split()
_STOP = b" ".join(w.encode() for w in STOP)
ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("case", "symbols", "doubled marks", "lone marks", "stop words", "repeats", "line ends", "word length", "stutter")
PSEUDO = 8  # words without features that every text is taken to have besides its own, so that short texts stay near the bias

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_RARE_MARK = _MARK.copy()
_RARE_MARK[[ord(c) for c in ".,;:'\"()-?"]] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:\")"]] = True
_SHAPE = np.full(256, ord("#"), np.uint8)
_SHAPE[_LETTER] = ord("a")
_SHAPE[_UPPER] = ord("A")
_SHAPE[48:58] = ord("0")


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(_STOP, np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]))
    return np.sort(hash_spans(data, s, e))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


@dataclass
class Batch:
    """Words of a batch of texts, with what labellers and features need."""

    data: np.ndarray
    bounds: np.ndarray

    def __post_init__(self):
        self.starts, self.ends, self.at = words(self.data, self.bounds)
        self.low = LOWER[self.data]
        self.hash = hash_spans(self.low, self.starts, self.ends)
        self.n = np.diff(self.at).astype(np.float64)

    def votes(self) -> np.ndarray:
        """A row for each text, a column for each labeller. A labeller abstains between its two limits and on texts too short for it."""
        size = np.maximum(np.diff(self.bounds), 1).astype(np.float64)
        n = np.maximum(self.n, 1)
        letters = np.maximum(_per_text(_LETTER[self.data], self.bounds), 1)
        upper = _per_text(_UPPER[self.data], self.bounds) / letters
        marks = _per_text(_RARE_MARK[self.data], self.bounds) / size
        last = self.data[self.ends - 1]
        long = self.ends - self.starts > 1
        doubled = _MARK[last] & long & (self.data[np.maximum(self.ends - 2, 0)] == last)
        doubled = _per_text(doubled, self.at) / n
        lone = _per_text(_MARK[last] & ~long, self.at) / n
        stops = _stop_hashes()
        k = np.minimum(np.searchsorted(stops, self.hash), len(stops) - 1)
        stop = _per_text(stops[k] == self.hash, self.at) / n
        repeats = self._repeats()
        line = np.flatnonzero(self.data == 10)
        ends = np.concatenate([line, self.bounds[1:]]) - 1
        full = (ends >= 0) & (self.data[np.maximum(ends, 0)] != 10) if len(self.data) else np.zeros(len(ends), bool)
        text = np.clip(np.searchsorted(self.bounds, np.maximum(ends, 0), "right") - 1, 0, len(self.n) - 1)
        lines = np.bincount(text[full], minlength=len(self.n)).astype(np.float64)
        closed = np.bincount(text[full], _END[self.data[ends[full]]], minlength=len(self.n)) / np.maximum(lines, 1)
        length = _per_text((self.ends - self.starts).astype(np.int64), self.at) / n
        stutter = _per_text(self._again(), self.at) / n

        def vote(bad: np.ndarray, good: np.ndarray, least: int = 1) -> np.ndarray:
            return np.where(self.n < least, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))

        return np.stack(
            [
                vote(upper > 0.5, upper < 0.2, 3),
                vote(marks > 0.08, marks < 0.02, 3),
                vote(doubled > 0.1, doubled < 0.01, 3),
                vote(lone > 0.1, lone < 0.01, 3),
                vote(stop < 0.05, stop > 0.12, 12),
                vote(repeats > 0.3, repeats < 0.1, 20),
                vote(closed < 0.3, closed > 0.7, 8),
                vote((length > 12) | (length < 2.5), (length > 3) & (length < 8), 8),
                vote(stutter > 0.1, stutter < 0.02, 8),
            ],
            1,
        )

    def _again(self) -> np.ndarray:
        """For each word: is it the word before it, in the same text?"""
        out = np.zeros(len(self.hash), bool)
        out[1:] = self.hash[1:] == self.hash[:-1]
        first = self.at[:-1]
        out[first[first < len(out)]] = False
        return out

    def _repeats(self) -> np.ndarray:
        """Share of a text's runs of five words that it has had before."""
        out = np.zeros(len(self.n))
        if len(self.hash) < 5:
            return out
        runs = shingles(self.hash, 5)
        for t in np.flatnonzero(self.n >= 20):
            own = runs[self.at[t] : self.at[t + 1] - 4]
            out[t] = 1 - len(np.unique(own)) / len(own)
        return out

    def features(self) -> np.ndarray:
        """Four hashed features of each word: the word, its last three bytes, its shape (kinds of byte), and whether it repeats the word before."""
        shape = _SHAPE[self.data]
        kinds = (self.hash, hash_spans(self.low, np.maximum(self.starts, self.ends - 3), self.ends, 1), hash_spans(shape, self.starts, self.ends, 2), mix(self._again().astype(np.uint64) + np.uint64(3)))
        return np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in kinds], 1)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: each pattern's probability of good, and P(vote | class, it votes) by labeller.

    It starts from the votes, where one for bad weighs as much as five for good, for labellers vote bad on rare and
    glaring signs only. An abstention says nothing. The classes keep their meaning because a vote for good is never
    taken to speak for bad.
    """
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    p = (good + 1) / (good + 5 * bad + 2)
    table = np.full((2, patterns.shape[1], 3), 0.5)
    voted = (patterns != ABSTAIN)[None]
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        for v in (GOOD, BAD):
            table[:, :, v] = weight @ (patterns == v) + 1
        table[:, :, GOOD] /= table[:, :, 1:].sum(2)
        table[1, :, GOOD] = np.maximum(table[1, :, GOOD], table[0, :, GOOD])
        table[:, :, BAD] = np.maximum(1 - table[:, :, GOOD], 1e-6)
        prior = np.clip(weight.sum(1) / max(counts.sum(), 1), 1e-3, 1)
        each = np.log(table)[:, np.arange(patterns.shape[1])[None, :], patterns]
        like = np.log(prior)[:, None] + np.where(voted, each, 0).sum(2)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-6:
            return new, table
        p = new
    return p, table


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Logistic regression on mean hashed features, by 64,000 steps of Adagrad, or 300 rounds, in a fixed random order."""
    rounds = min(300, 64_000 // max(len(rows), 1) + 1)
    w, b = np.zeros(BUCKETS), 0.0
    g2, b2 = np.full(BUCKETS, 1e-6), 1e-6
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -30, 30)))
            g = p - target[k]
            step = g * x
            g2[at] += step**2
            w[at] -= rate * step / np.sqrt(g2[at])
            b2 += g * g
            b -= rate * g / np.sqrt(b2)
    return w, b


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    codes: np.ndarray  # vote patterns as numbers in base 3, ascending
    p_good: np.ndarray
    accuracies: np.ndarray

    def score(self, b: Batch) -> np.ndarray:
        """The scorer's probability of good; 0 for a text without words."""
        if not len(b.hash):
            return np.zeros(len(b.n))
        each = self.weights[b.features()].sum(1)
        z = _per_text(each, b.at) / (b.n + PSEUDO) + self.bias
        return np.where(b.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _code(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _pattern(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit(docs: DataFrame, fit_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Label model over the votes on all texts; scorer from about fit_rows texts chosen by hash of id and text.

    The driver gets counts of at most 3**9 vote patterns and the features of the chosen texts (65,536 buckets at most
    each). fit_rows is the documented bound on what the scorer is fitted to; votes, accuracies and posteriors cover
    every text.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            data, bounds = buffers(b.column(0))
            for i, j in slices(bounds, SLICE_BYTES):
                part = Batch(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                total += np.bincount(_code(part.votes()), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    counted = sorted(map(tuple, texts.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n")).collect()))
    codes = np.array([c for c, _ in counted], np.int64)
    counts = np.array([n for _, n in counted], np.float64)
    p_good, table = label_model(_pattern(codes), counts)
    rows = int(counts.sum())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = buffers(b.column(0))
            for i, j in slices(bounds, SLICE_BYTES):
                part = Batch(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                code, every = _code(part.votes()), part.features()
                out = []
                for t in range(j - i):
                    at, n = np.unique(every[part.at[t] : part.at[t + 1]], return_counts=True)
                    out.append((int(code[t]), at.astype("<i4").tobytes(), (n / (part.n[t] + PSEUDO)).astype("<f4").tobytes()))
                code_, at_, x_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(code_, pa.int32()), pa.array(at_, pa.binary()), pa.array(x_, pa.binary())], ["code", "at", "x"])

    share = int(min(1.0, fit_rows / max(rows, 1)) * (1 << 30))
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select("text")
    sample = sorted(map(tuple, chosen.mapInArrow(features, "code int, at binary, x binary").limit(2 * fit_rows).collect()))
    target = p_good[np.searchsorted(codes, [s[0] for s in sample])] if sample else np.zeros(0)
    weights, bias = fit_scorer([(np.frombuffer(bytes(a), "<i4"), np.frombuffer(bytes(x), "<f4").astype(np.float64)) for _, a, x in sample], target)
    return Model(weights, bias, codes, p_good, table)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, weak_good (posterior of the votes), score (of the scorer) and keep (score at least the threshold) of every row.

    A null text counts as empty; a text without words has score 0 and goes. Repeated rows and null ids stay as they are;
    an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = buffers(b.column(1))
            for i, j in slices(bounds, SLICE_BYTES):
                part = Batch(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                weak = model.p_good[np.minimum(np.searchsorted(model.codes, _code(part.votes())), len(model.codes) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(weak), pa.array(model.score(part))], ["doc_id", "weak_good", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, weak_good double, score double").withColumn("keep", F.col("score") >= threshold)


def kept(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold; no shuffle."""
    bounded_batches(docs.sparkSession)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = buffers(b.column(column))
            for i, j in slices(bounds, SLICE_BYTES):
                part = Batch(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield b.slice(i, j - i).filter(pa.array(model.score(part) >= threshold))

    return docs.mapInArrow(run, docs.schema)
