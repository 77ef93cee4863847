"""Byte-pair encoding and decoding with a contiguous array of ranks for each short piece."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import PieceTable, byte_letters
from ._store import bounded_batches
from ._text import slices

NONE = np.int32(2**31 - 1)
SHORT = 64
SLICE_BYTES = 2 << 20
# White space of Unicode, and the public pattern that splits text before the merges.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


class Codec:
    """Encoder and decoder of one vocabulary file (JSON with vocab, merges and added_tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.token = [b""] * self.size
        for t, i in vocab.items():
            self.token[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        for t, i in self.special.items():
            self.token[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed(list(enumerate(pairs)))}
        key = np.array([a * self.size + b for a, b in rank], np.int64)
        order = np.argsort(key)
        self.key = np.append(key[order], np.int64(2**62))
        self.rank = np.append(np.array([r for r, _ in rank.values()], np.int32)[order], NONE)
        self.made = np.append(np.array([m for _, m in rank.values()], np.int32)[order], -1)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = PieceTable(self._encode_pieces)

    def _at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges; the last place if it is none."""
        k = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.key, k)
        at[self.key[at] != k] = len(self.key) - 1
        return at

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self._at(left, right)]

    def _short(self, parts: np.ndarray) -> list[np.ndarray]:
        """Ids for pieces of equal length: a row holds a piece's parts, and beside them the rank of each neighbouring pair.

        Every round scans each row for its least rank, deletes the boundary there and refreshes the two ranks beside it;
        a row without a rank is done.
        """
        out: list = [None] * len(parts)
        row = np.arange(len(parts))
        ranks = self._ranked(parts[:, :-1], parts[:, 1:])
        while len(row):
            n = parts.shape[1]
            at = ranks.argmin(1) if n > 1 else np.zeros(len(row), np.int64)
            here = np.arange(len(row))
            ended = ranks[here, at] == NONE if n > 1 else np.ones(len(row), bool)
            if ended.any():
                for r, ids in zip(row[ended], parts[ended], strict=True):
                    out[r] = ids
                go = ~ended
                row, parts, ranks, at = row[go], parts[go], ranks[go], at[go]
                here = np.arange(len(row))
                if not len(row):
                    break
            parts[here, at] = self.made[self._at(parts[here, at], parts[here, at + 1])]
            parts = parts[np.arange(n) != (at + 1)[:, None]].reshape(len(row), n - 1)
            ranks = ranks[np.arange(n - 1) != at[:, None]].reshape(len(row), n - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranked(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < n - 2)
            ranks[right, at[right]] = self._ranked(parts[right, at[right]], parts[right, at[right] + 1])
        return out

    def _long(self, data: bytes) -> np.ndarray:
        """Ids of one long piece; a heap of pairs takes the place of the scan."""
        ids = self.first[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._ranked(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k] = int(self.made[self._at(np.array([a]), np.array([b]))[0]])
            ids[j] = -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if right < n and (r := int(self._ranked(np.array([ids[left]]), np.array([ids[right]]))[0])) != NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return np.array([i for i in ids if i >= 0], np.uint32)

    def _encode_pieces(self, pieces: list) -> tuple[list, np.ndarray, list[int]]:
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        data: list = [None] * len(pieces)
        for k, p in enumerate(pieces):
            if isinstance(p, tuple):
                out[k] = np.array([p[0]], np.uint32)
            else:
                data[k] = p.encode()
                by_length.setdefault(len(data[k]), []).append(k)
        for n, where in by_length.items():
            if n > SHORT:
                for k in where:
                    out[k] = self._long(data[k])
                continue
            step = max(1, (1 << 20) // n)
            for first in range(0, len(where), step):
                some = where[first : first + step]
                parts = self.first[np.frombuffer(b"".join(data[k] for k in some), np.uint8)].reshape(len(some), n)
                for k, ids in zip(some, self._short(parts), strict=True):
                    out[k] = ids
        return pieces, np.concatenate(out), [len(x) for x in out]

    def pieces(self, text: str) -> list:
        """The pieces that merges never cross; a special token is a tuple of its id."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append((self.special[part],))
            else:
                out += self.pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers."""
        cut = [self.pieces(t) for t in texts]
        self.table.add(set().union(*cut))
        return [self.table.ids(ps) for ps in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row: binary, little-endian unsigned 32-bit.

    A row in, a row out, without a shuffle. A null text counts as empty and has no ids; a null or repeated doc_id stays
    as it is; other columns are not read. `path` must be readable on every executor.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in slices(bounds, SLICE_BYTES):
                ids = own.encode([t or "" for t in texts[i:j].to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "ids"])
        own.table.clear()  # later stages share the worker's memory

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(tokens: DataFrame, path: str) -> DataFrame:
    """Adds the text that each row's ids stand for; rows come from encode_texts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for i in range(0, len(b), 256):
                ids = b.column(1)[i : i + 256]
                texts = [own.decode(np.frombuffer(x or b"", "<u4")) for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + 256], ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
