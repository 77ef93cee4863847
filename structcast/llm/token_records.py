"""Token ids in files of length-delimited binary records, and their offset index.

A record is

    u64 length of the payload | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload | 0x0A

all little-endian; a masked crc is the crc32 turned right by 15 bits plus 0xA282EAD8. The payload is a byte of flags
(1: the id is null, 2: ids have 4 bytes each, else 2), the 8-byte id of the text and its token ids. The last byte, which
Spark's writer sets after each record, is checked too. A file holds whole records; files part-00000, part-00001, ... hold
ascending ids. The index is a Parquet table with file, record, offset, length and doc_id, from which any record can be
read by itself, in any order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._pieces import SpanTable, byte_letters
from ._store import bounded_batches
from ._text import LOWER, buffers, hash_spans, slices, words

HEAD, FLAGS = struct.Struct("<QI"), struct.Struct("<Bq")
SLICE_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    payload = FLAGS.pack((doc_id is None) + 2 * bool(wide), doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, id and token ids of each record of a file; a damaged record is an error."""
    at = 0
    while at < len(data):
        size, crc = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != crc or at + 17 + size > len(data):
            raise ValueError(f"damaged record length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0] or data[at + 16 + size] != 0x0A:
            raise ValueError(f"damaged record at byte {at}")
        flags, doc_id = FLAGS.unpack_from(payload)
        yield at, 17 + size, None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=FLAGS.size)
        at += 17 + size


class Encoder:
    """The tokenizers library, asked once for each run of bytes without ASCII white space.

    The vocabulary drops white space and no merge, normal form or special token reaches across it, so the ids of a text
    are those of its runs, one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.marks = list(special)
        self.mark, self.mark_id = next(iter(special.items()), (b"", -1))
        self.letter = byte_letters()
        self.table = SpanTable(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
        """The pieces in another order, the ids of all of them, and how many each has.

        Letters in lower case go straight to the library's merges, for neither its normal form nor its pattern changes
        them, and so do end marks after an ASCII letter or digit, which the pattern parts from it. Other pieces go to it
        as one text with a special token between them, at which it cuts before anything else.
        """
        done, flat, lengths, rest = [], [], [], []
        tokenize, letter = self.tokenizer.model.tokenize, self.letter
        for p in pieces:
            core = p.rstrip(b".,;:!?")
            if core.isascii():
                if not (core.isalpha() and core.islower()):
                    rest.append(p)
                    continue
                ids = [x.id for x in tokenize(core.decode())]
                if len(core) < len(p):
                    ids += [x.id for x in tokenize(p[len(core) :].decode())]
            else:
                t = p.decode()
                if not (t.isalpha() and t == t.lower() and is_normalized("NFC", t)):
                    rest.append(p)
                    continue
                ids = [x.id for x in tokenize(p.decode("latin-1").translate(letter))]
            done.append(p)
            flat += ids
            lengths.append(len(ids))
        alone = [p for p in rest if not self.mark or any(m in p for m in self.marks)]
        for p in alone:
            ids = self.tokenizer.encode(p.decode(), add_special_tokens=False).ids
            done.append(p)
            flat += ids
            lengths.append(len(ids))
        if alone:
            rest = [p for p in rest if p not in set(alone)]
        for first in range(0, len(rest), 8192):
            some = rest[first : first + 8192]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(some).decode()], add_special_tokens=False)[0].ids
            end = [k for k, x in enumerate(ids) if x == self.mark_id] + [len(ids)]
            assert len(end) == len(some)
            start = [0] + [x + 1 for x in end[:-1]]
            done += some
            flat += [x for x in ids if x != self.mark_id]
            lengths += [y - x for x, y in zip(start, end, strict=True)]
        return done, flat, lengths

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.encode_buffer(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]))

    def encode_buffer(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text. Pieces are runs without white space; without case (A-Z), which the vocabulary drops, but for texts that may hold a special token."""
        low = LOWER[data]
        whole = data.tobytes()
        at = whole.find(b"<|")
        while at >= 0:
            text = int(np.searchsorted(bounds, at, "right")) - 1
            low[bounds[text] : bounds[text + 1]] = data[bounds[text] : bounds[text + 1]]
            at = whole.find(b"<|", int(bounds[text + 1]))
        starts, ends, cuts = words(low, bounds)
        hashes, first, where = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        place = self.table.places(hashes, low, starts[first], ends[first])
        flat = self.table.gather(place[where])
        lengths = self.table.lengths[place[where]]
        end = np.concatenate([[0], np.cumsum(lengths)])[cuts]
        return [flat[x:y] for x, y in zip(end[:-1], end[1:], strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, file_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text, each followed by end_id, as records in ascending id order.

    Rows are dealt by range of (id, hash of the text) into files of about file_bytes of text and sorted there, so equal
    ids, nulls (which come first) and any order of the input are fine. A null or empty text has only its end id. An
    empty table gives files without records. Other columns are not read. Spark's own writer commits the files, so a
    lost task leaves none behind.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    order = ["doc_id", "tie"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(int(total // file_bytes) + 1, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        last = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            data, bounds = buffers(b.column(1))
            for i, j in slices(bounds, SLICE_BYTES):
                ids = own.encode_buffer(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                out = [frame(d, np.concatenate([x, last])) for d, x in zip(b.column(0)[i:j].to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record in the files: file (number), record, offset, length, doc_id and ids (binary, little-endian unsigned 32-bit)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")

    def batch(file: int, rows: list) -> pa.RecordBatch:
        record, offset, length, doc_id, ids = zip(*rows, strict=True)
        ends = np.cumsum([0] + [4 * len(x) for x in ids]).astype(np.int32)
        flat = np.concatenate(ids, dtype="<u4")
        own = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([pa.array([file] * len(ids), pa.int32()), pa.array(record, pa.int32()), pa.array(offset), pa.array(length), pa.array(doc_id, pa.int64()), own], ["file", "record", "offset", "length", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                rows, held, file = [], 0, b.column(0)[k].as_py()
                for n, (at, length, doc_id, ids) in enumerate(frames(memoryview(b.column(1)[k].as_buffer()))):
                    rows.append((n, at, length, doc_id, ids))
                    held += length
                    if held > SLICE_BYTES:
                        yield batch(file, rows)
                        rows, held = [], 0
                if rows:
                    yield batch(file, rows)

    return files.mapInArrow(run, "file int, record int, offset long, length long, doc_id long, ids binary")


def add_starts(records: DataFrame) -> DataFrame:
    """Adds start: the number of ids in all records before. records: file, record, n_tokens; read twice, so a written table."""
    totals = sorted(map(tuple, records.groupBy("file").agg(F.sum("n_tokens")).collect()))  # a row for each file
    first, total = [], 0
    for file, n in totals:
        first.append((file, total))
        total += n
    from pyspark.sql import Window

    bases = records.sparkSession.createDataFrame(first, "file int, base long")
    within = Window.partitionBy("file").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases, "file").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def write_index(records: DataFrame, path: str) -> None:
    """The offset index beside the files."""
    records.select("file", "record", "offset", "length", "doc_id").write.parquet(path)


def shuffled_order(spark: SparkSession, index: str, seed: int = 0) -> DataFrame:
    """The index in a reproducible random order: place is the sort key."""
    return spark.read.parquet(index).withColumn("place", F.xxhash64("file", "record", F.lit(seed))).sort("place")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that `wanted` (file, offset, length) names, each cut out of its file by the index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content")
    cut = files.join(wanted.select("file", "offset", "length"), "file").select("file", "offset", F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int")).alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [next(frames(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3].astype("<u4").tobytes() for g in got], pa.binary())], ["file", "offset", "doc_id", "ids"])

    return cut.mapInArrow(run, "file int, offset long, doc_id long, ids binary")
