import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from structcast.llm import bpe, sharding, token_records

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\x1c\x1d a\x85b c", "<|endoftext|>x <|endoftext|>", "<|startoftext|> Hi", "don't  WON'T\n\n\t x", "é́ ﬁ Σας ΣΑΣ", "!" * 300, "ab" * 5000, "🙂🙂 日本語テキスト", "x <|endof text|>"]


def fuzz(seed, n=300):
    r = random.Random(seed)
    pool = " \t\n\r\x1c\x85  　abcXYZ012'sdtré́ßΣ日🙂.,!<|>-_​᠎"
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(n)]


def frame_of(spark, texts, extra=False):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, shard int")


def test_bpe_equals_library():
    lib = Tokenizer.from_file(BYTE)
    own = bpe.Codec(BYTE)
    texts = [t or "" for t in ODD] + fuzz(1)
    got = own.encode(texts)
    for t, g in zip(texts, got, strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert g.tolist() == want, t
        assert own.decode(g) == lib.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark):
    lib = Tokenizer.from_file(BYTE)
    docs = frame_of(spark, ODD)
    rows = {r.doc_id: r for r in bpe.decode_ids(bpe.encode_texts(docs, BYTE), BYTE).collect()}
    for i, t in enumerate(ODD):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_texts(docs.limit(0), BYTE).count() == 0


def test_word_encoder_equals_library():
    lib = Tokenizer.from_file(WORD)
    own = token_records.Encoder(WORD)
    texts = [t or "" for t in ODD] + fuzz(2)
    for t, g in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert g.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_frames_hold_and_damage_is_found():
    data = token_records.frame(5, np.array([1, 70000], np.uint32)) + b"\n" + token_records.frame(None, np.array([1], np.uint32)) + b"\n"
    got = list(token_records.frames(data))
    assert [(g[2], g[3].tolist()) for g in got] == [(5, [1, 70000]), (None, [1])]
    for k in range(len(data)):
        bad = data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]
        with pytest.raises(ValueError):
            list(token_records.frames(bad))


def test_records_of_a_table(spark, tmp_path):
    from structcast.llm.queries import op4_token_records

    lib = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, start = {}, 0
    for r in sorted(docs):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op4_token_records(spark, SF).collect()}
    assert got == want


def test_index_reads_any_record(spark, tmp_path):
    docs = frame_of(spark, ODD)
    path = f"file://{tmp_path}/r"
    token_records.write_records(docs, path, WORD, file_bytes=2000)
    records = token_records.read_records(spark, path)
    token_records.write_index(records, path + "-index")
    order = token_records.shuffled_order(spark, path + "-index", 3)
    got = {(r.file, r.offset): r.ids for r in token_records.read_at(spark, path, order.limit(5)).collect()}
    all_ = {(r.file, r.offset): r.ids for r in records.collect()}
    assert len(all_) == len(ODD) and len(got) == 5 and all(all_[k] == v for k, v in got.items())
    token_records.write_records(docs.limit(0), path + "-empty", WORD)
    assert token_records.read_records(spark, path + "-empty").count() == 0


def test_bpe_query_against_library(spark):
    from structcast.llm.queries import op8_bpe

    lib = Tokenizer.from_file(BYTE)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op8_bpe(spark, SF).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50, 333])
def test_permutation(spark, n):
    got = sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect())
    assert got == list(range(n))


def test_shards(spark):
    texts = [*ODD, *["same"] * 20]
    rows = [(None if i % 9 == 0 else i // 2, t, "c", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string, row_number int")
    got = sharding.feistel_shards(docs, 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sharding.feistel_shards(docs.limit(0)).count() == 0
    again = sharding.feistel_shards(docs.repartition(3), 8).collect()
    key = lambda x: sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in x)
    assert len(set(key(again)) ^ set(key(got))) <= 2 * sum(1 for t in texts if t == "same")


def placed(number, rows, seed, rounds=6):
    """The permutation again, number by number."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    b = -(-rows // a)

    def chained(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest(v.to_bytes(size, "little"), h)
        return h - (1 << 64) if h >> 63 else h

    while True:
        left, right = divmod(number, b)
        for k in range(rounds):
            if k % 2 == 0:
                left = (left + chained((right, 8), (k, 4), (seed, 4)) % a) % a
            else:
                right = (right + chained((left, 8), (k, 4), (seed, 4)) % b) % b
        number = left * b + right
        if number < rows:
            return number


def test_shards_of_the_table(spark):
    """Every shard and slot of the query reckoned again."""
    from structcast.llm.queries import op9_shards

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in op9_shards(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        place, r = placed(i, len(docs), 7), got[d]
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", place % 8, place // 8, None)


def test_full_table_keeps_ids_right():
    from structcast.llm._pieces import PieceTable, SpanTable

    lib = Tokenizer.from_file(WORD)
    own, other = token_records.Encoder(WORD), bpe.Codec(BYTE)
    own.table, other.table = SpanTable(own._encode, 50), PieceTable(other._encode_pieces, 50)
    byte = Tokenizer.from_file(BYTE)
    r = random.Random(3)
    for k in range(20):
        texts = [" ".join(r.choice(["the", "of", f"w{k}x{r.randint(0, 30)}"]) for _ in range(40)) for _ in range(3)]
        for t, g, h in zip(texts, own.encode([t.encode() for t in texts]), other.encode(texts), strict=True):
            assert g.tolist() == lib.encode(t, add_special_tokens=False).ids and h.tolist() == byte.encode(t, add_special_tokens=False).ids
