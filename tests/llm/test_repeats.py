import hashlib
import random

import numpy as np
import pytest

from structcast.llm import repeats
from structcast.llm.run_index import RunIndex

SF = "/root/testdata/sf0.001"


def brute(docs, n):
    """For each text the set of bytes that go."""
    seen = {}
    for k, t in enumerate(docs):
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], []).append((k, i))
    gone = [np.zeros(len(t), bool) for t in docs]
    for where in seen.values():
        if len(where) > 1:
            for k, i in where:
                gone[k][i : i + n] = True
    return gone


def digest(t, gone):
    b = np.frombuffer(t, np.uint8)
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
    return len(t), int(gone.sum()), spans, hashlib.sha256(b[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("seed", range(5))
def test_matches_of_the_index(seed):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab") for _ in range(60))
    pieces = [bytes(x if r.random() > 0.05 else r.choice(b"abc") for x in base[r.randint(0, 20) :]) for _ in range(6)] + [b"", b"a" * 40]
    index = RunIndex(pieces)
    got = index.matches()
    every = [(k, i) for k, p in enumerate(pieces) for i in range(len(p))]
    for k, i in every:
        best = 0
        for m, j in every:
            if (m, j) != (k, i):
                x, y = pieces[k][i:], pieces[m][j:]
                c = next((q for q, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
                best = max(best, c)
        assert got[index.starts[k] + i] == best
    assert index.runs < len(got)


def made(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [text(r.choice([399, 400, 401, 450, 700, 1500])) for _ in range(8)]
    docs = []
    for i in range(50):
        t = text(r.randint(0, 900))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            if r.random() < 0.4:
                k = r.randrange(len(s))
                s = s[:k] + "X" + s[k + 1 :]
            elif r.random() < 0.3:
                s = s[r.randint(0, 200) :]
            at = r.randint(0, len(t))
            t = t[:at] + s + t[at:]
        docs.append(t)
    docs += [docs[3], docs[3], shared[1], "a" * 1000, "a" * 399, "a" * 400, "ab" * 300 + "c", "é" * 250, None, "", "x"]
    return docs


@pytest.mark.parametrize("wide", [2048, 1])
def test_equal_to_brute_force(spark, wide):
    docs = made(wide)
    df = spark.createDataFrame([(i if i % 17 else None, t, 1, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_bytes int, kept string")
    raw = [(t or "").encode() for t in docs]
    want = sorted((str(i if i % 17 else None), *digest(t, g)) for i, (t, g) in enumerate(zip(raw, brute(raw, 400))))
    got = sorted((str(r.doc_id), r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends)), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(df, wide=wide, shard_bytes=20000).collect())
    assert got == want
    if wide > 1:
        assert repeats.without_repeats(df.limit(0)).count() == 0


def test_table(spark):
    from structcast.llm.queries import op6_run_index

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    raw = [(r.text or "").encode() for r in rows]
    want = sorted((r.doc_id, *digest(t, g)) for r, t, g in zip(rows, raw, brute(raw, 400)))
    assert sorted(map(tuple, op6_run_index(spark, SF).collect())) == want


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words: from 400 bytes on they go from every text that has them, below that and elsewhere nothing does."""
    from structcast.llm.queries import op6_run_index

    r = random.Random(5)
    words = lambda n, k: " ".join("".join(r.choice("abcdefghijkl") for _ in range(k)) for _ in range(n))
    long, short = words(60, 7), words(55, 6)
    assert len(long) >= 400 > len(short)
    docs = [(i, f"{words(40, 6)} {(long, short, '')[i % 3]} {words(r.randint(1, 300), 6)}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_run_index(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = got.collect()
    assert {x.doc_id for x in rows if x.n_removed} == {i for i in range(60) if i % 3 == 0}
    assert all(x.n_removed >= len(long) and x.n_spans == 1 for x in rows if x.doc_id % 3 == 0)
