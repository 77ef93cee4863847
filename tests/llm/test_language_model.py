import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from structcast.llm import pitman_yor

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_counts(docs, got):
    train = Counter(t for d, x in docs if not held(d) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    want = {}
    for d, x in docs:
        t = tokens(x)
        want[d] = (held(d), len(t), sum(train[w] > 0 for w in t), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t))
    assert len(got) == len(docs)
    for r in got:
        a = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == a[:4]
        assert r.base_score == pytest.approx(a[4], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    return n, v


def test_edges(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for i in range(80)]
    docs += [(1000, None), (1001, ""), (1002, "THE the The"), (1003, "x" * 100000), (None, "w1 w2")]
    df = spark.createDataFrame([(d, t, 1.0, "x") for d, t in docs], "doc_id long, text string, score double, part string")
    check_counts(docs, pitman_yor.scores(df, part_tokens=300).collect())
    assert pitman_yor.scores(df.limit(0)).count() == 0


def test_table_beats_unigrams_on_held_out_texts(spark):
    from structcast.llm.queries import op10_pitman_yor

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op10_pitman_yor(spark, SF).collect()
    check_counts(docs, got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in op10_pitman_yor(spark, SF).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in got)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    s = pitman_yor.Setting()
    words, contexts = 30, 6
    counts = rng.integers(0, 5, (contexts, words)) * (rng.random((contexts, words)) < 0.5)
    counts[0, 0] = 400
    u, w = np.nonzero(counts)
    order = np.lexsort((u, w))
    seating = pitman_yor.Seating(w[order], u[order].astype(np.int64), counts[u, w][order], words)
    customers = counts.sum(1)
    seating.sample(s, customers.astype(float), 1.0, words, rng)
    totals = seating.totals(contexts)
    type_ = np.full(counts.shape, -1)
    type_[seating.context, seating.word] = np.arange(len(order))
    for c in range(contexts):
        p = 10 ** seating.log10(s, customers, totals, words, np.append(np.arange(words), -1), np.full(words + 1, c), np.append(type_[c], -1))
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_seating_follows_the_restaurant_process():
    """Mean number of tables against the recurrence of the expected count in a restaurant of one dish."""
    rng = np.random.default_rng(3)
    for n, pull in ((10, 0.5), (60, 3.0)):
        p = {1: 1.0}
        for seated in range(1, n):
            after = Counter()
            for t, q in p.items():
                new = pull / (pull + seated - 0.5 * t)
                after[t + 1] += q * new
                after[t] += q * (1 - new)
            p = after
        drawn = pitman_yor.draw_tables(np.full(20000, n), np.full(20000, pull), 0.5, rng)
        assert drawn.mean() == pytest.approx(sum(t * q for t, q in p.items()), rel=0.02)


def test_every_context_counts(spark):
    """Words too rare for the frequent ones decide what follows them, and a pair of words decides more than the nearer one."""
    r = random.Random(6)
    follows = {f"c{i}": f"n{i}" for i in range(1500)}  # each holds less than a 1024th of all tokens
    chain = [" ".join(f"{c} {follows[c]}" for c in r.choices(list(follows), k=20)) for _ in range(1200)]
    pairs = [" ".join(r.choice(("a x p", "b x q")) for _ in range(20)) for _ in range(300)]
    docs = list(enumerate(chain + pairs))
    got = pitman_yor.scores(spark.createDataFrame(docs, "doc_id long, text string"), part_tokens=20_000).collect()
    check_counts(docs, got)
    out = [x for x in got if x.held_out and x.doc_id < 1200]
    # The 20 words after a rare context cost little; the contexts themselves are drawn from 1500.
    assert sum(x.score for x in out) / sum(x.n_tokens for x in out) > -0.5 * math.log10(1500) - 0.4
    out = [x for x in got if x.held_out and x.doc_id >= 1200]
    assert sum(x.score for x in out) / sum(x.n_tokens for x in out) > -0.25
