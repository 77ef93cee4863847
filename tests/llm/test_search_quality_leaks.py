import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structcast.llm import ball_tree, decontaminate, weak_quality

SF = "/root/testdata/sf0.01"


def brute_top_k(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault((i, tuple(int(np.floor(256 * np.float64(x))) for x in v)), None)
    out = []
    for q, qv in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,block", [(16384, 4096), (60, 3)])
def test_top_k_edges(spark, shard_rows, block):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(400)]
    rows += [(i, [0.5] * 5) for i in range(400, 700)]  # one very common vector
    rows += [(1000, None), (1050, [None, 1.0]), (1100, [float("nan")] * 5), (1150, [float("inf")] * 5), (None, [0.1] * 5), (1200, [1.0]), (1201, [2.0]), (1250, [])]
    rows += rows[:3]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), 5, block, shard_rows)
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, 5)
    assert ball_tree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(0, [8.0e6, 1.0]), (1, [8.0e6, 2.0]), (2, [-8.0e6, 5.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in ball_tree.top_k(df, df.where("vec_id = 0")).collect()}
    assert got[1] == (256 * 8000000) ** 2 + 256 * 512


def test_top_k_table(spark):
    from structcast.llm.queries import op1_ball_tree

    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op1_ball_tree(spark, SF).collect())) == brute_top_k(rows, 5)


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    votes = np.where(r.random((4000, 5)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(r.random(votes.shape) < 0.2, weak_quality.ABSTAIN, np.where(votes, weak_quality.GOOD, weak_quality.BAD))
    patterns, inv, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table = weak_quality.label_model(patterns, counts.astype(float))
    assert ((p[inv.ravel()] > 0.5) == truth).mean() > 0.95
    assert np.abs(table[1, :, weak_quality.GOOD] - right).max() < 0.05


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = weak_quality.score(docs, weak_quality.fit(docs)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.05


def test_quality_edges(spark):
    texts = [None, "", "  \n", "a", "the cat and the dog. " * 30, "!!! " * 50, "x" * 200000]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in enumerate(texts)] + [(None, "the", 0.1, False)], "doc_id long, text string, score double, keep boolean")
    model = weak_quality.fit(docs)
    got = {r.doc_id: r for r in weak_quality.score(docs, model).collect()}
    assert len(got) == 8 and not any(got[i].keep for i in (0, 1, 2)) and all(got[i].score == 0 for i in (0, 1, 2))
    kept = weak_quality.kept(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.keep for r in got.values())
    assert weak_quality.score(docs.limit(0), weak_quality.fit(docs.limit(0))).count() == 0


def brute_local(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(max(r) for r in h)


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(2)
    for _ in range(50):
        item = r.integers(1, 5, r.integers(3, 12)).astype(np.uint64)
        rows = r.integers(1, 5, (4, 20)).astype(np.uint64)
        got, _ = decontaminate.align(item, rows)
        assert got.tolist() == [brute_local(item.tolist(), x.tolist()) for x in rows]


def test_leaks(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(10)] + [(10, None), (11, ""), (12, "two words")]
    docs = []
    for i in range(60):
        body = [r.choice(vocab) for _ in range(r.randint(0, 300))]
        if i % 3 == 0:
            own = items[i % 10][1].upper().split()
            for _ in range(i % 4):  # edited copies
                own[r.randrange(len(own))] = "edited"
            at = r.randint(0, len(body))
            body[at:at] = own
        docs.append((i, " ".join(body), "x", 1.0))
    docs += [(100, None, "x", 0.0), (101, "", "x", 0.0), (None, items[3][1], "x", 0.0), (102, items[3][1] + ". " + items[3][1], "y", 0.0), (102, items[3][1], "y", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    want = {(i, i % 10) for i in range(0, 60, 3)} | {(None, 3), (102, 3)}
    assert {(x.doc_id, x.item_id) for x in got} == want
    split = decontaminate.matches(df, bench, block_items=4).collect()
    assert {(x.doc_id, x.item_id) for x in split} == want
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {d[0] for d in docs} - {w[0] for w in want if w[0] is not None}
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_leaks_of_edited_and_partial_copies(spark):
    r = random.Random(8)
    items = [(i, [f"i{i}x{k}" for k in range(40)]) for i in range(6)]
    docs, want = [], set()
    for i, own in items:
        edited = [f"edit{i}" if k % 4 == 3 else w for k, w in enumerate(own)]
        copies = [own, edited, own[:21], own[19:]]  # verbatim, every fourth word replaced, halves
        for k, copy in enumerate(copies):
            if i % 2 and k == 0:
                continue  # no verbatim copy beside the others
            docs.append((10 * i + k, " ".join([f"f{r.randrange(900)}" for _ in range(50)] + copy + [f"f{r.randrange(900)}" for _ in range(50)])))
            want.add((10 * i + k, i))
        docs.append((10 * i + 9, " ".join(own[:12])))  # under the threshold
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(df, bench).collect()} == want


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.25, 0.3])
def test_recall_of_edited_copies(spark, rate):
    """Against full Smith-Waterman of each copy: items of 30 words, every word edited at the rate, by replacing, dropping or inserting."""
    r = random.Random(int(100 * rate))
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, [r.choice(vocab) for _ in range(30)]) for i in range(150)]
    docs, want = [], set()
    for i, own in items:
        copy = []
        for w in own:
            kind = r.choice("rdi") if r.random() < rate else ""
            copy += {"": [w], "r": [r.choice(vocab)], "d": [], "i": [w, r.choice(vocab)]}[kind]
        docs.append((i, " ".join([r.choice(vocab) for _ in range(40)] + copy + [r.choice(vocab) for _ in range(40)])))
        if brute_local(own, docs[-1][1].split()) >= 0.5 * 2 * len(own):
            want.add((i, i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.matches(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in got}
    assert len(want) > 100 and len(found & want) >= 0.97 * len(want)
    for x in got:
        assert round(x.score * 60) == brute_local(items[x.item_id][1], docs[x.doc_id][1].split())


def test_leaks_of_the_table(spark):
    from structcast.llm.queries import op7_decontaminate

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    planted = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert planted and planted <= {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, SF).collect()}
