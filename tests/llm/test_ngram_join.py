import random
import re

import numpy as np
import pytest

from structcast.llm import ngram_join

SF = "/root/testdata/sf0.001"


def gram_set(text, n=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, percent=85):
    sets = [(d, gram_set(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            small, large = sorted((len(a), len(b)))
            if small and small * 100 >= large * percent:
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    x, y = sorted((top(d), top(e)))
                    root[y] = x
    return sorted((d, len(s), top(d)) for d, s in sets)


def edited(r, words, rate):
    return [r.choice(words) if r.random() < rate else w for w in words]


def made(seed, groups=25):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    docs = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 9, 20, 60, 200, 700]))]
        for _ in range(r.randint(1, 8)):
            docs.append(" ".join(edited(r, base, r.choice([0, 0.002, 0.01, 0.02, 0.03]))))
            if r.random() < 0.3:
                base = edited(r, base, 0.01)
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_meet_for_every_link(seed):
    docs = made(seed, 60)
    bands = ngram_join.Bands(85)
    entries = []
    for _, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        grams = next(ngram_join.gram_sets(data, np.array([0, len(data)]), 4))
        entries.append((gram_set(t), {int(k): bool(o & 1) for k, o in zip(*ngram_join._entries(grams, ngram_join.set_id(grams), bands), strict=True)}))
    links = 0
    for i, (a, x) in enumerate(entries):
        for b, y in entries[:i]:
            k = len(a & b)
            if 100 * k >= 85 * (len(a) + len(b) - k):
                links += 1
                assert any(x[c] or y[c] for c in x.keys() & y.keys())
    assert links > 50


@pytest.mark.parametrize("hot", [1 << 17, 1])
def test_components_equal_brute_force(spark, hot, monkeypatch):
    if hot == 1:
        monkeypatch.setattr(ngram_join, "SAMPLE", 1)
    docs = made(9, 60) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "a b c"), (9006, "x" * 100000)]
    df = spark.createDataFrame([(d, t, "s", d) for d, t in docs] + [(None, docs[0][1], "s", 0)], "doc_id long, text string, sid string, component_id long")
    got = ngram_join.near_duplicates(df, hot=hot).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(docs)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    if hot > 1:
        left = ngram_join.one_of_each(df)
        assert left.columns == df.columns
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [d for d, _, c in brute(docs) if c == d]
        assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_chain_whose_links_avoid_the_hub(spark):
    """Neighbours in a chain link, its ends don't; every member shares blocks with many others."""
    base = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(30):
        docs.append((100 - i, " ".join(f"c{k}" if k < 3 * i else w for k, w in enumerate(base))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == brute(docs)


def test_table(spark):
    from structcast.llm.queries import op3_ngram_join

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_ngram_join(spark, SF).collect())
    assert got == brute(docs)
