import numpy as np
import public_tokenizers
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_copies
from test_ngram_join import gram_set
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def components(docs, n, percent):
    sets = [(d, gram_set(t, n)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and min(len(a), len(b)) * 100 >= max(len(a), len(b)) * percent:
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    x, y = sorted((top(d), top(e)))
                    root[y] = x
    return {d: top(d) for d, _ in sets}


def test_stages(spark, tmp_path):
    assert brute_copies
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        made.append({r.doc_id: r.text for r in docs.collect()})
    good, lines, one, clean, coded = made
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean_labels = [d for d, q in labels.items() if q == 1]
    assert sum(d in good for d in clean_labels) >= 0.97 * len(clean_labels)
    assert sum(d in good for d, q in labels.items() if q == 0) < 0.5 * sum(q == 0 for q in labels.values())
    assert all(texts[d] == t for d, t in good.items())
    want = brute_lines(sorted(good.items()))
    assert lines == {d: t for d, t in want.items() if t == good[d] or t.strip(" ")}
    root = components(sorted(lines.items()), 5, 80)
    assert one == {d: t for d, t in lines.items() if root[d] == d}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, t in one.items() if any(i in t for i in items)}
    assert not dirty & clean.keys() and len(one) - len(clean) <= len(dirty) + 3
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in docs.collect()}
    assert coded == clean and all(ids[d] == lib.encode(t, add_special_tokens=False).ids for d, t in clean.items())


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and out.count() > 0
