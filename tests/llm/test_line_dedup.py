import random

import pytest

from structcast.llm import line_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, percent=80):
    """Texts without the lines that match an earlier one; docs in order."""
    seen, out, index = [], {}, {}
    for d, t in docs:
        kept = []
        for line in t.split("\n"):
            s = frozenset(line.encode().lower().split())
            near = {k for w in s for k in index.get(w, ())}
            hit = any(100 * len(s & seen[k]) >= percent * len(s | seen[k]) for k in near)
            if not hit:
                kept.append(line)
            if s and s not in seen[-1:]:
                for w in s:
                    index.setdefault(w, []).append(len(seen))
                seen.append(s)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    pool = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 10, 20, 60]))] for _ in range(60)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = list(r.choice(pool))
            for _ in range(r.randint(0, 2 if len(x) < 20 else 8)):
                x[r.randrange(len(x))] = r.choice(vocab)
            lines.append((r.choice([" ", "  ", "\t"])).join(x) if r.random() > 0.1 else "")
        docs.append((i, "\n".join(lines)))
    extra = [(500, None), (501, ""), (502, " \n\n "), (503, "q" * 50000 + "\n" + "Q" * 50000)]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs + extra] + [(None, docs[5][1], 1, "x", 2)], "doc_id long, text string, line int, tie string, n int")
    got = line_dedup.deduplicated(df)
    assert got.columns == [*df.columns, "n_lines_gone"]
    rows = got.collect()
    want = brute(docs + [(d, t) for d, t in extra if t is not None])
    assert {r.doc_id: r.text for r in rows if r.doc_id not in (None, 500)} == want
    assert [r.text for r in rows if r.doc_id is None] == [docs[5][1]] and [r.text for r in rows if r.doc_id == 500] == [None]
    if not seed:
        twice = df.where("doc_id < 20").unionByName(df.where("doc_id < 20"))
        assert line_dedup.deduplicated(twice).where("n_lines_gone > 0").count() % 2 == 0
        assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_groups_of_near_copies(spark):
    """More matches than are verified at first, and many that are just too far."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(40)]
    docs = []
    for i in range(90):
        x = list(base)
        for k in range(r.randint(1, 5)):
            x[r.randrange(40)] = f"x{i}_{k}"
        docs.append((i, " ".join(x)))
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_table(spark):
    from structcast.llm.queries import op2_line_dedup

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = brute(docs)
    assert {r.doc_id: r.text for r in op2_line_dedup(spark, SF).collect()} == want


def test_letters(spark):
    """Of all letters only A-Z change, and other white space becomes spaces, whichever way a line takes."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    all_ = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    low = [chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\r\x0b\x0c" else c for c in all_]
    df = spark.createDataFrame(pa.table({"line": [f"A{c}É"[: 2 + k % 2] for k, c in enumerate(all_)], "want": [f"a{c}É"[: 2 + k % 2] for k, c in enumerate(low)]}))
    assert df.where(line_dedup._lowered(F.col("line")) != F.col("want")).count() == 0


def test_hubs_take_short_prefixes(spark):
    """A pair has its first common token among the smaller set's first n - ceil(8/9 n) + 1; the pass by hubs reads no more of any set."""
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([(k, k, 18, 0, 0, [10, 11, 12, 13 + k]) for k in range(3)], "sid long, doc_id long, n int, bits long, more long, prefix array<long>")
    got = line_dedup._with_hubs(sets, 80)
    assert sorted(map(tuple, got.collect())) == [(0, 1)] * 3 + [(0, 2)] * 3
    late = sets.withColumn("prefix", F.array(*[F.lit(100) + 10 * F.col("sid") + i for i in range(3)], F.lit(7).cast("long")))
    assert line_dedup._with_hubs(late, 80).count() == 0
    assert sorted({tuple(r) for r in line_dedup._sharing(late.withColumn("open", F.lit(True)), 80).collect()}) == []
