import json

import pytest

from structcast import Extractor
from structcast.streaming.streams import TextStream, live, replay

SCHEMA = {"type": "object", "properties": {"dish": {"type": "string"}, "steps": {"type": "array", "items": {"type": "string"}, "minItems": 2}}, "required": ["dish", "steps"]}
TEXT = 'Sure: {"dish": "Soup", "steps": ["Boil", "Serve it hot"]} Enjoy!'


def chunks(text, n):
    return [text[i : i + n] for i in range(0, len(text), n)]


@pytest.mark.parametrize("n", [1, 3, 5, 1000])
def test_end_of_stream_is_the_whole_text(n):
    own = Extractor(SCHEMA)
    s = TextStream(own)
    scores = [r.score for r in map(s.feed, chunks(TEXT, n)) if r is not None]
    assert scores == sorted(scores, reverse=True)
    assert s.close() == own.shape(TEXT)
    with pytest.raises(RuntimeError):
        s.feed("x")
    with pytest.raises(RuntimeError):
        s.close()


def test_empty_stream():
    s = TextStream(Extractor({"type": "string"}))
    assert s.current() is None and s.close().data == ""


def test_a_worse_score_keeps_the_value_but_not_the_text():
    s = TextStream(Extractor({"type": "integer"}))
    s.feed("12")
    r = s.feed(" apples")
    assert r.data == 12 and r.raw == "12 apples" and not s.close().ok


def test_replay_equals_feeding(spark):
    own = Extractor(SCHEMA)
    rows = [(k, i, c) for k, n in (("a", 4), ("b", 7)) for i, c in enumerate(chunks(TEXT, n))]
    got = replay(spark.createDataFrame(rows, "key string, seq int, chunk string"), own, "key", "seq", "chunk").orderBy("key", "seq").collect()
    streams = {}
    for r in got:
        s = streams.setdefault(r.key, TextStream(own))
        want = s.feed(r.chunk)
        assert (r.partial is None) == (want is None)
        if want is not None:
            assert r.partial.score == want.score and (r.partial.data.dish, r.partial.data.steps) == (want.data["dish"], want.data["steps"])
    finals = [r.final for r in got if r.final is not None]
    assert len(finals) == 2 and all(f.ok and f.data.steps == ["Boil", "Serve it hot"] for f in finals)


def test_live(spark, tmp_path):
    own = Extractor(SCHEMA)
    (tmp_path / "in").mkdir()
    parts = chunks(TEXT, 9)
    rows = [{"key": k, "seq": i, "chunk": c, "last": i == len(parts) - 1} for k in "ab" for i, c in enumerate(parts)]
    late = [r for r in rows if r["seq"] % 2]
    for n, some in enumerate((late, [r for r in rows if r not in late])):  # odd chunks come first
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, some)))
    df = spark.readStream.schema("key string, seq long, chunk string, last boolean").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    q = live(df, own, "key", "seq", "chunk", "last").writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("live_out").collect()
    finals = [r for r in got if r.final]
    assert sorted(r.key for r in finals) == ["a", "b"] and all(r.ok and r.data.steps == ["Boil", "Serve it hot"] and r.raw == TEXT for r in finals)
    s = TextStream(own)
    want = [s.feed(c) for c in parts]
    have = sorted((r.seq, r.score) for r in got if r.key == "a" and not r.final)
    assert have == [(i, None if w is None else w.score) for i, w in enumerate(want)]
    told = sorted((r.seq, None if r.flags is None else [(f.kind, f.message) for f in r.flags]) for r in got if r.key == "a" and not r.final)
    assert told == [(i, None if w is None else [(f.kind, f.message) for f in w.flags]) for i, w in enumerate(want)] and all(r.flags is not None for r in finals)


def test_a_stream_has_its_own_options():
    own = Extractor({"type": "integer", "minimum": 5})
    assert not own.shape("3").ok and own.but() is own
    s = TextStream(own, checks=False)
    s.feed("3")
    assert s.close().ok and own.checks
    kept = TextStream(own, rules=(lambda v: "odd" if v % 2 else None,))
    kept.feed("7")
    assert kept.close().errors == ["odd"]
