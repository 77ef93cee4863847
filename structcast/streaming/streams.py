"""Extraction from texts that arrive in chunks.

After each chunk the whole text so far is fitted again, and the result is taken up if its score is at most that of the
last one taken up; otherwise the last one stays, with the new raw text. At the end the whole text is fitted once more,
whatever came before, and checked. Options, checks and rules can be set anew for each stream (changes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.extract import FLAG_TYPE, Extractor, Shaped, column_value
from ..operators.flags import Flag, cost


class TextStream:
    """One stream, fed by its owner."""

    def __init__(self, extractor: Extractor, **changes):
        self.extractor, self.text, self.best, self.closed = extractor.but(**changes), "", None, False

    def feed(self, chunk: str) -> Shaped | None:
        if self.closed:
            raise RuntimeError("the stream is closed")
        self.text += chunk
        got = self.extractor.fit(self.text)
        if got is not None:
            score = cost(got.flags)
            if self.best is None or score <= self.best.score:
                self.best = Shaped(True, got.value, [], score, got.flags, self.text)
        if self.best is not None:
            self.best = self.best._replace(raw=self.text)
        return self.best

    def current(self) -> Shaped | None:
        return self.best

    def close(self) -> Shaped:
        if self.closed:
            raise RuntimeError("the stream is closed already")
        self.closed = True
        return self.extractor.shape(self.text)


def replay(df: DataFrame, extractor: Extractor, key: str | list[str], seq: str, chunk: str, **changes) -> DataFrame:
    """All chunks of finished streams with the result after each: text, partial, and final in each stream's last row.

    A running minimum of scores and the last row that attains it stand for the taking up of results. seq must be unique
    in a stream. A stream's texts are held together by their window only, so a stream must fit a task.
    """
    extractor = extractor.but(**changes)
    keys = [key] if isinstance(key, str) else key
    so_far = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    texts = df.withColumn("text", F.array_join(F.collect_list(F.coalesce(F.col(chunk), F.lit(""))).over(so_far), ""))
    made = texts.withColumn("__r", extractor.column("text", fast=False)).withColumn("__last", F.count(F.lit(1)).over(after) == 0)
    least = made.withColumn("__low", F.min("__r.score").over(so_far))
    best = F.last(F.when(F.col("__r.score") == F.col("__low"), F.struct("__r.data", "__r.score", "__r.flags")), ignorenulls=True).over(so_far)
    return least.withColumn("partial", best).withColumn("final", F.when(F.col("__last"), F.col("__r"))).drop("__r", "__low", "__last")


def live(df: DataFrame, extractor: Extractor, key: str, seq: str, chunk: str, last: str, idle: str | None = None, **changes) -> DataFrame:
    """A streaming frame of chunks to a frame of partial and, at a stream's end, final results.

    Columns key (string), seq (long, from 0), chunk and last (whether it is the stream's last). Chunks that come early
    wait in the state until those before them are there. A stream ends with its last chunk, or after `idle` without any
    (a duration of Spark's), and its state goes.
    """
    extractor = extractor.but(**changes)
    data = extractor.data_type
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("final", T.BooleanType()), T.StructField("ok", T.BooleanType()), T.StructField("data", data), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("score", T.LongType()), T.StructField("flags", FLAG_TYPE), T.StructField("raw", T.StringType())])
    state_type = "next long, text string, waiting string, score long, data string, flags string, ended boolean"
    shape = extractor.target.shape
    millis = None if idle is None else _millis(idle)

    def row(name: str, n: int, final: bool, r: Shaped | None) -> dict:
        if r is None:
            return {"key": name, "seq": n, "final": final, "ok": None, "data": None, "errors": None, "score": None, "flags": None, "raw": None}
        flags = [{"kind": f.kind, "penalty": f.penalty, "path": f.path, "message": f.message} for f in r.flags]
        return {"key": name, "seq": n, "final": final, "ok": r.ok, "data": column_value(r.data, shape), "errors": r.errors, "score": r.score, "flags": flags, "raw": r.raw}

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        name = keys[0]
        at, text, waiting, score, held, marks, ended = state.get if state.exists else (0, "", "{}", None, None, None, False)
        rows = []
        if state.hasTimedOut:
            rows.append(row(name, at - 1, True, extractor.shape(text)))
            state.remove()
        else:
            early = json.loads(waiting)
            for b in batches:
                for n, c, end in zip(b[seq], b[chunk], b[last], strict=True):
                    if n >= at:
                        early[str(n)] = ["" if c is None else c, bool(end)]
            stream = TextStream(extractor)
            stream.text = text
            if held is not None:
                stream.best = Shaped(True, json.loads(held), [], score, [Flag(*f) for f in json.loads(marks)], text)
            while str(at) in early and not ended:
                c, ended = early.pop(str(at))
                rows.append(row(name, at, False, stream.feed(c)))
                at += 1
            if ended:
                rows.append(row(name, at - 1, True, stream.close()))
                state.remove()
            else:
                best = stream.best
                held = (None, None, None) if best is None else (best.score, json.dumps(best.data), json.dumps(best.flags))
                state.update((at, stream.text, json.dumps(early), *held, False))
                if millis:
                    state.setTimeoutDuration(millis)
        if rows:
            yield pd.DataFrame(rows)

    chunks = df.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias(seq), F.col(chunk).alias(chunk), F.col(last).alias(last))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if millis else GroupStateTimeout.NoTimeout
    return chunks.groupBy("key").applyInPandasWithState(step, out, state_type, "append", timeout)


def _millis(duration: str) -> int:
    n, _, unit = duration.partition(" ")
    return int(float(n) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])
