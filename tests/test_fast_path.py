"""The Catalyst path gives what the kernel gives, text by text."""

import json

import pytest
from pyspark.sql import functions as F

from structcast import Extractor, Options
from structcast.operators.extract import _catalyst

ITEM = {"type": "object", "properties": {"id": {"type": "integer"}, "qty": {"type": "number"}}, "required": ["id", "qty"]}
NESTED = {"type": "object", "properties": {"order": {"type": "integer"}, "items": {"type": "array", "items": ITEM}, "by": ITEM, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["order", "items", "by", "tags"]}
GOOD = {"order": 1, "items": [{"id": 1, "qty": 2.5}, {"id": 2, "qty": 3}], "by": {"id": 7, "qty": 1e3}, "tags": ["a", "b"]}


def but(**changes):
    return json.dumps({**GOOD, **changes})


PLAIN = json.dumps(GOOD)
EASY = [PLAIN, f"```json\n{PLAIN}\n```", f"Here:\n  ```\n\n{PLAIN}\n\n  ``` and so on", f"5\n```json\n{PLAIN}\n```", f"```x y\n{PLAIN}\n```\n" + '{"order": 3}', but(items=[], tags=[]), but(tags=["`", "~"])]
HARD = [
    None, "", "```", "```\n```", f"```json\n{PLAIN}", f"```\n{PLAIN}\n```\n```\n{PLAIN}\n```", f"~~~\n{PLAIN}\n~~~", f"````\n{PLAIN}\n````", f"a ```\n{PLAIN}\n```", f"```\n{PLAIN} x\n```", f"```\n[{PLAIN}]\n```",
    but(items=[{"id": 1}, {"id": 2, "qty": 3}]), but(items=[{"id": 1, "qty": None}]), but(items=[None]), but(items=None), but(items=[{"id": 1, "qty": 2, "more": 3}]), but(items={"id": 1, "qty": 2}),
    but(items=[{"id": 2**53 + 2, "qty": 1}]), but(items=[{"id": 10**25, "qty": 1}]), but(items=[{"id": 1.5, "qty": 1}]), but(tags=["a", None]), but(tags=[1, "a"]), but(tags=[[]]), but(by=None), but(by=[]), but(by={"id": "7", "qty": 1}), but(Order=2),
    PLAIN[:-9], PLAIN + ",1", PLAIN.replace('"order"', '"order": 1, "order"'), f"```json\n{PLAIN}\n```\n`code`", f"x\n```\n{PLAIN}\n``` ~",
]


@pytest.mark.parametrize("options", [Options(), Options(fences=False)])
def test_equal_to_the_kernel(spark, options):
    own = Extractor(NESTED, options=options)
    texts = spark.createDataFrame(list(enumerate(EASY + HARD)), "i int, t string")
    easy, _ = _catalyst(own, F.col("t"))
    rows = texts.select("i", "t", own.column("t").alias("fast"), own.column("t", fast=False).alias("slow"), easy.alias("easy")).collect()
    assert {r.i for r in rows if r.fast != r.slow} == set()
    taken = {r.i for r in rows if r.easy}
    assert taken == (set(range(len(EASY))) if options.fences else {0, 5, 6})


def test_shapes_that_are_left_to_the_kernel():
    text = F.lit("")
    flat = lambda *names, required=True: Extractor({"type": "object", "properties": {n: {"type": "string"} for n in names}, "required": list(names) if required else []})
    assert _catalyst(flat("a", "b"), text) is not None
    assert _catalyst(flat("a_b", "AB"), text) is None  # keys that mean the same
    assert _catalyst(flat("a", required=False), text) is None and _catalyst(flat("a-b"), text) is None
    assert _catalyst(Extractor({"type": "array", "items": {"type": "string"}}), text) is None
