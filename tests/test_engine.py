"""Rules of the engine, text by text."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structcast import Extractor, Options, ShapedError, Style, compile_schema, prompt, readings
from structcast.functions.jsnum import leading_number, number_text, round_half_up, to_number, units
from structcast.functions.readings import Fenced, Mended, Pairs, balanced, fences, outside_fences, repaired, strict
from structcast.operators.checks import has_format, violations
from structcast.operators.fitting import Fit, better
from structcast.operators.flags import PENALTIES, Flag, cost
from structcast.plans.shapes import FLOAT, INT, NULL, STRING, Again, Choice, Const, Field, ListOf, MapOf, Member, OneOf, Record, Target, maybe, spark_type, without_null

PERSON = {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}}, "required": ["name", "age"]}


def run(schema, text, **options):
    r = Extractor(schema, **options).shape(text)
    return r.data, r.score


def kinds(schema, text):
    return [f.kind for f in Extractor(schema).shape(text).flags]


@pytest.mark.parametrize("text,want", [("0x1F", 31), ("0b11", 3), ("0o17", 15), (".5", 0.5), ("5.", 5), ("+5", 5), ("1e3", 1000), ("", 0), ("Infinity", math.inf), ("-Infinity", -math.inf), ("1d", None), ("1_000", None), ("-0x1", None), (" 7﻿", 7), ("1e400", math.inf)])
def test_numbers(text, want):
    assert to_number(text) == want


@pytest.mark.parametrize("x,want", [(5.0, "5"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (-0.0, "0"), (0.1, "0.1"), (123.456, "123.456"), (1.25e30, "1.25e+30"), (math.nan, "NaN"), (-math.inf, "-Infinity")])
def test_number_text(x, want):
    assert number_text(x) == want


def test_rounding_and_prefixes():
    assert [round_half_up(x) for x in (-2.5, 2.5, -2.3, 0.49999999999999994, 0.5)] == [-2, 3, -2, 0, 1]
    assert leading_number("42abc") == 42 and leading_number(" 3.5e2x") == 350 and leading_number("x") is None
    assert units("a🙂") == 3


def test_strict_json():
    assert strict('{"b":1,"10":2,"2":3,"b":4}').items == [("2", 3.0), ("10", 2.0), ("b", 4.0)]
    for bad in ("", "NaN", "{'a':1}", "1 2", "[1,]", "Infinity", '{"a":1} x', "01"):
        assert not isinstance(strict(bad), (float, Pairs, list))


def test_fences():
    assert fences("x\n```json extra\n{}\n```\ny\n~~~\na\n~~~") == [("json", "{}"), ("", "a")]
    assert fences("```\nopen") == [("", "open")] and fences("a ``` b") == []
    assert outside_fences("a\n```\nb\n```\nc") == "a\n\nc"
    assert fences("```\n```") == [("", "```")]


def test_balanced():
    assert balanced('a {"x": "}"} b [1,[2]] {c') == ['{"x": "}"}', "[1,[2]]"]
    assert balanced("{ [1]") == ["[1]"] and balanced("{'}") == []
    assert balanced("{" * 200_000) == []


def test_repair():
    pairs = lambda t: repaired(t).items
    assert pairs("{a: 1, 'b': \"x\", c: `y`,}") == [("a", 1.0), ("b", "x"), ("c", "y")]
    assert pairs('{"a":, "b":1}') == [("a", 'b":1}')]
    assert pairs('{"a":, b: 1}') == [("a", "b: 1")]
    assert pairs("{a: 1 // c\n, b: 2}") == [("a", "1 // c"), ("b", 2.0)]
    assert pairs('{"a": "he said "hi" to me", "b": [1, 2') == [("a", 'he said "hi" to me'), ("b", [1.0, 2.0])]
    assert pairs('{/* c */ a: """raw "q" \n""", b: true, c: null}') == [("a", 'raw "q" \n'), ("b", True), ("c", None)]
    assert pairs('{"a": "x\\n\\u0041\\q\\uD83D\\uDE00"}') == [("a", "x\nA\\q😀")]
    assert pairs('{1: 2, [3]: 4}') == [("1", 2.0), ("", 4.0)]
    assert repaired("[a, b c, 3]") == ["a", "b c", 3.0]
    assert repaired("{a: 1} and {b: 2}") == [Pairs([("a", 1.0)]), Pairs([("b", 2.0)])]
    assert repaired("some prose  ") == "some prose" and repaired("0x1F") == 31
    assert repaired("```json\n{}\n``` x") == ["{}\n", "x"]
    assert not isinstance(repaired("// only a comment"), str) and not isinstance(repaired(" "), (str, list))
    assert repaired('"a" b') == 'a" b'


def test_cascade():
    assert readings("1").values == [1.0]
    r = readings('x {"a": 1} y {"b": 2}')
    assert r.values[0] == Mended(Pairs([("a", 1.0)]), ("grepped-for-json",)) and isinstance(r.values[2], list)
    r = readings("```json\n{}\n```\n```\n[1\n```\n")
    assert r.values[0] == Fenced("json", Pairs([])) and r.values[1] == Fenced("", Mended([1.0])) and isinstance(r.values[2], list)
    assert readings("```\n{}\n```", Options(fences=False, embedded=False, repair=False)) == "```\n{}\n```"


@pytest.mark.parametrize(
    "kind,text,data,score",
    [
        ("integer", "999999999999", 999999999999, 0), ("number", "$1,234.56", 1234.56, 1), ("number", "1.234,56", 1234.56, 1), ("number", "50%", 50, 1), ("number", "€100", 100, 1),
        ("number", '"1_000"', 1000, 1), ("number", '"1,234"', 1234, 1), ("number", '"1,234,56"', None, None), ("number", '"1.234.567"', None, None), ("number", '"1.234,567"', 1.234567, 1), ("number", "-$5", -5, 1),
        ("integer", "3/4", 1, 2), ("number", "3/0", None, None), ("boolean", "yes", True, 1), ("boolean", "true", True, 1), ("boolean", "maybe", None, None), ("null", "null", None, 1),
        ("string", '"hello"', "hello", 0), ("string", "", "", 0), ("string", "  two words ", "two words", 0), ("integer", "true", 1, 2), ("integer", "null", None, None), ("integer", "1e400", None, None),
    ],
)
def test_scalars(kind, text, data, score):
    assert run({"type": kind}, text) == (data, score)


def test_records():
    assert run(PERSON, '{"name": "Alice", "age": "30"}') == ({"name": "Alice", "age": 30}, 1)
    assert run(PERSON, '{"Na-me": "A", "AGE": 1, "x": 2}') == ({"name": "A", "age": 1}, 1)
    assert run(PERSON, '{"name": "A"}') == ({"name": "A", "age": None}, 100)
    assert run(PERSON, "nothing") == (None, None)
    assert kinds(PERSON, "```\n{name: D, age: 4}\n```") == ["object-from-fixed-json", "object-from-markdown"]
    one = {"type": "object", "properties": {"xs": {"type": "array", "items": {"type": "integer"}}}, "required": ["xs"]}
    assert run(one, "[1, 2]") == ({"xs": [1, 2]}, 2) and run(one, "5") == ({"xs": [5]}, 3)
    text = {"type": "object", "properties": {"t": {"type": "string"}}, "required": ["t"]}
    assert run(text, '{"a": 1}') == ({"t": '{"a": 1}'}, 2)
    optional = {"type": "object", "properties": {"s": {"type": "string"}, "i": {"type": "integer"}}}
    assert run(optional, '{"s": null, "i": null}') == ({"s": "null", "i": None}, 3)


def test_lists_and_maps():
    ints = {"type": "array", "items": {"type": "integer"}}
    assert run(ints, '[1, "x", "2", {}]') == ([1, 2], 2 + 1 + 4)
    assert run(ints, "null") == ([], 1) and run(ints, "7") == ([7], 1)
    people = {"type": "array", "items": PERSON}
    assert run(people, 'A {"name": "a", "age": 1} B {"name": "b", "age": 2}')[0] == [{"name": "a", "age": 1}]
    counts = {"type": "object", "additionalProperties": {"type": "integer"}}
    assert run(counts, '{"a": 1, "b": "x"}') == ({"a": 1}, 2) and run(counts, "5") == (None, None)


def test_unions():
    either = {"anyOf": [{"type": "integer"}, {"type": "string"}]}
    assert kinds(either, '"5"') == ["union-match"] and run(either, '"5"') == ("5", 0)
    strict_wins = {"anyOf": [{"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a"]}, {"type": "string"}]}
    assert run(strict_wins, '{"a": 1}') == ({"a": 1, "b": None}, 1)
    mixed = {"type": "array", "items": {"anyOf": [{"type": "number"}, {"type": "integer"}]}}
    r = Extractor(mixed).shape("[1.5, 2]")
    assert [f.index for f in r.flags] == [0, 0]
    assert run({"enum": ["a", 1, None]}, "1") == (1, 0)


def test_enums():
    color = {"type": "string", "enum": ["RED", "GREEN", "Été", "DARK RED"]}
    assert run(color, "RED") == ("RED", 0) and run(color, '"RED"') == ("RED", 3) and run(color, "green") == ("GREEN", 3) and run(color, "Ete") == ("Été", 3)
    assert run(color, "it is dark red!") == ("DARK RED", 2) and run(color, "red or green") == (None, None) and run(color, "red, red or green") == ("RED", 2)
    feeling = Target(Choice("S", (Member("POS", description="Good feeling"), Member("NEG", alias="bad", description="Bad feeling"))))
    assert run(feeling, "Good feeling") == ("POS", 0) and run(feeling, "bad: Bad feeling") == ("NEG", 0) and run(feeling, "bad") == ("NEG", 0) and run(feeling, "NEG") == (None, None)


def test_constants():
    assert run({"const": "hello"}, "hello") == ("hello", 0) and run({"const": 42}, '"42abc"') == (42, 1) and run({"const": True}, "TRUE") == (True, 1)
    assert run({"const": "5"}, "[5]") == (None, None) and run({"const": None}, "null")[0] is None


def test_ranking():
    default = Fit({"a": None}, [Flag("default-from-no-value")])
    guess = Fit({"a": "x"}, [Flag("implied-key", "a"), Flag("json-to-string")])
    assert better([default, guess]) is guess and better([guess, Fit(1, [Flag("float-to-int")] * 9)]).value == 1
    assert better([Fit(1, [Flag("extra-key")]), Fit(2, [Flag("extra-key")])]).value == 1 and better([]) is None
    assert cost([Flag("array-item-parse-error", "3", 3), Flag("default-from-no-value")]) == 104
    assert len(PENALTIES) == 28


def test_recursion_ends():
    tree = {"$defs": {"N": {"type": "object", "properties": {"next": {"$ref": "#/$defs/N"}}, "required": ["next"]}}, "$ref": "#/$defs/N"}
    assert run(tree, "bare text") == (None, None)
    for form in ({"$ref": "#/$defs/N"}, {"type": "array", "items": {"$ref": "#/$defs/N"}}):  # bare values, around which records and lists could be put for ever
        tree["$defs"]["N"]["properties"]["next"] = form
        assert run(tree, "7")[0] in (None, {"next": []})
    deep = "[" * 5000
    assert Extractor({"type": "array", "items": {"type": "string"}}).shape(deep) is not None


def test_deep_values_are_kept():
    schema, want = {"type": "integer"}, 5.0
    for _ in range(70):
        schema, want = {"type": "array", "items": schema}, [want]
    assert run(schema, "[" * 70 + "5" + "]" * 70) == (want, 0)
    assert run(schema, "5")[0] == want  # a bare value in as many lists as are asked for
    node = {"$defs": {"N": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"anyOf": [{"$ref": "#/$defs/N"}, {"type": "null"}]}}, "required": ["v"]}}, "$ref": "#/$defs/N"}
    text = '{"v": 0, "next": null}'
    for i in range(1, 100):
        text = f'{{"v": {i}, "next": {text}}}'
    r = Extractor(node).shape(text)
    depth, at = 0, r.data
    while at is not None:
        depth, at = depth + 1, at["next"]
    assert r.ok and r.score == 0 and depth == 100
    far = Extractor({"type": "array", "items": {"type": "string"}}).shape("[" * 3000 + "]" * 3000)
    assert not far.ok or far.data is not None  # never ok with the value gone


def test_compiler(spark):
    t = compile_schema({"$defs": {"A": {"type": "object", "properties": {"b": {"$ref": "#/definitions/B"}, "a": {"$ref": "#/$defs/A"}}}, "B": {"type": "integer"}}, "$ref": "#/$defs/A"})
    assert t.shape == Record("A", (Field("b", INT, True), Field("a", Again("A"), True)))
    shape = lambda s: compile_schema(s).shape
    assert shape({}) == STRING and shape({"type": ["string", "null"]}) == OneOf((STRING, NULL)) and shape({"type": ["integer"]}) == INT
    assert shape({"enum": ["a", 1, None]}) == OneOf((Const("a"), Const(1.0), NULL)) and shape({"const": [1, 2]}) == Const("1,2")
    assert shape({"type": "object"}) == MapOf(STRING, STRING) and shape({"items": {"type": "number"}}) == ListOf(FLOAT)
    assert shape({"type": "array", "items": [{"type": "integer"}]}) == ListOf(STRING) and shape({"$ref": "http://x"}) == STRING and shape({"$ref": "#/$defs/none"}) == STRING
    assert shape({"anyOf": [{"type": "string"}]}) == STRING and maybe(maybe(STRING)) == OneOf((STRING, NULL)) and without_null(OneOf((STRING, NULL))) == STRING
    nested = shape({"type": "array", "items": {"type": "object", "properties": {"x": {"type": "object", "properties": {}}}}})
    assert nested.item.name == "Anon1" and nested.item.fields[0].shape.name == "Anon1_x"
    assert spark_type(OneOf((INT, STRING))) == T.StringType() and spark_type(OneOf((INT, NULL))) == T.LongType()
    assert shape("a int, b string") == compile_schema(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])).shape


def test_prompts():
    assert prompt({"type": "integer"}) == "Answer as an integer.\nint"
    assert prompt({"enum": ["A", "B"], "type": "string"}) == "A or B"
    assert prompt({"const": "x"}) == 'Answer with the value: "x"\n"x"'
    assert prompt({"type": "array", "items": {"anyOf": [{"type": "integer"}, {"type": "null"}]}}) == "Answer with a JSON Array using this schema:\nint | null[]"
    person = {"type": "object", "properties": {"n": {"type": "string", "description": "the name"}, "m": {"type": "object", "additionalProperties": {"type": "number"}}}, "required": ["n"]}
    assert prompt(person) == "Answer in JSON using this schema:\n{\n  n: string, // the name\n  m: map<string, float> | null,\n}"
    assert prompt(person, Style(opening=None, quote_fields=True, map_style="object")) == '{\n  "n": string, // the name\n  "m": {[key: string]: float} | null,\n}'
    many = {"type": "string", "enum": list("abcdefg")}
    assert prompt(many) == "Root\n----\n" + "\n".join(f"- {c}" for c in "abcdefg") + "\n\nRoot"
    tree = {"$defs": {"N": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"$ref": "#/$defs/N"}}, "required": ["v"]}}, "$ref": "#/$defs/N"}
    assert prompt(tree) == "N {\n  v: int,\n  next: N | null,\n}\n\nAnswer in JSON using this schema:\nN"


def test_formats():
    good = {"email": "a@b.co", "date": "2024-02-29", "date-time": "2024-01-01T10:00:00Z", "time": "23:59:59+02:00", "uri": "mailto:x", "uuid": "123E4567-e89b-12d3-a456-426614174000", "ipv4": "255.1.0.9", "ipv6": "::1", "other": "?"}
    bad = {"email": "a..b@c.d", "date": "2023-02-29", "date-time": "2024-02-30T10:00:00Z", "time": "12:00:59.5", "uri": "no scheme", "uuid": "123", "ipv4": "256.1.1.1", "ipv6": "1.2"}
    assert all(has_format(v, k) for k, v in good.items()) and not any(has_format(v, k) for k, v in bad.items())
    assert not has_format("0050-01-01", "date") and not has_format("12:00:00abc", "time") and not has_format(".a@b.c", "email") and has_format("12:00:00", "time")


def test_violations():
    said = lambda v, s: [x.text for x in violations(v, s)]
    assert said({"a": {"b": [5.0]}}, {"properties": {"a": {"properties": {"b": {"items": {"maximum": 3}}}}}}) == ["a.b[0]: Value 5 is greater than maximum 3"]
    assert said(0.3, {"multipleOf": 0.1}) and said("🙂", {"maxLength": 1}) and not said("x", {"pattern": "("}) and said("a\n", {"pattern": "a$"})
    assert not said(None, {"minimum": 1}) and not said(5.0, {"$ref": "#/x", "maximum": 1}) and not said(True, {"maximum": 0})
    assert said(5.0, {"anyOf": [{"maximum": 3}, {"maximum": 4}]}) == ["Value 5 is greater than maximum 3"] and not said(5.0, {"oneOf": [{"maximum": 3}, {"type": "string"}]})
    assert said({"x": 1.0}, {"minProperties": 2, "additionalProperties": {"minimum": 2}}) == ["Object has 1 properties, minimum is 2", "x: Value 1 is less than minimum 2"]
    assert said([], {"minItems": 1}) == ["Array length 0 is less than minimum 1"]


def test_results():
    e = Extractor({**PERSON, "properties": {**PERSON["properties"], "age": {"type": "integer", "minimum": 0}}}, rules=[lambda v: "no Bobs" if v["name"] == "Bob" else None])
    r = e.shape('{"name": "Bob", "age": -1}')
    assert not r.ok and r.errors == ["age: Value -1 is less than minimum 0", "no Bobs"] and r.score == 0
    with pytest.raises(ShapedError, match="age: Value -1 is less than minimum 0; no Bobs"):
        e.require('{"name": "Bob", "age": -1}')
    assert e.feedback(e.shape('{"name": "A", "age": 1}')) is None and e.feedback(r).startswith("Error: age: Value -1")
    assert Extractor(PERSON, checks=False).require('{"name": "A", "age": -1}') == {"name": "A", "age": -1}


TEXTS = ['{"name": "A", "age": 3}', '{"age": 3, "name": "A"}', '{"name": "A", "age": 3.0}', '{"name": "A", "age": 3} x', '{"name": "A"}', '{"name": "A", "age": "3"}', None, "", "x", '{"name": "A", "age": 9007199254740993}', '{"name": null, "age": 1}', '{"name":"a","name":"b","age":1}', "[1]", '{"name": "A", "age": 1e400}', '1,"structcast-guard-7f3a"]', '{"name": "é🙂", "age": -7}', "x" * 100_000, '{"a": ' * 3000]


def test_both_paths_agree(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id int, text string, ok string")
    e = Extractor(PERSON)
    got = df.select("id", e.column("text").alias("fast"), e.column("text", fast=False).alias("slow")).collect()
    for r in got:
        assert r.fast == r.slow, TEXTS[r.id]
        assert (r.fast is None) == (TEXTS[r.id] is None)


def test_columns(spark):
    df = spark.createDataFrame([('{"name": "A", "age": "3"}',), ("x",), (None,)], "text string")
    e = Extractor(PERSON)
    made = df.transform(e.into("text"))
    rows = made.select("shaped.*", e.feedback_column("shaped").alias("told")).collect()
    assert rows[0].ok and rows[0].data.age == 3 and rows[0].told == e.feedback(e.shape('{"name": "A", "age": "3"}')) and rows[1].told == e.feedback(e.shape("x")) and rows[2].told is None
    assert df.transform(e.into("text", mode="DROPMALFORMED")).count() == 1
    with pytest.raises(Exception, match="Failed to coerce"):
        df.transform(e.into("text", mode="FAILFAST")).select("shaped.data.name").collect()
    plan = made.where("shaped.ok").select("shaped.data.name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2
    many = {"type": "object", "properties": {"m": {"type": "object", "additionalProperties": {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"type": "boolean"}]}}}}}
    row = spark.createDataFrame([('{"m": {"a": [1, true]}}',)], "text string").select(Extractor(many).column("text")["data"]["m"].alias("m")).first()
    assert row.m == {"a": ["1", "true"]}


def test_sources(spark, tmp_path):
    from structcast.sources.tables import extract_table, read_texts, write_split

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"name": "A",\n "age": 3}')
    df = read_texts(spark, f"file://{tmp_path}/in", whole=True).transform(Extractor(PERSON).into("text"))
    assert df.first().shaped.data.age == 3
    both = df.select("text", "shaped").unionByName(spark.createDataFrame([("x",)], "text string").transform(Extractor(PERSON).into("text")))
    write_split(both, "shaped", f"file://{tmp_path}/good", f"file://{tmp_path}/bad")
    assert spark.read.parquet(f"file://{tmp_path}/good").count() == 1 and spark.read.parquet(f"file://{tmp_path}/bad").first().errors == ["Failed to coerce value to target type"]
    assert extract_table(spark, f"file://{tmp_path}/bad", Extractor({"type": "string"}), "raw").select(F.col("shaped.data")).first()[0] == "x"


def test_rollup_of_groups(spark):
    from structcast import quality_rollup

    rows = [("a", "1"), ("a", "2 apples"), ("a", None), (None, "x"), (None, "7"), ("b", "3")]
    df = spark.createDataFrame(rows, "g string, text string").transform(Extractor({"type": "integer"}).into("text"))
    got = {r.g: r for r in quality_rollup(df, "shaped", "g").collect()}
    each = {g: [Extractor({"type": "integer"}).shape(t) for k, t in rows if k == g and t is not None] for g in ("a", None, "b")}
    for g, shaped in each.items():
        assert got[g].n == sum(k == g for k, _ in rows)
        assert got[g].ok_rate == sum(x.ok for x in shaped) / len(shaped)
        kinds = [f.kind for x in shaped for f in x.flags]
        assert (got[g].flag_counts or {}) == {k: kinds.count(k) for k in kinds}
    assert got["b"].flag_counts is None
    assert quality_rollup(df, "shaped").first().n == len(rows)
    assert quality_rollup(df.limit(0), "shaped").first().n == 0


@pytest.mark.parametrize("source,fits,fails", [(r"^\p{L}+$", "p{L}", "123"), (r"^[\d\-]+$", "1-2", "d"), (r"\Abc\Z", "AbcZ", "bc"), (r"^\\p$", "\\p", "p")])
def test_patterns_with_idle_escapes(source, fits, fails):
    own = Extractor({"type": "object", "properties": {"x": {"type": "string", "pattern": source}}, "required": ["x"]})
    assert own.shape(json.dumps({"x": fits})).ok and not own.shape(json.dumps({"x": fails})).ok
