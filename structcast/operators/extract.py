"""Typed values from a text column."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.jsnum import is_whole, number_text
from ..functions.readings import Options, readings
from ..plans.compiler import as_json_schema, compile_schema
from ..plans.prompt import Style, prompt
from ..plans.shapes import BOOL, FLOAT, INT, STRING, Again, Choice, Const, ListOf, MapOf, OneOf, Record, Scalar, Shape, Target, is_json_text, spark_type
from .checks import violations
from .fitting import Fit, Fitter
from .flags import REPAIRS, Flag, cost
from .matching import plain_key

FLAG_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("penalty", T.LongType()), T.StructField("path", T.StringType()), T.StructField("message", T.StringType())]))
FAILED = "Failed to coerce value to target type"  # fixed value
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
_WHOLE = 2**53

Rule = Callable[[object], object]


class Shaped(NamedTuple):
    """The result for one text; score is None where nothing fits."""

    ok: bool
    data: object
    errors: list[str]
    score: int | None
    flags: list[Flag]
    raw: str


class ShapedError(ValueError):
    def __init__(self, result: Shaped):
        super().__init__("; ".join(result.errors) or "Structuring failed with no error message")
        self.result = result


def _json(v: object) -> object:
    """Numbers as JSON writes them; a number that JSON has no word for is null."""
    if isinstance(v, dict):
        return {k: _json(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_json(x) for x in v]
    if isinstance(v, float):
        return int(v) if is_whole(v) and abs(v) < 1e21 else v if v == v and abs(v) != float("inf") else None
    return v


def column_value(v: object, shape: Shape) -> object:
    """A fitted value as its column holds it."""
    if v is None:
        return None
    if is_json_text(shape):
        return json.dumps(_json(v), ensure_ascii=False, separators=(",", ":"))
    match shape:
        case Scalar("int"):
            return int(v)
        case Scalar() | Choice():
            return v
        case Const(value):
            return int(v) if isinstance(value, float) and value == int(value) else v
        case Record(_, fields):
            return {f.name: column_value(v.get(f.name), f.shape) for f in fields}
        case ListOf(item):
            return [column_value(x, item) for x in v]
        case MapOf(_, value):
            return [(k, column_value(x, value)) for k, x in v.items()]
        case OneOf(options):
            return column_value(v, next((o for o in options if o != Scalar("null")), STRING))
    return v


def _too_large(v: object, shape: Shape) -> bool:
    """Does a value hold a whole number that no long can?"""
    if v is None or is_json_text(shape):
        return False
    match shape:
        case Scalar("int"):
            return not -(2**63) <= v < 2**63
        case Record(_, fields):
            return any(_too_large(v.get(f.name), f.shape) for f in fields)
        case ListOf(item):
            return any(_too_large(x, item) for x in v)
        case MapOf(_, value):
            return any(_too_large(x, value) for x in v.values())
        case OneOf(options):
            return _too_large(v, next((o for o in options if o != Scalar("null")), STRING))
    return False


@dataclass
class Extractor:
    """A schema compiled once, for texts one by one, columns, frames and streams.

    schema: JSON Schema, Spark type, DDL, a class with model_json_schema(), a shape or a Target. rules: functions of the
    fitted value whose text, if they return one, is an error. A whole number beyond a long fits nothing.
    """

    schema: object
    options: Options = Options()
    checks: bool = True
    rules: tuple[Rule, ...] = ()
    style: Style = Style()
    target: Target = field(init=False)

    def __post_init__(self):
        self.target = compile_schema(self.schema, self.style.root_name)
        self.rules = tuple(self.rules)
        self.checks = self.checks and bool(self.target.schema) and _constrained(self.target.schema)
        self._whole = "int" in repr(self.target)  # may the value hold a whole number?

    def but(self, **changes) -> Extractor:
        """The same extractor with other options, checks, rules or style."""
        return replace(self, **changes) if changes else self

    # -- one text ---------------------------------------------------------------------------------------------------

    def fit(self, text: str) -> Fit | None:
        try:
            got = self._fitter()(readings(text, self.options))
            return None if got is None or self._whole and _too_large(got.value, self.target.shape) else got
        except RecursionError:  # nested deeper than the interpreter goes: nothing fits, and the result says so
            return None

    def _fitter(self) -> Fitter:
        found = self.__dict__.get("_own")
        if found is None:
            found = self.__dict__["_own"] = Fitter(self.target)
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_own"}

    def errors(self, value: object) -> list[str]:
        """Broken constraints, then what the rules say."""
        out = [v.text for v in violations(value, self.target.schema)] if self.checks else []
        return out + [said for said in (rule(value) for rule in self.rules) if isinstance(said, str)]

    def shape(self, text: str) -> Shaped:
        got = self.fit(text)
        if got is None:
            return Shaped(False, None, [FAILED], None, [], text)
        errors = self.errors(got.value)
        return Shaped(not errors, got.value, errors, cost(got.flags), got.flags, text)

    def require(self, text: str) -> object:
        """The value, or an error that tells what is wrong."""
        result = self.shape(text)
        if not result.ok:
            raise ShapedError(result)
        return result.data

    def prompt(self) -> str:
        return prompt(self.target, self.style)

    def feedback(self, result: Shaped) -> str | None:
        """What to tell a model so that its next answer is better; None for a perfect one."""
        if result.ok and result.score == 0:
            return None
        lines = [f"Error: {e}" for e in result.errors] if not result.ok else []
        told = [f for f in result.flags if f.is_repair] + [f for f in result.flags if not f.is_repair]
        if told:
            lines.append("The following corrections were needed:")
            lines += [f"  - {f.message}" + (f' at "{f.path}"' if f.path else "") for f in told]
        return "\n".join([*lines, "", "Please respond using exactly this format:", self.prompt()])

    # -- columns ----------------------------------------------------------------------------------------------------

    @property
    def data_type(self) -> T.DataType:
        return spark_type(self.target.shape)

    @property
    def result_type(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("ok", T.BooleanType()),
                T.StructField("data", self.data_type),
                T.StructField("errors", T.ArrayType(T.StringType())),
                T.StructField("score", T.LongType()),
                T.StructField("flags", FLAG_TYPE),
                T.StructField("raw", T.StringType()),
            ]
        )

    def row(self, text: str) -> dict:
        r = self.shape(text)
        return {
            "ok": r.ok,
            "data": column_value(r.data, self.target.shape),
            "errors": r.errors,
            "score": r.score,
            "flags": [{"kind": f.kind, "penalty": f.penalty, "path": f.path, "message": f.message} for f in r.flags],
            "raw": r.raw,
        }

    def batch(self, texts: list[str | None]) -> pa.Array:
        """Results for texts as an Arrow struct array, built column by column."""
        kind = to_arrow_type(self.result_type)
        found = [None if t is None else self.shape(t) for t in texts]
        data = [None if r is None else column_value(r.data, self.target.shape) for r in found]
        flags = [[] if r is None else r.flags for r in found]
        flat = [f for fs in flags for f in fs]
        told = pa.StructArray.from_arrays([pa.array([f.kind for f in flat], pa.string()), pa.array([f.penalty for f in flat], pa.int64()), pa.array([f.path for f in flat], pa.string()), pa.array([f.message for f in flat], pa.string())], fields=list(kind.field("flags").type.value_type))
        ends = [0]
        for fs in flags:
            ends.append(ends[-1] + len(fs))
        columns = [
            pa.array([None if r is None else r.ok for r in found], pa.bool_()),
            pa.array(data, kind.field("data").type),
            pa.array([None if r is None else r.errors for r in found], kind.field("errors").type),
            pa.array([None if r is None else r.score for r in found], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told, type=kind.field("flags").type),
            pa.array(texts, pa.string()),
        ]
        return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array([r is None for r in found], pa.bool_()))

    def kernel(self):
        """The extraction of Arrow batches of texts as a function of a column; evaluated once, also under a filter on its result."""
        own = self

        @F.arrow_udf(returnType=self.result_type)
        def kernel(texts: pa.Array) -> pa.Array:
            return own.batch(texts.to_pylist())

        return kernel.asNondeterministic()

    def column(self, text: Column | str, fast: bool = True) -> Column:
        """A struct column: ok, data, errors, score, flags, raw; null for a null text.

        Texts that are strict JSON, bare or in one fence, and just what a record asks for are read by Catalyst expressions; the others go
        in Arrow batches to the kernel, which gets nulls in place of the texts already read.
        """
        text = F.col(text) if isinstance(text, str) else text
        quick = _catalyst(self, text) if fast else None
        kernel = self.kernel()
        if quick is None:
            return kernel(text)
        easy, value = quick
        return F.coalesce(F.when(easy, value), kernel(F.when(~easy, text)))

    def into(self, text: str, out: str = "shaped", mode: str = "PERMISSIVE", fast: bool = True) -> Callable[[DataFrame], DataFrame]:
        """For df.transform(): adds the struct column. DROPMALFORMED keeps rows that are ok, FAILFAST fails on the first that isn't."""
        if mode.upper() not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

        def apply(df: DataFrame) -> DataFrame:
            made = df.withColumn(out, self.column(F.col(text), fast))
            if mode.upper() == "DROPMALFORMED":
                return made.where(F.col(f"{out}.ok"))
            return made.withColumn(out, asserted(F.col(out))) if mode.upper() == "FAILFAST" else made

        return apply

    def feedback_column(self, shaped: Column | str) -> Column:
        """feedback() for a result column."""
        return feedback(shaped, self.prompt())


def extract(text: Column | str, schema: object, **options) -> Column:
    return Extractor(schema, **options).column(text)


def extract_into(text: str, schema: object, out: str = "shaped", mode: str = "PERMISSIVE", **options) -> Callable[[DataFrame], DataFrame]:
    return Extractor(schema, **options).into(text, out, mode)


# -- Catalyst fast path ------------------------------------------------------------------------------------------------

_GUARD = "structcast-guard-7f3a"
_VARIANT = {INT: "BIGINT", FLOAT: r"(?:BIGINT|DOUBLE|DECIMAL\(\d+, ?\d+\))", STRING: "STRING", BOOL: "BOOLEAN"}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_ONE_FENCE = r"\A(?:[^`~]*\n)?[ \t]*```[^\n`~]*\n([^`~]*)\n[ \t]*```[^`~]*\z"  # a text with one code fence and no other backtick or tilde


def _is_plain(shape: Shape) -> bool:
    """Can Catalyst read the shape: required scalars, lists and records of such, with keys that differ also in plain form?"""
    match shape:
        case ListOf(item):
            return _is_plain(item)
        case Record(_, fields):
            named = all(_NAME.fullmatch(f.name) and f.alias is None and not f.optional and _is_plain(f.shape) for f in fields)
            return bool(fields) and named and len({plain_key(f.name) for f in fields}) == len(fields)
    return shape in _VARIANT


def _variant_pattern(shape: Shape) -> str:
    """What schema_of_variant() says of a value of the shape."""
    match shape:
        case ListOf(item):
            return f"ARRAY<(?:{_variant_pattern(item)}|VOID)>"
        case Record(_, fields):
            return "OBJECT<" + ", ".join(f"{f.name}: {_variant_pattern(f.shape)}" for f in sorted(fields, key=lambda f: f.name)) + ">"
    return _VARIANT[shape]


def _is_whole_value(x: Column, shape: Shape) -> Column:
    """No null anywhere, and no whole number of more than 53 bits. A list's members may lack keys that others have: those are null."""
    match shape:
        case ListOf(item):
            return x.isNotNull() & F.forall(x, lambda e: F.coalesce(_is_whole_value(e, item), F.lit(False)))
        case Record(_, fields):
            return reduce(and_, (_is_whole_value(x[f.name], f.shape) for f in fields), x.isNotNull())
    return F.abs(x) <= _WHOLE if shape == INT else x.isNotNull()


def _catalyst(e: Extractor, text: Column) -> tuple[Column, Column] | None:
    """For a record of required values without constraints or rules: whether a text is plain for it, and its result.

    A text is plain if it is strict JSON, or has that in its only code fence. A guard after the JSON makes trailing
    characters an error. The members must be exactly the fields, of their types; whole numbers of more than 53 bits are
    left to the kernel.
    """
    shape = e.target.shape
    if not isinstance(shape, Record) or e.rules or e.checks or not _is_plain(shape):
        return None
    fenced = F.contains(text, F.lit("```")) & text.rlike(_ONE_FENCE) if e.options.fences else F.lit(False)
    body = F.when(fenced, F.regexp_extract(text, _ONE_FENCE, 1)).otherwise(text)
    both = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{_GUARD}"]')))
    guarded = (F.try_variant_get(both, "$[1]", "string") == _GUARD) & F.try_variant_get(both, "$[2]", "variant").isNull()
    value = F.try_variant_get(both, "$[0]", "variant")
    got = [F.try_variant_get(value, f"$.{f.name}", spark_type(f.shape).simpleString()) for f in shape.fields]
    easy = guarded & F.schema_of_variant(value).rlike(rf"^{_variant_pattern(shape)}$")
    for f, x in zip(shape.fields, got, strict=True):
        easy &= _is_whole_value(x, f.shape)
    mark = Flag("object-from-markdown")
    told = F.array(F.struct(F.lit(mark.kind).alias("kind"), F.lit(mark.penalty).cast("long").alias("penalty"), F.lit(mark.path).alias("path"), F.lit(mark.message).alias("message")))
    result = F.struct(
        F.lit(True).alias("ok"), F.struct(*[x.alias(f.name) for f, x in zip(shape.fields, got, strict=True)]).alias("data"), F.array().cast("array<string>").alias("errors"), F.lit(0).cast("long").alias("score"),
        F.when(fenced, told).otherwise(F.array().cast(FLAG_TYPE)).alias("flags"), text.alias("raw"),
    )
    return F.coalesce(easy, F.lit(False)) & text.isNotNull(), result.cast(e.result_type)


_KEYWORDS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "minProperties", "maxProperties"}


def _constrained(schema: object) -> bool:
    if isinstance(schema, list):
        return any(map(_constrained, schema))
    return isinstance(schema, dict) and (not _KEYWORDS.isdisjoint(schema) or any(map(_constrained, schema.values())))


# -- result columns ----------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repairs(shaped: Column | str) -> Column:
    """The flags that tell of repairs to the text."""
    return F.filter(_col(shaped)["flags"], lambda f: f["kind"].isin(*REPAIRS))


def coercions(shaped: Column | str) -> Column:
    """The flags that tell of changes to values."""
    return F.filter(_col(shaped)["flags"], lambda f: ~f["kind"].isin(*REPAIRS))


def score_of(flags: Column | str) -> Column:
    return F.aggregate(_col(flags), F.lit(0).cast("long"), lambda total, f: total + f["penalty"])


def asserted(shaped: Column | str) -> Column:
    """The result, or an error of the query where it isn't ok."""
    c = _col(shaped)
    return F.when(c["ok"] | c.isNull(), c).otherwise(F.raise_error(F.array_join(c["errors"], "; ")))


def ruled(shaped: Column | str, rules: list[tuple[Column, Column | str]]) -> Column:
    """The result with further rules as columns: a message is an error where its predicate is false; a null one passes.

    Results that fit nothing stay as they are. Predicates may use the result's data and any other column.
    """
    c = _col(shaped)
    said = [F.when(~good, F.lit(message) if isinstance(message, str) else message) for good, message in rules]
    errors = F.concat(c["errors"], F.filter(F.array(*said).cast("array<string>"), lambda e: e.isNotNull()))
    more = c.withField("errors", errors).withField("ok", F.size(errors) == 0)
    return F.when(c["score"].isNull(), c).otherwise(more)


def feedback(shaped: Column | str, prompt_text: str) -> Column:
    """What to tell a model after a result; null for a perfect one."""
    c = _col(shaped)
    told = F.concat(repairs(c), coercions(c))
    listed = F.transform(told, lambda f: F.concat(F.lit("  - "), f["message"], F.when(f["path"] != "", F.concat(F.lit(' at "'), f["path"], F.lit('"'))).otherwise(F.lit(""))))
    errors = F.when(c["ok"], F.array().cast("array<string>")).otherwise(F.transform(c["errors"], lambda e: F.concat(F.lit("Error: "), e)))
    corrections = F.when(F.size(told) > 0, F.concat(F.array(F.lit("The following corrections were needed:")), listed)).otherwise(F.array().cast("array<string>"))
    last = F.array(F.lit(""), F.lit("Please respond using exactly this format:"), F.lit(prompt_text))
    return F.when(c.isNotNull() & ~(c["ok"] & (F.coalesce(c["score"], F.lit(-1)) == 0)), F.array_join(F.concat(errors, corrections, last), "\n"))


def quality_rollup(df: DataFrame, shaped: str, *by: str) -> DataFrame:
    """By group: n, share that is ok, mean score, and how often each kind of flag occurs."""
    c = F.col(shaped)
    each = df.select(*by, c["ok"].cast("int").alias("__ok"), c["score"].alias("__score"), F.posexplode_outer(F.transform(c["flags"], lambda f: f["kind"])).alias("__at", "__kind"))
    once = F.coalesce(F.col("__at"), F.lit(0)) == 0  # a row for each flag, or one without; the first stands for the result
    sums = {"n": F.lit(1), "ok": F.col("__ok"), "oks": F.col("__ok").isNotNull().cast("int"), "score": F.col("__score"), "scores": F.col("__score").isNotNull().cast("int")}
    kinds = each.groupBy(*by, "__kind").agg(F.count("*").alias("__count"), *[F.sum(F.when(once, x)).alias(f"__sum_{k}") for k, x in sums.items()])
    listed = F.sort_array(F.collect_list(F.when(F.col("__kind").isNotNull(), F.struct(F.col("__kind").alias("kind"), F.col("__count").alias("count")))))
    total = {k: F.sum(f"__sum_{k}") for k in sums}
    rate = lambda x, n: F.when(total[n] > 0, total[x] / total[n])
    return kinds.groupBy(*by).agg(
        F.coalesce(total["n"], F.lit(0)).alias("n"), rate("ok", "oks").alias("ok_rate"), rate("score", "scores").alias("mean_score"),
        F.when(F.size(listed) > 0, F.map_from_entries(listed)).alias("flag_counts"),
    )


def best_candidate(df: DataFrame, key: list[str], default: str, guess: str, score: str, place: str) -> DataFrame:
    """Of several candidates for a key the best: no default, no guess, the lowest score, the first."""
    rank = F.struct(default, guess, score, place)
    return df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), rank).alias("__best")).select(*key, "__best.*")


__all__ = ["Extractor", "Shaped", "ShapedError", "Again", "as_json_schema", "asserted", "best_candidate", "coercions", "extract", "extract_into", "feedback", "number_text", "quality_rollup", "repairs", "ruled", "score_of"]
