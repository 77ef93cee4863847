"""JSON Schema, or a Spark StructType, to a target shape."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..functions.jsnum import number_text
from .shapes import BOOL, FLOAT, INT, NULL, STRING, Again, Choice, Const, Field, ListOf, MapOf, Member, OneOf, Record, Shape, Target, maybe

_NAMED = {"string": STRING, "integer": INT, "number": FLOAT, "boolean": BOOL, "null": NULL}
_REFERENCE = re.compile(r"#/(?:\$defs|definitions)/(.+)")


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _text(x: object) -> str:
    """A value that isn't a scalar, as text."""
    if isinstance(x, dict):
        return "[object Object]"
    if isinstance(x, list):
        return ",".join("" if v is None else _text(v) for v in x)
    return str(x).lower() if isinstance(x, bool) else number_text(float(x)) if _is_number(x) else str(x)


def _constant(x: object) -> Shape:
    if x is None:
        return NULL
    if isinstance(x, (str, bool)):
        return Const(x)
    return Const(float(x)) if _is_number(x) else Const(_text(x))


class _Compiler:
    def __init__(self, schema: dict):
        found = schema.get("$defs", schema.get("definitions"))
        self.sources = found if isinstance(found, dict) else {}
        self.definitions: dict[str, Shape] = {name: Again(name) for name in self.sources}
        self.busy: set[str] = set()
        self.unnamed = 0
        for name, source in self.sources.items():
            if isinstance(source, dict):
                self._define(name, source)

    def _define(self, name: str, source: dict) -> Shape:
        self.busy.add(name)
        shape = self.shape(source, name)
        self.busy.discard(name)
        self.definitions[name] = shape
        return shape

    def _name(self, name: str | None) -> str:
        if name is None:
            self.unnamed += 1
            return f"Anon{self.unnamed}"
        return name

    def shape(self, s: dict, name: str | None = None) -> Shape:
        """The first keyword that is present decides."""
        if isinstance(s.get("$ref"), str):
            return self._reference(s["$ref"])
        if "const" in s:
            return _constant(s["const"])
        if isinstance(s.get("enum"), list):
            return self._choice(s["enum"], name)
        for key in ("anyOf", "oneOf"):
            if isinstance(s.get(key), list):
                return self._either([self.shape(o, f"{name}_option{i}" if name else None) for i, o in enumerate(s[key])])
        kind = s.get("type")
        if isinstance(kind, list):
            return self._either([self._typed(k, s, name) for k in kind])
        if isinstance(kind, str):
            return self._typed(kind, s, name)
        if isinstance(s.get("properties"), dict):
            return self._object(s, name)
        if isinstance(s.get("items"), (dict, list)):
            return self._list(s)
        if isinstance(s.get("additionalProperties"), dict):
            return self._object(s, name)
        return STRING

    def _typed(self, kind: str, s: dict, name: str | None) -> Shape:
        if kind == "object":
            return self._object(s, name)
        return self._list(s) if kind == "array" else _NAMED.get(kind, STRING)

    def _either(self, options: list[Shape]) -> Shape:
        if len(options) == 1:
            return options[0]
        real = [o for o in options if o != NULL]
        return maybe(real[0]) if len(real) == 1 and len(real) < len(options) else OneOf(tuple(options))

    def _list(self, s: dict) -> Shape:
        items = s.get("items")
        if isinstance(items, list):  # one schema for each place isn't supported
            items = {}
        return ListOf(self.shape(items) if isinstance(items, dict) else STRING)

    def _object(self, s: dict, name: str | None) -> Shape:
        properties = s.get("properties")
        if not isinstance(properties, dict):
            more = s.get("additionalProperties")
            return MapOf(STRING, self.shape(more) if isinstance(more, dict) else STRING)
        required = s["required"] if isinstance(s.get("required"), list) else []
        own = self._name(name)
        fields = []
        for key, source in properties.items():
            source = source if isinstance(source, dict) else {}
            described = _text(source["description"]) if "description" in source else None
            fields.append(Field(key, self.shape(source, f"{own}_{key}"), key not in required, None, described))
        return Record(own, tuple(fields))

    def _choice(self, values: list, name: str | None) -> Shape:
        if all(isinstance(v, str) for v in values):
            return Choice(self._name(name), tuple(map(Member, values)))
        return OneOf(tuple(map(_constant, values)))

    def _reference(self, ref: str) -> Shape:
        m = _REFERENCE.fullmatch(ref)
        if not m:
            return STRING
        name = m[1]
        if name in self.busy:
            return Again(name)
        known = self.definitions.get(name)
        if known is not None and not isinstance(known, Again):
            return known
        source = self.sources.get(name)
        return self._define(name, source) if isinstance(source, dict) else STRING


def from_struct(kind: T.DataType) -> dict:
    """The JSON Schema that says what a Spark type says; nullable fields are not required and may be null."""
    if isinstance(kind, T.StructType):
        properties = {f.name: ({"anyOf": [from_struct(f.dataType), {"type": "null"}]} if f.nullable else from_struct(f.dataType)) for f in kind.fields}
        return {"type": "object", "properties": properties, "required": [f.name for f in kind.fields if not f.nullable]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": from_struct(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": from_struct(kind.valueType)}
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"type": "integer"}
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return {"type": "number"}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.DateType):
        return {"type": "string", "format": "date"}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "string", "format": "date-time"}
    return {"type": "null"} if isinstance(kind, T.NullType) else {"type": "string"}


def as_json_schema(schema: object) -> dict:
    """A schema dict as it is; a Spark type, a DDL string or a model class with model_json_schema() as JSON Schema."""
    if isinstance(schema, dict):
        return schema
    if isinstance(schema, str):
        return from_struct(T.StructType.fromDDL(schema))
    if isinstance(schema, T.DataType):
        return from_struct(schema)
    if callable(getattr(schema, "model_json_schema", None)):
        return schema.model_json_schema()
    raise TypeError(f"not a schema: {schema!r}")


def compile_schema(schema: object, root_name: str = "Root") -> Target:
    """The target of a schema; a Target passes, and a bare shape becomes one without checks."""
    if isinstance(schema, Target):
        return schema
    if isinstance(schema, Shape):
        return Target(schema)
    source = as_json_schema(schema)
    compiler = _Compiler(source)
    return Target(compiler.shape(source, root_name), compiler.definitions, source)
