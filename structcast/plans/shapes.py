"""Target shapes: what a schema asks for, as a tree that the driver compiles once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Scalar:
    kind: str  # string, int, float, bool, null


@dataclass(frozen=True)
class Member:
    name: str
    alias: str | None = None
    description: str | None = None

    @property
    def shown(self) -> str:
        return self.name if self.alias is None else self.alias


@dataclass(frozen=True)
class Choice:
    name: str
    members: tuple[Member, ...]


@dataclass(frozen=True)
class Field:
    name: str
    shape: Shape
    optional: bool = False
    alias: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class ListOf:
    item: Shape


@dataclass(frozen=True)
class MapOf:
    key: Shape
    value: Shape


@dataclass(frozen=True)
class OneOf:
    options: tuple[Shape, ...]


@dataclass(frozen=True)
class Const:
    value: str | float | bool


@dataclass(frozen=True)
class Again:
    """A definition by name, where writing it out would never end."""

    name: str


Shape = Scalar | Choice | Record | ListOf | MapOf | OneOf | Const | Again
STRING, INT, FLOAT, BOOL, NULL = (Scalar(k) for k in ("string", "int", "float", "bool", "null"))


@dataclass(frozen=True)
class Target:
    """A compiled schema: its shape, named definitions, and the schema itself for the checks."""

    shape: Shape
    definitions: dict[str, Shape] = field(default_factory=dict)
    schema: dict | None = None


def maybe(shape: Shape) -> Shape:
    """The shape or null, without wrapping twice."""
    if shape == NULL:
        return OneOf((NULL,))
    if allows_null(shape):
        return shape
    return OneOf((*shape.options, NULL)) if isinstance(shape, OneOf) else OneOf((shape, NULL))


def allows_null(shape: Shape) -> bool:
    return shape == NULL or isinstance(shape, OneOf) and NULL in shape.options


def without_null(shape: Shape) -> Shape:
    if not isinstance(shape, OneOf):
        return shape
    rest = tuple(o for o in shape.options if o != NULL)
    return rest[0] if len(rest) == 1 else OneOf(rest)


_SCALARS = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "null": T.StringType()}


def spark_type(shape: Shape) -> T.DataType:
    """The column type of a shape. What may be of several types, or holds itself, is JSON text."""
    match shape:
        case Scalar(kind):
            return _SCALARS[kind]
        case Choice():
            return T.StringType()
        case Const(value):
            return T.BooleanType() if isinstance(value, bool) else T.StringType() if isinstance(value, str) else T.LongType() if value == int(value) else T.DoubleType()
        case Record(_, fields):
            return T.StructType([T.StructField(f.name, spark_type(f.shape), True) for f in fields])
        case ListOf(item):
            return T.ArrayType(spark_type(item), True)
        case MapOf(_, value):
            return T.MapType(T.StringType(), spark_type(value), True)
        case OneOf(options):
            kinds = {spark_type(o).json(): spark_type(o) for o in options if o != NULL}
            return next(iter(kinds.values())) if len(kinds) == 1 and not _holds_itself(shape) else T.StringType()
    return T.StringType()


def is_json_text(shape: Shape) -> bool:
    """Is the column of this shape JSON text rather than a value of its own?"""
    if isinstance(shape, Again):
        return True
    if not isinstance(shape, OneOf):
        return False
    kinds = {spark_type(o).json() for o in shape.options if o != NULL}
    return len(kinds) > 1 or any(is_json_text(o) for o in shape.options)


def _holds_itself(shape: OneOf) -> bool:
    return any(is_json_text(o) for o in shape.options if o != NULL)
