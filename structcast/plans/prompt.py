"""A target as text that tells a model what to answer with."""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..functions.jsnum import number_text
from .compiler import compile_schema
from .shapes import NULL, Again, Choice, Const, ListOf, MapOf, OneOf, Record, Scalar, Shape, Target, allows_null

# The sentences before the schema.
OPENINGS = {
    "string": "Answer as a string.",
    "int": "Answer as an integer.",
    "float": "Answer as a number.",
    "bool": "Answer as a boolean (true or false).",
    "null": "Answer with null.",
}
IN_JSON, AS_ARRAY = "Answer in JSON using this schema:", "Answer with a JSON Array using this schema:"


@dataclass(frozen=True)
class Style:
    """opening: a sentence, or None for none, in place of the usual one. hoist_records: True, False or "auto"."""

    opening: str | None | bool = True
    either: str = " or "
    member: str = "- "
    hoist_choices: bool = False
    hoist_records: bool | str = "auto"
    quote_fields: bool = False
    map_style: str = "angle"
    root_name: str = "Root"


def _literal(value: object) -> str:
    return number_text(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else json.dumps(value, ensure_ascii=False)


class _Writer:
    def __init__(self, target: Target, style: Style):
        self.target, self.style, self.blocks, self.busy = target, style, {}, set()

    def text(self) -> str:
        shape = self.target.shape
        self._gather(shape)
        main = self._show(shape)
        parts = [*self.blocks.values(), ""] if self.blocks else []
        opening = self._opening(shape) if self.style.opening is True else self.style.opening
        return "\n".join([*parts, *([] if opening is None else [opening]), main])

    def _opening(self, shape: Shape) -> str | None:
        match shape:
            case Scalar(kind):
                return OPENINGS[kind]
            case Choice():
                return None
            case ListOf():
                return AS_ARRAY
            case Const(value):
                return f"Answer with the value: {_literal(value)}"
        return IN_JSON

    def _gather(self, shape: Shape) -> None:
        """Blocks for what is written out before the main schema, inner ones first."""
        match shape:
            case Choice(_, members):
                if self.style.hoist_choices or len(members) > 6 or any(m.description for m in members):
                    self._choice_block(shape)
            case Record(name, fields):
                for f in fields:
                    self._gather(f.shape)
                wanted = self.style.hoist_records
                if name in self.target.definitions if wanted == "auto" else wanted:
                    self._record_block(shape)
            case ListOf(inner) | MapOf(_, inner):
                self._gather(inner)
            case OneOf(options):
                for o in options:
                    self._gather(o)
            case Again(name):
                meant = self.target.definitions.get(name)
                if meant is not None and name not in self.blocks and name not in self.busy:
                    self.busy.add(name)
                    self._gather(meant)
                    if isinstance(meant, Record):
                        self._record_block(meant)
                    elif isinstance(meant, Choice):
                        self._choice_block(meant)
                    self.busy.discard(name)

    def _choice_block(self, shape: Choice) -> None:
        rows = [self.style.member + m.shown + (f": {m.description}" if m.description else "") for m in shape.members]
        self.blocks.setdefault(shape.name, "\n".join([shape.name, "----", *rows]))

    def _record_block(self, shape: Record) -> None:
        if shape.name not in self.blocks:
            self.blocks[shape.name] = ""
            self.blocks[shape.name] = f"{shape.name} {{\n{self._body(shape)}\n}}"

    def _body(self, shape: Record) -> str:
        rows = []
        for f in shape.fields:
            name = f'"{f.name}"' if self.style.quote_fields else f.name
            kind = self._show(f.shape) + (" | null" if f.optional and not allows_null(f.shape) else "")
            rows.append(f"  {name}: {kind}," + (f" // {f.description}" if f.description else ""))
        return "\n".join(rows)

    def _show(self, shape: Shape) -> str:
        match shape:
            case Scalar(kind):
                return kind
            case Const(value):
                return _literal(value)
            case Again(name):
                return name
            case Choice(name, members):
                return name if name in self.blocks else self.style.either.join(m.shown for m in members)
            case Record(name, _):
                return name if name in self.blocks else f"{{\n{self._body(shape)}\n}}"
            case ListOf(item):
                return self._show(item) + "[]"
            case MapOf(key, value):
                form = "{{[key: {}]: {}}}" if self.style.map_style == "object" else "map<{}, {}>"
                return form.format(self._show(key), self._show(value))
            case OneOf(options):
                real = [o for o in options if o != NULL]
                text = self.style.either.join(map(self._show, real or options))
                return text + " | null" if real and len(real) < len(options) else text
        raise TypeError(shape)


def prompt(schema: object, style: Style = Style()) -> str:
    """The text that describes what a schema asks for."""
    return _Writer(compile_schema(schema, style.root_name), style).text()
