"""What was changed on the way from a text to a value, what each change costs, and how it is told."""

from __future__ import annotations

from typing import NamedTuple

# The penalty of each kind of change; array-item-parse-error also costs its index.
PENALTIES = {
    "object-from-markdown": 0,
    "object-from-fixed-json": 0,
    "union-match": 0,
    "inferred-object": 0,
    "optional-default-from-no-value": 1,
    "object-to-map": 1,
    "extra-key": 1,
    "single-to-array": 1,
    "string-to-bool": 1,
    "string-to-null": 1,
    "string-to-char": 1,
    "string-to-float": 1,
    "float-to-int": 1,
    "map-key-parse-error": 1,
    "map-value-parse-error": 1,
    "first-match": 1,
    "no-fields": 1,
    "array-item-parse-error": 1,
    "default-but-had-unparseable-value": 2,
    "object-to-string": 2,
    "object-to-primitive": 2,
    "json-to-string": 2,
    "implied-key": 2,
    "substring-match": 2,
    "stripped-non-alphanumeric": 3,
    "default-from-no-value": 100,
    "default-but-had-value": 110,
    "str-match-one-from-many": 0,
}
REPAIRS = ("object-from-markdown", "object-from-fixed-json", "inferred-object")

# The sentence for each kind of change; {} is the flag's detail.
SENTENCES = {
    "object-from-markdown": "Extracted JSON from markdown code block",
    "object-from-fixed-json": "Repaired malformed JSON (fixes: {})",
    "inferred-object": "Inferred object structure",
    "default-but-had-unparseable-value": "Used default: {}",
    "object-to-string": "Converted object to string",
    "object-to-primitive": "Converted object to primitive",
    "object-to-map": "Converted typed object to map",
    "extra-key": 'Ignored extra key "{}"',
    "stripped-non-alphanumeric": 'Stripped non-alphanumeric characters from "{}"',
    "substring-match": 'Matched substring "{}" to enum value',
    "single-to-array": "Wrapped single value into array",
    "array-item-parse-error": "Array item parse error: Failed to coerce item at index {}",
    "map-key-parse-error": 'Map key parse error: Failed to coerce key "{}"',
    "map-value-parse-error": 'Map value parse error: Failed to coerce value for key "{}"',
    "json-to-string": "Serialized JSON value to string",
    "implied-key": 'Inferred object key "{}"',
    "first-match": "Picked first match (index {})",
    "union-match": "Matched union variant {}",
    "str-match-one-from-many": "Ambiguous string matched from {} candidates",
    "default-from-no-value": "Used default value (required field missing)",
    "default-but-had-value": "Used default (could not parse provided value)",
    "optional-default-from-no-value": "Used null for missing optional field",
    "string-to-bool": 'Converted "{}" to boolean',
    "string-to-null": 'Converted "{}" to null',
    "string-to-char": 'Converted "{}" to char',
    "string-to-float": 'Converted "{}" to number',
    "float-to-int": "Rounded {} to integer",
    "no-fields": "Object has no fields",
}


class Flag(NamedTuple):
    kind: str
    detail: str = ""
    index: int = 0  # of a list item, a map entry or a union option

    @property
    def penalty(self) -> int:
        return PENALTIES[self.kind] + (self.index if self.kind == "array-item-parse-error" else 0)

    @property
    def path(self) -> str:
        if self.kind == "array-item-parse-error":
            return f"[{self.index}]"
        if self.kind == "map-key-parse-error":
            return f"[key {self.index}]"
        return self.detail if self.kind == "map-value-parse-error" else ""

    @property
    def message(self) -> str:
        return SENTENCES[self.kind].replace("{}", self.detail)

    @property
    def is_repair(self) -> bool:
        return self.kind in REPAIRS


def cost(flags: list[Flag]) -> int:
    """The score: the plain sum of all penalties."""
    return sum(f.penalty for f in flags)
