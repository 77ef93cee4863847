"""Fitting of readings to a target shape: the best value, and what had to be changed for it."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from unicodedata import category

from ..functions.jsnum import is_whole, leading_number, number_text, round_half_up, to_number, trim
from ..functions.readings import Fenced, Mended, Pairs, Readings, shown
from ..plans.shapes import NULL, Again, Choice, Const, ListOf, MapOf, OneOf, Record, Scalar, Shape, Target
from .flags import Flag, cost
from .matching import Names, plain_key

FRESH: frozenset[str] = frozenset()  # nothing expanded yet


class Fit(NamedTuple):
    value: object
    flags: list[Flag]


_FRACTION = re.compile(r"(-?[0-9]+)[\s﻿]*/[\s﻿]*(-?[0-9]+)")
_AMOUNT_TAIL = re.compile(r"([0-9][0-9,._]*[0-9]|[0-9]+)[\s﻿]*%?[\s﻿]*\Z")


def _amount(s: str) -> float | None:
    """A number with a sign, currency sign, grouping or percent sign: a last comma with one or two digits after it is the decimal point."""
    rest = s[1:] if s[:1] in ("+", "-") else s
    rest = rest.lstrip()
    if rest and category(rest[0]) == "Sc":
        rest = rest[1:].lstrip()
    m = _AMOUNT_TAIL.match(rest)
    if not m:
        return None
    digits = m[1]
    comma = digits.rfind(",")
    if comma > digits.rfind(".") and len(digits) - comma <= 3:
        digits = digits.replace(".", "").replace(",", ".", 1)
    else:
        digits = digits.replace(",", "")
    n = to_number(digits.replace("_", ""))
    return -abs(n) if n is not None and s.startswith("-") else n


def number_from(text: str) -> Fit | None:
    """A number written as a number, a fraction or an amount."""
    s = trim(text)
    if not s:
        return None
    n = to_number(s)
    if n is None and (m := _FRACTION.fullmatch(s)) and int(m[2]):
        try:
            n = int(m[1]) / int(m[2])
        except OverflowError:
            n = float(m[1]) / float(m[2])
    if n is None:
        n = _amount(s)
    return None if n is None else Fit(n, [Flag("string-to-float", text)])


def better(fits: list[Fit]) -> Fit | None:
    """The best of several: no mere default, no object guessed around a text, the lowest score, the first."""
    return min(fits, key=lambda f: (_is_default(f), _is_guess(f), cost(f.flags)), default=None)


_DEFAULTS = {"default-from-no-value", "optional-default-from-no-value"}


def _is_default(f: Fit) -> bool:
    kinds = {x.kind for x in f.flags}
    if f.value == [] and isinstance(f.value, list) and "single-to-array" in kinds:
        return True
    if "default-from-no-value" not in kinds or not kinds <= _DEFAULTS:
        return False
    return not (isinstance(f.value, dict) and any(v is not None for v in f.value.values()))


def _is_guess(f: Fit) -> bool:
    kinds = {x.kind for x in f.flags}
    return "implied-key" in kinds and not kinds.isdisjoint(("json-to-string", "object-to-string"))


def _type(v: object) -> str:
    return "text" if isinstance(v, str) else "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, float) else type(v).__name__


class Fitter:
    """Fits values to the shapes of one target. strict() takes only what is of the shape already; loose() converts.

    hint: the union option that the list item before took, which unions try first. seen: the definitions expanded for this
    very value; one that comes up again would go on for ever, and fits nothing. Steps into a value start with none.
    """

    def __init__(self, target: Target):
        self.target = target
        self.names = lru_cache(None)(Names)

    def __call__(self, reading: object) -> Fit | None:
        """The best fit; None if nothing fits, or if fitting never ends."""
        return self.loose(reading, self.target.shape, None, FRESH)

    # -- strict ---------------------------------------------------------------------------------------------------

    def strict(self, v: object, shape: Shape, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if isinstance(v, Readings):
            fits = []
            for one in v.values:
                f = self.strict(one, shape, hint, seen)
                if f is not None and not cost(f.flags):
                    return f
                fits += [f] if f is not None else []
            return better(fits)
        if isinstance(v, (Fenced, Mended)):
            return self.strict(v.value, shape, hint, seen)
        match shape:
            case Scalar(kind):
                kind_of = {"string": "text", "int": "number", "float": "number", "bool": "bool", "null": "null"}[kind]
                good = _type(v) == kind_of and (kind != "int" or is_whole(v))
                return Fit(v, []) if good else None
            case Const():
                return self._const(v, shape.value)
            case Choice():
                name = self.names(shape).exact.get(v) if isinstance(v, str) else None
                return None if name is None else Fit(name, [])
            case Record():
                return self._strict_record(v, shape, hint, seen)
            case ListOf(item):
                return self._strict_list(v, item, hint, seen)
            case MapOf():
                return self._map(v, shape, hint, seen, self.strict, False)
            case OneOf():
                return self._either(v, shape, hint, seen, (self.strict,))
            case Again(name):
                meant = self.target.definitions.get(name)
                return None if meant is None or name in seen else self.strict(v, meant, hint, seen | {name})

    def _strict_record(self, v: object, shape: Record, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if not isinstance(v, Pairs):
            return None
        fields = _field_table(shape)
        value, flags = {}, []
        for key, x in v.items:
            f = fields.get(plain_key(key))
            got = None if f is None else self.strict(x, f.shape, hint, FRESH)
            if got is None:
                return None
            value[f.name] = got.value
            flags += got.flags
        for f in shape.fields:
            if f.name not in value:
                if not f.optional:
                    return None
                value[f.name] = None
                flags.append(Flag("optional-default-from-no-value"))
        return Fit(value, flags)

    def _strict_list(self, v: object, item: Shape, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if not isinstance(v, list):
            return None
        value, flags = [], []
        for x in v:
            got = self.strict(x, item, hint, FRESH)
            if got is None:
                return None
            value.append(got.value)
            flags += got.flags
            hint = _option_of(got.flags)
        return Fit(value, flags)

    # -- loose ----------------------------------------------------------------------------------------------------

    def loose(self, v: object, shape: Shape, hint: int | None, seen: frozenset[str]) -> Fit | None:
        match shape:
            case Scalar(kind):
                return getattr(self, "_" + kind)(v)
            case Const():
                return self._const(v, shape.value)
            case Choice():
                return self._choice(v, shape)
            case Record():
                return self._record(v, shape, hint, seen)
            case ListOf():
                return self._list(v, shape, hint, seen)
            case MapOf():
                return self._loose_map(v, shape, hint, seen)
            case OneOf():
                return self._either(v, shape, hint, seen, (self.strict, self.loose))
            case Again(name):
                meant = self.target.definitions.get(name)
                return None if meant is None or name in seen else self.loose(v, meant, hint, seen | {name})

    def _string(self, v: object) -> Fit:
        if isinstance(v, (Fenced, Mended)):
            return self._string(v.value)
        if isinstance(v, Readings):
            return Fit(next((x for x in v.values if isinstance(x, str)), v.raw), [])
        return Fit(v, []) if isinstance(v, str) else Fit(shown(v), [Flag("json-to-string")])

    def _first(self, v: Readings, fit, raw_first: bool) -> Fit | None:
        """The first reading that fits, with the raw text before or after them all."""
        order = [v.raw, *v.values] if raw_first else [*v.values, v.raw]
        return next((f for f in map(fit, order) if f is not None), None)

    def _float(self, v: object) -> Fit | None:
        match _type(v):
            case "number":
                return Fit(v, [])
            case "text":
                return number_from(v)
            case "bool":
                return Fit(float(v), [Flag("json-to-string")])
            case "Fenced" | "Mended":
                return self._float(v.value)
            case "Readings":
                return self._first(v, self._float, False)

    def _int(self, v: object) -> Fit | None:
        if isinstance(v, Readings):
            return self._first(v, self._int, False)
        if isinstance(v, (Fenced, Mended)):
            return self._int(v.value)
        got = self._float(v)
        if got is None or is_whole(got.value):
            return got
        return Fit(round_half_up(got.value), [*got.flags, Flag("float-to-int", number_text(got.value))])

    # Words for true, false and null.
    WORDS = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
    NULLS = ("null", "none", "")

    def _bool(self, v: object) -> Fit | None:
        match _type(v):
            case "bool":
                return Fit(v, [])
            case "text":
                word = self.WORDS.get(trim(v).lower())
                return None if word is None else Fit(word, [Flag("string-to-bool", v)])
            case "number":
                return Fit(v != 0, [Flag("string-to-bool", number_text(v))])
            case "Fenced" | "Mended":
                return self._bool(v.value)
            case "Readings":
                return self._first(v, self._bool, True)

    def _null(self, v: object) -> Fit | None:
        match _type(v):
            case "null":
                return Fit(None, [])
            case "text":
                return Fit(None, [Flag("string-to-null", v)]) if trim(v).lower() in self.NULLS else None
            case "Fenced" | "Mended":
                return self._null(v.value)
            case "Readings":
                return self._first(v, self._null, True)

    def _const(self, v: object, wanted: str | float | bool) -> Fit | None:
        kind = _type(wanted)
        match _type(v):
            case "text":
                if kind == "text":
                    return Fit(wanted, []) if v == wanted else None
                if kind == "number":
                    return Fit(wanted, [Flag("string-to-float", v)]) if leading_number(v) == wanted else None
                return Fit(wanted, [Flag("string-to-bool", v)]) if trim(v).lower() == ("true" if wanted else "false") else None
            case "number":
                if kind == "number" and v == wanted:
                    return Fit(wanted, [])
                return Fit(wanted, [Flag("json-to-string")]) if kind == "text" and number_text(v) == wanted else None
            case "bool":
                return Fit(wanted, []) if kind == "bool" and v == wanted else None
            case "Fenced" | "Mended":
                return self._const(v.value, wanted)
            case "Readings":
                order = [v.raw, *v.values] if kind == "text" else v.values
                return next((f for f in (self._const(x, wanted) for x in order) if f is not None), None)

    def _choice(self, v: object, shape: Choice) -> Fit | None:
        while isinstance(v, (Fenced, Mended)):
            v = v.value
        text = v.raw if isinstance(v, Readings) else v if isinstance(v, str) else shown(v)
        found = self.names(shape).find(text)
        return None if found is None else Fit(*found)

    def _record(self, v: object, shape: Record, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if isinstance(v, (Fenced, Mended)):
            got = self._record(v.value, shape, hint, seen)
            mark = Flag("object-from-markdown") if isinstance(v, Fenced) else Flag("object-from-fixed-json", ", ".join(v.fixes))
            return None if got is None else Fit(got.value, [*got.flags, mark])
        if isinstance(v, Readings):
            fits = [self._record(x, shape, hint, seen) for x in (*v.values, v.raw)]
            return better([f for f in fits if f is not None])
        if not isinstance(v, Pairs):
            return self._implied(v, shape, hint, seen)
        fields = _field_table(shape)
        value, flags = {}, []
        for key, x in v.items:
            f = fields.get(plain_key(key))
            if f is None:
                flags.append(Flag("extra-key", key))
                continue
            got = self.loose(x, f.shape, hint, FRESH)
            if got is not None:
                value[f.name] = got.value
                flags += got.flags
        if not value and v.items and (whole := self._implied(v, shape, hint, seen)) is not None:
            return whole
        for f in shape.fields:
            if f.name not in value:
                value[f.name] = None
                flags.append(Flag("optional-default-from-no-value" if f.optional else "default-from-no-value"))
        return Fit(value, flags)

    def _implied(self, v: object, shape: Record, hint: int | None, seen: frozenset[str]) -> Fit | None:
        """A record of one field around a bare value."""
        if len(shape.fields) != 1:
            return None
        f = shape.fields[0]
        got = self.loose(v, f.shape, hint, seen)
        return None if got is None else Fit({f.name: got.value}, [*got.flags, Flag("implied-key", f.name)])

    def _list(self, v: object, shape: ListOf, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if isinstance(v, Fenced):
            got = self._list(v.value, shape, hint, seen)
            return None if got is None else Fit(got.value, [*got.flags, Flag("object-from-markdown")])
        if isinstance(v, Mended):
            return self._list(v.value, shape, hint, seen)
        if isinstance(v, Readings):
            return self._first(v, lambda x: self._list(x, shape, hint, seen), False)
        if v is None:
            return Fit([], [Flag("single-to-array")])
        if not isinstance(v, list):
            got = self.loose(v, shape.item, hint, seen)
            return None if got is None else Fit([got.value], [*got.flags, Flag("single-to-array")])
        value, flags = [], []
        for i, x in enumerate(v):
            got = self.loose(x, shape.item, hint, FRESH)
            if got is None:
                flags.append(Flag("array-item-parse-error", str(i), i))
            else:
                value.append(got.value)
                flags += got.flags
                hint = _option_of(got.flags)
        return Fit(value, flags)

    def _loose_map(self, v: object, shape: MapOf, hint: int | None, seen: frozenset[str]) -> Fit | None:
        if isinstance(v, Fenced):
            got = self._loose_map(v.value, shape, hint, seen)
            return None if got is None else Fit(got.value, [*got.flags, Flag("object-from-markdown")])
        if isinstance(v, Mended):
            return self._loose_map(v.value, shape, hint, seen)
        if isinstance(v, Readings):
            return next((f for f in (self._loose_map(x, shape, hint, seen) for x in v.values) if f is not None), None)
        return self._map(v, shape, hint, seen, self.loose, True)

    def _map(self, v: object, shape: MapOf, hint: int | None, seen: frozenset[str], fit, drop: bool) -> Fit | None:
        """A map of an object; an entry that doesn't fit is dropped, or spoils the map."""
        if not isinstance(v, Pairs):
            return None
        value, flags = {}, [Flag("object-to-map")]
        for i, (key, x) in enumerate(v.items):
            got = fit(x, shape.value, hint, FRESH)
            name = None if got is None else fit(key, shape.key, hint, FRESH)
            if name is None:
                if not drop:
                    return None
                flags.append(Flag("map-value-parse-error" if got is None else "map-key-parse-error", key, i))
                continue
            value[shown(name.value)] = got.value
            flags += name.flags + got.flags
        return Fit(value, flags)

    def _either(self, v: object, shape: OneOf, hint: int | None, seen: frozenset[str], ways) -> Fit | None:
        """The option that fits best, by each way in turn: the hinted one or the first if it costs nothing."""
        options = shape.options
        if v is None and NULL in options:
            return Fit(None, [Flag("union-match", str(options.index(NULL)), options.index(NULL))])
        for fit in ways:
            got = [None] * len(options)
            tried = range(len(options))
            for k in tried if hint is None or hint >= len(options) else (hint, *(k for k in tried if k != hint)):
                f = fit(v, options[k], None, seen)
                if f is not None:
                    got[k] = Fit(f.value, [*f.flags, Flag("union-match", str(k), k)])
                    if not cost(f.flags):
                        return got[k]
            best = better([f for f in got if f is not None])
            if best is not None:
                return best
        return None


def _option_of(flags: list[Flag]) -> int | None:
    return next((f.index for f in reversed(flags) if f.kind == "union-match"), None)


@lru_cache(256)
def _field_table(shape: Record) -> dict:
    """Fields by plain key; of fields with equal keys the first."""
    table: dict = {}
    for f in shape.fields:
        table.setdefault(plain_key(f.name if f.alias is None else f.alias), f)
    return table
