"""Numbers, white space and lengths by the rules of ECMAScript, which the extraction semantics follow."""

from __future__ import annotations

import math
import re

# The white space of ECMAScript's trim and \s.
BLANK = "\t\n\v\f\r                  　﻿"
BLANK_CLASS = "[" + BLANK + "]"
_PLAIN = re.compile(r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_BASED = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")


def trim(s: str) -> str:
    return s.strip(BLANK)


def _as_float(s: str) -> float:
    return math.copysign(math.inf, -1 if s[0] == "-" else 1) if s.endswith("Infinity") else float(s)


def to_number(s: str) -> float | None:
    """The whole text as a number, None if it isn't one; blank text is 0."""
    s = trim(s)
    if not s:
        return 0.0
    if _PLAIN.fullmatch(s):
        return _as_float(s)
    if _BASED.fullmatch(s):
        try:
            return float(int(s, 0))
        except OverflowError:
            return math.inf
    return None


def leading_number(s: str) -> float | None:
    """The number that the text begins with."""
    m = _PLAIN.match(s.lstrip(BLANK))
    return _as_float(m[0]) if m else None


def number_text(x: float) -> str:
    """Shortest text of a double: plain digits from 1e-6 up to under 1e21, else an exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        text = digits + "0" * (point - n)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        e = point - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))
    return "-" + text if x < 0 else text


def is_whole(x: float) -> bool:
    return math.isfinite(x) and x == math.floor(x)


def round_half_up(x: float) -> float:
    """To the nearest whole number, halves towards positive infinity."""
    if not math.isfinite(x):
        return x
    low = math.floor(x)
    return float(low + (x - low >= 0.5))


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) + sum(c > "￿" for c in s)
