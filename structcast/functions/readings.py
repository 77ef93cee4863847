"""Readings of noisy text: all the values that it may stand for, before any schema is known.

Values are str, float, bool, None, Pairs (an object's keys and values in order, repeats included) and lists. Fenced marks a
value from a code fence, Mended one cut out of prose or repaired there, and Readings the choice between several.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from .jsnum import BLANK, BLANK_CLASS, number_text, to_number, trim


@dataclass(slots=True)
class Pairs:
    items: list[tuple[str, object]]


@dataclass(slots=True)
class Fenced:
    tag: str
    value: object


@dataclass(slots=True)
class Mended:
    value: object
    fixes: tuple[str, ...] = ()


@dataclass(slots=True)
class Readings:
    raw: str
    values: list


@dataclass(frozen=True)
class Options:
    """Which readings are looked for beyond strict JSON. raw_text has no effect: the text itself is always the last resort."""

    fences: bool = True
    embedded: bool = True
    repair: bool = True
    raw_text: bool = True


NOTHING = object()
_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def _ordered(pairs: list[tuple[str, object]]) -> Pairs:
    """Members as an ECMAScript object lists them: array indexes first and ascending, the last of equal keys counts."""
    last = dict(pairs)
    index = sorted((k for k in last if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    return Pairs([(k, last[k]) for k in index] + [(k, v) for k, v in last.items() if k not in index] if index else list(last.items()))


def _refuse(_: str) -> None:
    raise ValueError


_decoder = json.JSONDecoder(object_pairs_hook=_ordered, parse_int=float, parse_float=float, parse_constant=_refuse)


def strict(text: str) -> object:
    """The value of a text that is JSON and nothing else, or NOTHING."""
    text = trim(text)
    if not text:
        return NOTHING
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError):
        return NOTHING


_FENCE = re.compile(rf"(?:^|\n){BLANK_CLASS}*(`{{3,}}|~{{3,}})([^\n]*)\n([\s\S]*?)(?:\n{BLANK_CLASS}*\1|\Z)")


def fences(text: str) -> list[tuple[str, str]]:
    """Tag and content of each code fence; an open one reaches to the end."""
    return [(re.split(BLANK_CLASS, trim(m[2]))[0], m[3]) for m in _FENCE.finditer(text)]


def outside_fences(text: str) -> str:
    return trim(_FENCE.sub("\n", text))


_TO_CLOSE = {"{": ("}", re.compile(r"[{}\"']")), "[": ("]", re.compile(r"[\[\]\"']"))}
_OPENING = re.compile(r"[{\[]")
_STRING_END = {q: re.compile(rf"\\.|{q}", re.S) for q in "\"'"}


def _closing(text: str, at: int, known: dict[int, int]) -> int:
    """Where the bracket opened at `at` closes, counting its own kind outside quotes; -1 if it doesn't.

    One pass settles all brackets of the kind that it meets, which `known` keeps.
    """
    if at in known:
        return known[at]
    close, marks = _TO_CLOSE[text[at]]
    opened, pos = [], at
    while m := marks.search(text, pos):
        pos = m.end()
        if m[0] in "\"'":
            while (e := _STRING_END[m[0]].search(text, pos)) and e[0] != m[0]:
                pos = e.end()
            if e is None:
                break
            pos = e.end()
        elif m[0] != close:
            opened.append(m.start())
        else:
            known[opened.pop()] = m.start()
            if not opened:
                return m.start()
    known.update(dict.fromkeys(opened, -1))
    return -1


def balanced(text: str) -> list[str]:
    """Substrings between matching brackets, from the left, none inside another."""
    out, pos = [], 0
    known: dict[int, int] = {}
    while m := _OPENING.search(text, pos):
        end = _closing(text, m.start(), known)
        if end < 0:
            pos = m.start() + 1
        else:
            out.append(text[m.start() : end + 1])
            pos = end + 1
    return out


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "/": "/", "b": "\b", "f": "\f"}
_HEX = re.compile(r"[0-9a-fA-F]{4}")
_AFTER_BLANK = re.compile(rf"{BLANK_CLASS}*(?:(//|/\*)|(.)|\Z)", re.S)


def _joined(s: str) -> str:
    """Surrogate halves from separate escapes become one character; a lone half becomes U+FFFD."""
    try:
        s.encode()
        return s
    except UnicodeEncodeError:
        return s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@dataclass(slots=True)
class _Open:
    """An object or array that hasn't closed yet; key is what the next value of an object belongs to."""

    is_object: bool
    items: list = field(default_factory=list)
    key: object = NOTHING


class Repair:
    """Reads text that is nearly JSON: any quotes or none, comments, missing or spare commas, missing ends."""

    def __init__(self, text: str):
        self.text, self.open, self.done = text, [], []

    def run(self) -> object:
        pos, n = 0, len(self.text)
        while pos < n:
            pos = self._step(pos)
        while self.open:
            self._close()
        done = self.done
        if len(done) < 2:
            return done[0] if done else NOTHING
        if all(isinstance(v, str) for v in done):
            return done
        nested = [v for v in done if isinstance(v, (Pairs, list))]
        return nested if len(nested) > 1 else nested[0] if nested else done[0]

    def _put(self, value: object) -> None:
        if not self.open:
            self.done.append(value)
            return
        top = self.open[-1]
        if not top.is_object:
            top.items.append(value)
        elif top.key is NOTHING:
            top.key = value if isinstance(value, str) else number_text(value) if type(value) is float else ""
        else:
            top.items.append((top.key, value))
            top.key = NOTHING

    def _close(self) -> None:
        top = self.open.pop()
        self._put(Pairs(top.items) if top.is_object else top.items)

    def _enders(self) -> str:
        """What ends a bare word here, and what must follow a closing quote."""
        if not self.open:
            return "{["
        top = self.open[-1]
        return ",]" if not top.is_object else ":}" if top.key is NOTHING else ",}"

    def _step(self, pos: int) -> int:
        c = self.text[pos]
        if self.open:
            top = self.open[-1]
            if c == ("}" if top.is_object else "]"):
                self._close()
                return pos + 1
            if c == "," or c == ":" and top.is_object:
                return pos + 1
        if c in BLANK:
            return pos + 1
        if c in "{[":
            self.open.append(_Open(c == "{"))
            return pos + 1
        for start, end in (('"""', '"""'), ("```", "```")):
            if self.text.startswith(start, pos):
                return self._block(pos + 3, end, start == "```")
        if c in "\"'`":
            return self._quoted(pos)
        if self.text.startswith("//", pos):
            end = self.text.find("\n", pos)
            return len(self.text) if end < 0 else end + 1
        if self.text.startswith("/*", pos):
            end = self.text.find("*/", pos + 2)
            return len(self.text) if end < 0 else end + 2
        return self._bare(pos)

    def _block(self, pos: int, end: str, skip_line: bool) -> int:
        stop = self.text.find(end, pos)
        body = self.text[pos : len(self.text) if stop < 0 else stop]
        if skip_line:
            body = body.partition("\n")[2].removeprefix("\n")
        self._put(body)
        return len(self.text) if stop < 0 else stop + 3

    def _bare(self, pos: int) -> int:
        enders = self._enders()
        m = re.compile("[" + re.escape(enders) + "]").search(self.text, pos + 1)
        stop = m.start() if m else len(self.text)
        word = trim(self.text[pos:stop])
        if word in ("true", "false", "null"):
            self._put({"true": True, "false": False, "null": None}[word])
        else:
            n = to_number(word)
            self._put(word if n is None else n)
        return stop + 1 if m and m[0] in ":," else stop

    def _quoted(self, pos: int) -> int:
        quote, out, text = self.text[pos], [], self.text
        marks = re.compile(rf"[\\{quote}]")
        pos += 1
        while m := marks.search(text, pos):
            out.append(text[pos : m.start()])
            pos = m.end()
            if m[0] == quote:
                if self._ends(pos):
                    self._put(_joined("".join(out)))
                    return pos
                out.append(quote)
                continue
            c = text[pos : pos + 1]
            if c in _ESCAPES and c:
                out.append(_ESCAPES[c])
                pos += 1
            elif c == "u" and (h := _HEX.match(text, pos + 1)):
                out.append(chr(int(h[0], 16)))
                pos = h.end()
            else:
                out.append("\\")
        out.append(text[pos:])
        self._put(_joined("".join(out)))
        return len(text)

    def _ends(self, pos: int) -> bool:
        """Is the quote before pos the end of its string?"""
        if pos >= len(self.text):
            return True
        if not self.open:
            return self.text[pos] in "{["
        m = _AFTER_BLANK.match(self.text, pos)
        return m[2] is None or m[2] in self._enders()


def repaired(text: str) -> object:
    return Repair(text).run()


def readings(text: str, options: Options = Options()) -> Readings:
    """All plausible values of a text, in order of trust.

    Strict JSON stands alone. Code fences, each as JSON, repaired or text, come before anything else is looked for, with
    the prose around them if that is JSON. Otherwise JSON found in prose and the repaired whole both count.
    """
    whole = strict(text)
    if whole is not NOTHING:
        return Readings(text, [whole])
    found: list = []
    if options.fences:
        for tag, content in fences(text):
            value = strict(content)
            if value is NOTHING:
                value = repaired(content)
                value = content if value is NOTHING else Mended(value)
            found.append(Fenced(tag, value))
        if found:
            prose = outside_fences(text)
            value = strict(prose) if prose else NOTHING
            if value is not NOTHING:
                found.append(value)
            return Readings(text, found if len(found) == 1 else [*found, list(found)])
    if options.embedded:
        inside = [v for v in map(strict, balanced(text)) if v is not NOTHING]
        found += [Mended(v, ("grepped-for-json",)) for v in inside]
        if len(inside) > 1:
            found.append(inside)
    if options.repair and (value := repaired(text)) is not NOTHING:
        found.append(value)
    return Readings(text, found) if found else text


def shown(v: object) -> str:
    """The text that a value turns into where a string is wanted."""
    if isinstance(v, str):
        return v
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, Pairs):
        return "{" + ", ".join(f"{k}: {shown(x)}" for k, x in v.items) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(shown, v)) + "]"
    if isinstance(v, Fenced):
        return f"{v.tag}\n{shown(v.value)}"
    return shown(v.value) if isinstance(v, Mended) else f"AnyOf[{v.raw}]"
