"""Fuzzy matching of texts to names."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from ..functions.jsnum import BLANK_CLASS, trim
from ..plans.shapes import Choice
from .flags import Flag

_SEPARATORS = re.compile(f"[-_]|{BLANK_CLASS}")
_NOT_PLAIN = re.compile(f"(?!{BLANK_CLASS})[^a-zA-Z0-9_-]")
_MARKS = re.compile("[̀-ͯ]")
# Letters that are written out.
LIGATURES = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O"})


@lru_cache(1 << 14)
def plain_key(s: str) -> str:
    """A key without separators and case: two keys match when these are equal."""
    return _SEPARATORS.sub("", s).lower()


def without_accents(s: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFKD", s.translate(LIGATURES)))


def without_marks(s: str) -> str:
    """Only ASCII letters, digits, hyphens, underscores and white space."""
    return _NOT_PLAIN.sub("", s)


class Names:
    """The names of a choice, and each name's spellings in every weaker form."""

    def __init__(self, choice: Choice):
        spellings = []
        for m in choice.members:
            own = [m.shown]
            if m.description and trim(m.description):
                own += [m.description, f"{m.shown}: {m.description}"]
            spellings += [(m.name, s) for s in own]
        self.exact = {}
        for m in choice.members:
            self.exact.setdefault(m.shown, m.name)
        forms = (lambda s: s, without_accents, without_marks, lambda s: without_marks(s).lower())
        self.by_form = []
        for form in forms:
            table: dict[str, str] = {}
            for name, s in spellings:
                table.setdefault(form(s), name)
            self.by_form.append((form, table))
        self.lowered = [(s.lower(), name) for name, s in spellings if s]

    def find(self, text: str) -> tuple[str, list[Flag]] | None:
        """The name that the text means, by the first form in which it is one of the spellings, else by what it mentions most."""
        text = trim(text)
        if not text:
            return None
        for strength, (form, table) in enumerate(self.by_form):
            name = table.get(form(text))
            if name is not None:
                return name, [Flag("stripped-non-alphanumeric", text)] if strength else []
        return self._mentioned(text)

    def _mentioned(self, text: str) -> tuple[str, list[Flag]] | None:
        low = text.lower()
        hits = []
        for place, (s, name) in enumerate(self.lowered):
            at = low.find(s)
            while at >= 0:
                hits.append((at, -len(s), place, name))
                at = low.find(s, at + 1)
        counts: Counter = Counter()
        free = -1
        for at, size, _, name in sorted(hits):
            if at >= free:
                counts[name] += 1
                free = at - size
        best = counts.most_common(2)
        if not best or len(best) > 1 and best[0][1] == best[1][1]:
            return None
        return best[0][0], [Flag("substring-match", text)]
