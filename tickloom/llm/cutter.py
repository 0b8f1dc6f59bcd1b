"""Cuts texts into a vocabulary's pieces: the pattern's matches, one after another.

The pattern needs Unicode classes, which the standard library's expressions lack and which are slow. Texts whose
characters all lie below ``NARROW`` are cut by a standard expression whose classes list those characters outright; the
lists are made by trying each character, so both ways give the same pieces.
"""

from __future__ import annotations

import re

import regex

NARROW = 0x250
_CLASSES = (r"\p{L}", r"\p{N}", r"\s", r"\S")


def _narrow(pattern: str) -> str | None:
    """The pattern with its classes listed, or None if it has classes other than the known ones."""
    listed = {c: "".join(re.escape(chr(x)) for x in range(NARROW) if regex.fullmatch(c, chr(x))) for c in _CLASSES}
    out, inside, at = [], False, 0
    while at < len(pattern):
        known = next((c for c in _CLASSES if pattern.startswith(c, at)), None)
        if known:
            out.append(listed[known] if inside else f"[{listed[known]}]")
            at += len(known)
            continue
        if pattern[at] == "\\":
            return None
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        out.append(pattern[at])
        at += 1
    return "".join(out)


class Cutter:
    """``find(text)`` gives the pieces of a text."""

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern).findall
        narrow = _narrow(pattern)
        self._few = re.compile(narrow).findall if narrow else None
        self._wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search

    def find(self, text: str) -> list[str]:
        return self._few(text) if self._few and not self._wide(text) else self._any(text)
