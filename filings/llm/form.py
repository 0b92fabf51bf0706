"""The consistent form of problem 2: one string for all strings that look the same.

Quick-check properties tell which characters of a text can change (or can join a neighbour); only those segments, with
the characters beside them that may interact, are normalised, and the results are spliced into the unchanged text.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

#: Letters of other scripts that look like Latin ones.
_LATIN = {
    "АΑ": "A", "ВΒ": "B", "СϹ": "C", "ЕΕ": "E", "НΗ": "H", "ІΙӀ": "I", "ЈͿ": "J", "КΚ": "K", "МΜ": "M", "Ν": "N", "ОΟՕ": "O", "РΡ": "P", "Ѕ": "S", "ТΤ": "T", "УΥҮ": "Y", "ХΧ": "X", "Ζ": "Z",
    "аɑα": "a", "сϲ": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һհ": "h", "іι": "i", "јϳ": "j", "ӏ": "l", "ոո": "n", "оοօ": "o", "рρ": "p", "ԛ": "q", "ѕ": "s", "սυ": "u", "νѵ": "v", "ԝ": "w", "х": "x", "уүγ": "y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "‐‑": "-",
}
LOOKALIKE = {c: to for cs, to in _LATIN.items() for c in cs}
#: Lower case of the upper-case letters that look alike, so that folding case after the form doesn't part what was one.
_LOWER = {ord(c.lower()): to.lower() for c, to in LOOKALIKE.items() if c.lower() != c and c.lower() not in LOOKALIKE}
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)}


def _one(c: str) -> str:
    if c == "\n":
        return c
    cat = U.category(c)
    if c == "\t" or cat in ("Zs", "Zl", "Zp") or c in "\x0b\x0c\x85":
        return "\n" if cat in ("Zl", "Zp") or c == "\x85" else " "
    if cat in ("Cf", "Cc") or ord(c) in _INVISIBLE:
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    kind = U.decomposition(c).partition(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>") or kind == "<compat>" and (cat[0] in "LN" or 0x2E80 <= ord(c) < 0x2FE0):
        return "".join(x if x == c else _one(x) for x in U.normalize("NFKD", c))
    return c


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = to = _one(chr(code))
        return to


TABLE = _Table()


def _whole(s: str) -> str:
    return U.normalize("NFC", U.normalize("NFD", s).translate(TABLE))


def _second() -> frozenset[str]:
    """The characters of NFC_Quick_Check=Maybe: the second parts of the canonical compositions, and the Hangul vowels and finals."""
    out = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}
    for block in (range(0xC0, 0x3100), range(0x11000, 0x12000), range(0x16000, 0x17000)):
        for code in block:
            d = U.decomposition(chr(code))
            if d and d[0] != "<" and " " in d:
                out.add(chr(int(d.split()[1], 16)))
    return frozenset(out)


_MAYBE = _second()


class _Checks:
    """The quick checks of the characters seen so far, and the pattern of the segments that they make unstable."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.mapped: set[str] = set()
        self.marks: set[str] = set()
        self.changed: re.Pattern = re.compile(r"(?!)")
        self.moving: re.Pattern = re.compile(r"(?!)")

    def learn(self, new: set[str]) -> None:
        self.seen |= new
        mapped = {c for c in new if _whole(c) != c}
        marks = {c for c in new if c not in mapped and (U.combining(c) or c in _MAYBE)}
        if not mapped and not marks:
            return
        self.mapped |= mapped
        self.marks |= marks
        u, k, m = ("".join(map(re.escape, sorted(x))) for x in (self.mapped, self.marks, self.mapped | self.marks))
        if u:  # a run of marks is entered at its beginning only, so that long ones are passed over once
            self.changed = re.compile(rf"(?:[^{m}]|(?<![{k}]))[{k}]*+[{u}][{m}]*+" if k else rf"[^{m}]?[{u}]+")
        self.moving = re.compile(rf"[^{m}]?[{m}]+")


_CHECKS = _Checks()
_ODD = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


@lru_cache(1 << 16)
def _segment(s: str) -> str:
    return _whole(s)


def form(s: str) -> str:
    """s in the consistent form; texts without an unstable segment come back as they are."""
    if s.isascii() and not _ODD.search(s):
        return s
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    own = set(s)
    if new := own - _CHECKS.seen:
        _CHECKS.learn(new)
    stable = U.is_normalized("NFC", s)
    if stable and _CHECKS.mapped.isdisjoint(own):
        return s
    return (_CHECKS.changed if stable else _CHECKS.moving).sub(lambda m: _segment(m[0]), s)


_FOLDS = frozenset(chr(c) for c in range(0x370, 0x600) if ord(U.normalize("NFD", chr(c))[0]) in _LOWER)


def folded(s: str) -> str:
    """The form with letter case disregarded."""
    s = form(s).casefold()
    return s if s.isascii() or _FOLDS.isdisjoint(s) else U.normalize("NFC", U.normalize("NFD", s).translate(_LOWER))


_DIGITS = re.compile(r"\d+")
_BREAKS = re.compile(r"[\r\x85\u2028\u2029\x0b\x0c\x1c-\x1e]")


def line_keys(content: str) -> list[str]:
    """Of each line of content (split at line feeds) what makes it the same as another; blank lines have an empty key."""
    s = _DIGITS.sub("#", folded(_BREAKS.sub(" ", content)))
    return [" ".join(x.split()) for x in s.split("\n")]


_WORD = re.compile(r"[^\W_]+")


def words(s: str) -> list[str]:
    return _WORD.findall(folded(s))


_CYRILLIC = {to: c for cs, to in _LATIN.items() for c in cs[:1] if "Ѐ" <= c <= "ӿ"}
_TO_CYRILLIC = str.maketrans({k: v for k, v in _CYRILLIC.items() if len(k) == 1 and k.isalpha()})
_LETTERS = re.compile(r"[^\W\d_]+")
_OWN_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_OWN_LATIN = re.compile(r"[a-zA-Z]")


def _readable(m: re.Match) -> str:
    w = m[0]
    if not _OWN_CYRILLIC.search(w):
        return w
    back = w.translate(_TO_CYRILLIC)
    return w if _OWN_LATIN.search(back) else back


def readable(s: str) -> str:
    """The form as it is written out: a word with a letter that only the Cyrillic script has keeps to that script. It is a function of form(s), so equal forms stay equal."""
    s = form(s)
    return s if s.isascii() or not _OWN_CYRILLIC.search(s) else _LETTERS.sub(_readable, s)
