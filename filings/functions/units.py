"""Spellings of units, mapped to the unit they mean.

A spelling's candidates come from an inverted index of the character n-grams of a vocabulary that is built by rule
(currencies by scales, in the usual orders); a weighted edit distance then decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import cache, lru_cache

GRAM = 3
SHARE = 0.4  # of a spelling's n-grams that a candidate must have
FARTHEST = 1.5  # weighted edits; and at most a quarter of the spelling's letters
#: Fixed values. How many USD millions one of the scale is, and how the scales and currencies are written.
_SCALES = {
    1e-3: "thousand thousands tausend k t th tsd 000s 000",
    1.0: "million millions mio mn mm m millones миллион млн",
    1e3: "billion billions b bn mrd milliard milliards milliarden",
    1e6: "trillion trillions tn",
}
_USD = ["usd", "us dollar", "us dollars", "us$", "$", "dollar", "dollars"]
_OTHERS = "eur euro euros € gbp pounds £ jpy yen ¥ chf francs cny rmb yuan inr rupees krw won cad aud sek nok dkk hkd sgd brl mxn rub".split()
_EASTERN = {"十億": 1e3, "億": 100.0, "亿": 100.0, "百万": 1.0, "万": 0.01, "": 1e-6}
_PERCENT = {"percent": 1.0, "pct": 1.0, "per cent": 1.0, "%": 1.0, "percentage": 1.0, "percentage points": 1.0, "bps": 0.01, "bp": 0.01, "basis points": 0.01, "basis point": 0.01, "ratio": 100.0, "fraction": 100.0}


@cache
def vocabulary() -> dict[str, tuple[str, float]]:
    """Spelling: ("usd", USD millions in one), ("percent", percent in one), ("other", 0) or ("shares", 0)."""
    out: dict[str, tuple[str, float]] = {}
    for kind, names in (("other", _OTHERS), ("usd", _USD)):
        for cur in names:
            out |= {cur: (kind, 1e-6), f"{cur} units": (kind, 1e-6)}
            for by, words in _SCALES.items():
                for w in words.split():
                    forms = [f"{cur} {w}", f"{w} {cur}", f"in {w} of {cur}", f"in {cur} {w}", f"{cur} in {w}", f"{w} of {cur}", f"{w} de {cur}", f"{w} en {cur}"]
                    out |= dict.fromkeys([*forms, f"{cur}{w}"] if len(cur) == 3 else forms, (kind, by))
    for cur in ("ドル", "米ドル", "美元"):
        out |= {f"{w}{cur}": ("usd", by) for w, by in _EASTERN.items()}
    out |= {k: ("percent", by) for k, by in _PERCENT.items()}
    out |= dict.fromkeys(("shares", "share", "stock units"), ("shares", 0.0))
    return {k: (kind, 0.0 if kind == "other" else by) for k, (kind, by) in out.items()}


_SEPARATORS = re.compile(r"[\s_\-/,;:()]+")


def plain(spelling: str) -> str:
    return _SEPARATORS.sub(" ", spelling.casefold().replace(".", "")).strip()


def grams(s: str) -> list[str]:
    p = f"  {s} "
    return [p[k : k + GRAM] for k in range(len(p) - GRAM + 1)]


@cache
def index() -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for w in vocabulary():
        for g in set(grams(w)):
            out[g].append(w)
    return out


def distance(a: str, b: str) -> float:
    """Edits from a to b: separators cost 0.2, vowels and doubled letters 0.5, others 1; in words of up to three letters, which differ by one letter from those of another scale, 3."""

    def short(s: str) -> list[bool]:
        return [len(w) <= 3 for w in re.split(r"( )", s) for _ in w] if s else []

    sa, sb = short(a), short(b)

    def cost(c: str, tight: bool, before: str) -> float:
        return 0.2 if c == " " else 3.0 if tight else 0.5 if c in "aeiou" or c == before else 1.0

    row = [0.0]
    for j, c in enumerate(b):
        row.append(row[-1] + cost(c, sb[j], b[j - 1 : j]))
    for i, c in enumerate(a):
        new = [row[0] + cost(c, sa[i], a[i - 1 : i])]
        for j, d in enumerate(b):
            swap = 0.0 if c == d else max(cost(c, sa[i], ""), cost(d, sb[j], ""))
            new.append(min(row[j] + swap, row[j + 1] + cost(c, sa[i], a[i - 1 : i]), new[-1] + cost(d, sb[j], b[j - 1 : j])))
        row = new
    return row[-1]


@lru_cache(1 << 16)
def resolve(spelling: str) -> tuple[str, float] | None:
    """The unit that a spelling means: kind and factor. None if nothing is near, or if two different units are equally near."""
    s = plain(spelling)
    if not s:
        return None
    if s in vocabulary():
        return vocabulary()[s]
    own = set(grams(s))
    shared = Counter(w for g in own for w in index().get(g, ()))
    near: dict[tuple[str, float], float] = {}
    for w, n in shared.items():
        if n >= SHARE * len(own) and (d := distance(s, w)) <= min(FARTHEST, len(s) / 4):
            unit = vocabulary()[w]
            near[unit] = min(d, near.get(unit, d))
    ranked = sorted(near.items(), key=lambda x: x[1])
    return ranked[0][0] if ranked and (len(ranked) == 1 or ranked[0][1] < ranked[1][1]) else None
