"""Problem 3: the sentence units of a text, by their end positions in code points.

Paragraphs are parted by blank lines. Within one, the places where a unit may end are the nodes of a lattice: terminators
with their closing marks, the ends of quotations and brackets, and gaps between letters of a script without spaces. An
edge is a possible unit; the heaviest path through the lattice is taken. Thai gaps, and what follows a Japanese or Chinese
quotation, are classified by the words beside them, which come from a lattice over a dictionary: final particles and
opening words end a unit, connecting words hold it together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filings.llm.form import TABLE as _TABLE
from filings.llm.words import first, last
from filings.run import rows, table

_BLANK_LINES = re.compile(r"\n[^\S\n]*\n\s*")
_MARK = re.compile(r"[.!?…。｡।॥]+|[“”„«»「」『』\"()\[\]]|(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])")
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]"}
_CLOSERS = "”“»」』)]\"’'"
_TERMINAL = ".!?…。｡।॥"
_OPEN_OR_CLOSE = re.compile(r"[“”„«»「」『』\"()\[\]]")
_OPENERS = re.compile(r"[“”„«「『\"(\[]")
_LAST = re.compile(r"\S+$")
#: Never the end of a sentence when words go on.
_NEVER = set(
    "mr mrs ms dr prof st gen mt mme mlle mm m sr sra srta dra hr frau nr nos fig figs art arts sec para paras p pp al cf vs v approx env ca tab abb vgl bzw sog inkl ggf pág págs núm aprox pat ext cap vol ch chap e.g i.e z.b d.h u.a p.ej р т.е т.д т.п ул д с стр рис см г-н г-жа им тыс руб col lt sgt capt hon rev incl excl max min resp tsd ej ee प्रो डॉ रु श्री".split()
)
_FIRMS = set("inc corp ltd co plc s.a n.v a.g".split())
_MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic".split())
_DAY = re.compile(r"(?:^|\s)(?:[1-9]|[12]\d|3[01])$")
_GERMAN = re.compile(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Halbjahr|Jahrestag|Geschäftsjahr)")
_NUMBERED = re.compile(r"\s*(?:[Ii]tem|ITEM|[Pp]art|PART|Note|Section|Chapter|Teil|Abschnitt|Artikel|Article|Partie|Parte|Nota|Sección|Глава|Раздел|Часть)?\s*(?:\d+[A-Za-z]?|[IVX]+|[A-Za-z])$")
_LETTERED = re.compile(r"(?i)(?:plan|class|schedule|exhibit|series|annex|appendix|app\.|option|phase|grade|type|tier|section|teil|anhang|classe|anexo|annexe)\s+\w$")
_REPORTS = re.compile(r"[^。！？!?]{0,60}?(?:表示|说|称|指出|ने कहा|बताया)")
#: Japanese words that take up a quotation or a sentence before them.
_TAKES_UP = frozenset("と って という といった との とは とも として などと っ".split())
#: Thai words. A gap before one of the first, or after one of the second, holds a unit together; a final particle ends it whatever follows.
_GOES_ON = frozenset("และ หรือ ที่ ซึ่ง อัน ของ ใน จาก โดย กับ แก่ ต่อ เพื่อ เพราะ แต่ว่า ว่า ให้ ถึง จน ๆ ฯ ฯลฯ คน รายการ ล้าน บาท ดอลลาร์ เปอร์เซ็นต์ ร้อยละ".split())
_HANGS = frozenset("และ หรือ ที่ ซึ่ง อัน ของ ใน จาก โดย กับ แก่ เพื่อ เพราะ ว่า คือ เช่น ได้แก่ คุณ นาย นาง นางสาว บริษัท ประมาณ ราว ร้อยละ".split())
_FINAL = frozenset("ครับ ค่ะ คะ นะ แล้ว เลย ไหม มั้ย หรอ เถอะ สิ ซิ จ้ะ จ๊ะ ด้วย".split())
_OPENS = frozenset("แต่ อย่างไรก็ตาม นอกจากนี้ ดังนั้น ทั้งนี้ ต่อมา โดยสรุป".split())


def _seen(s: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and of each of its characters the position in s; None: the same."""
    if s.isascii() and "\r" not in s or all(len(_TABLE[ord(c)]) == 1 for c in set(s)):
        return s.translate(_TABLE), None
    out, at = [], []
    for k, c in enumerate(s):
        t = _TABLE[ord(c)]
        out.append(t)
        at += [k] * len(t)
    return "".join(out), at


def _upper(c: str, after: str) -> bool:
    return c.isupper() or c.isdigit() or c in "“„«「『\"([¿¡$€£©*#–—-•§" or c.islower() and after.isupper()  # eYorlogate


def _cjk(c: str) -> bool:
    return "\u3040" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "\ufaff"


def _ends(p: str, began: int, at: int, end: int) -> bool:
    """Whether the marks p[at:end] outside of quotations and brackets end the unit that began at began."""
    if any(c in "。｡।॥" for c in p[at:end]):
        return first(p, end) not in _TAKES_UP
    rest = p[end : end + 40].lstrip()
    nxt = rest[:1]
    if not nxt:
        return True
    spaced = p[end].isspace()
    if p[at] in "!?" or p[end - 1] in "!?":
        if not spaced:
            return _cjk(nxt) or _cjk(p[at - 1]) if at else False
        return not (nxt.islower() and not _upper(nxt, rest[1:2]))
    if not spaced or not (_upper(nxt, rest[1:2])):
        return False
    if end - at > 1 or p[at] == "…":
        return True
    m = _LAST.search(p, max(began, at - 40), at)
    if not m:
        return False
    word = m[0].lstrip("(\"“„«[‘’'")
    low = word.lower().replace(" ", "")
    if low.endswith(("’s", "'s")):
        return True
    tail = re.split(r"[’'\-–/]", low)[-1] if "." not in low else low
    if low in _NEVER or tail in _NEVER and not word.isdigit():
        return False
    if nxt.isdigit() and (low in _MONTHS or low in ("no", "n°", "№", "nº", "note", "ziff", "кв", "г")):
        return False
    if low in _FIRMS and re.match(r"(?:Vice )?(?:Chair|Chief|CEO|CFO|COO|President|Director|Treasurer|Secretary)", rest):
        return False
    if low in _FIRMS and rest[:2].isupper() and word.isupper() and p.isupper():
        return False
    if low == "u.s" and re.match(r"(?:Pat|GAAP|Treasury|Dollar)", rest):
        return False
    if low == "p" or re.fullmatch(r"\w", word) and not word.isdigit():
        return bool(_LETTERED.search(p, began, at)) if word.isupper() else low in ("г",)
    if word[:1].isdigit() or len(word) <= 4:
        if _NUMBERED.fullmatch(p, began, at):
            return False
        if _DAY.search(p, max(began, at - 4), at) and _GERMAN.match(rest):
            return False
    return True


def _spans(p: str) -> list[tuple[int, int]]:
    """Quotations and texts in brackets that are closed, outermost only."""
    stack: list[tuple[str, int]] = []
    awaited: Counter[str] = Counter()  # what would close something that is open
    out: list[tuple[int, int]] = []
    for m in _OPEN_OR_CLOSE.finditer(p):
        c, k = m[0], m.start()
        closes = next((n for n in range(len(stack) - 1, -1, -1) if c in stack[n][0]), None) if awaited[c] else None
        if closes is not None and not (c == "“" and stack[closes][0] != "“”"):
            a = stack[closes][1]
            for own, _ in stack[closes:]:
                awaited.subtract(own)
            del stack[closes:]
            while out and out[-1][0] > a:
                out.pop()
            out.append((a, k + 1))
        elif c == '"' or c in _OPEN:
            stack.append((_OPEN.get(c, c), k))
            awaited.update(_OPEN.get(c, c))
    return out


def _thai(p: str, at: int, end: int) -> bool:
    """Whether the gap p[at:end] between Thai letters ends a unit: it does, but for words that hold both sides together."""
    before, after = last(p, at), first(p, end)
    return before in _FINAL or after in _OPENS or before not in _HANGS and after not in _GOES_ON


def _quoted(p: str, began: int, opened: int, at: int, end: int) -> bool:
    """Whether the quotation or bracket p[opened:end] ends the unit that began at began."""
    inner = (p[opened:at].rstrip()[-1:] if p[at] == "»" else p[at - 1 : at]) if at else ""
    first_ = not p[began:opened].strip()
    if not inner or inner not in _TERMINAL and inner not in _CLOSERS:
        return False
    if inner in _CLOSERS and (p[opened:at].rstrip(_CLOSERS)[-1:] or "x") not in _TERMINAL:
        return False
    rest = p[end : end + 80]
    bare = rest.lstrip()
    nxt = bare[:1]
    if p[at] in ")]":
        return first_ and (not nxt or _upper(nxt, bare[1:2]) or not nxt.islower() and nxt.isalpha())
    if not nxt:
        return True
    if nxt in _TERMINAL + ",、，;:" or nxt.islower() and not _upper(nxt, bare[1:2]):
        return False
    if _cjk(rest[:1]) and first(p, end) in _TAKES_UP:
        return False
    return not (first_ and (_REPORTS.match(bare) and not rest[:1].isspace() or "ने कहा" in rest))


_NEAR = 64  # characters before an end on which its weight can hang, but for whether the unit holds nothing before a quotation


def _nodes(p: str) -> list[tuple[int, int, int | None, str]]:
    """The lattice's nodes in order: where a unit may end, where the next would begin, and what kind of end it is. None lies inside of a quotation or bracket."""
    spans = _spans(p) if _OPENERS.search(p) else []
    out: list[tuple[int, int, int | None, str]] = [(b - 1, b, a, "span") for a, b in spans]
    n = 0
    for m in _MARK.finditer(p):
        at, end = m.start(), m.end()
        while n < len(spans) and spans[n][1] <= at:
            n += 1
        if n < len(spans) and spans[n][0] <= at:
            continue
        if m[0].isspace():
            out.append((at, end, None, "gap"))
        elif m[0][0] in _TERMINAL:
            while end < len(p) and p[end] in _CLOSERS and not any(a == end for a, _ in spans[n : n + 1]):
                end += 1
            out.append((at, end, None, "mark"))
    out.sort(key=lambda x: x[:2])
    return out


def _weight(p: str, began: int, node: tuple[int, int, int | None, str]) -> int:
    at, end, opened, kind = node
    yes = _thai(p, at, end) if kind == "gap" else _ends(p, began, at, end) if kind == "mark" else _quoted(p, began, opened or 0, at, end)
    return 1 if yes else -1


def _paragraph(p: str) -> Iterator[int]:
    """The ends of the units of p, which has no blank lines: those of the heaviest path.

    A path is held by where its last unit ended. Of two paths that are a whole edge apart, the lighter can't catch up and is let go.
    """
    paths: dict[int, tuple[int, tuple]] = {0: (0, ())}
    for node in _nodes(p):
        at, end, _, kind = node
        stop = at if kind == "gap" else end
        best: tuple[int, tuple] | None = None
        known: int | None = None
        for began in sorted(paths, reverse=True):
            if began > at or not p[began:stop].strip():
                continue
            weight, ends_ = paths[began]
            if known is None or at - began < _NEAR or kind == "span":
                w = _weight(p, began, node)
                known = w if at - began >= _NEAR else known
            else:
                w = known
            if w > 0:
                if best is None or weight + w > best[0]:
                    best = (weight + w, (stop, ends_))
                paths[began] = (weight - w, ends_)  # an edge over a place where its unit would end is that much lighter
        if best:
            paths = {b: x for b, x in paths.items() if x[0] >= best[0] - 1}
            paths[stop] = best
    _, chain = max(paths.items(), key=lambda x: (x[1][0], x[0]))[1]
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    if p[out[0] if out else 0 :].strip():
        out.insert(0, len(p))
    for e in reversed(out):
        yield len(p[:e].rstrip())


def ends(content: str) -> list[int]:
    s, where = _seen(content)
    out, began = [], 0
    for stop, nxt in [*((m.start(), m.end()) for m in _BLANK_LINES.finditer(s)), (len(s), len(s))]:
        if s[began:stop].strip():
            out += [began + e for e in _paragraph(s[began:stop])]
        began = nxt
    return [e if where is None else where[e - 1] + 1 for e in out]


def _found(section_id, content):
    for e in ends(content):
        yield section_id, e


def _sentences(section_id, content):
    began = 0
    for no, e in enumerate(ends(content)):
        yield section_id, no, content[began:e].strip()
        began = e


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "filing_sections").where("content is not null").select("section_id", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the units; null and blank contents have none."""
    return rows(_contents(spark, sf_dir), _found, "section_id long, end_pos long", [pa.int64(), pa.int64()])


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every content, in order; null and blank contents have none."""
    return rows(_contents(spark, sf_dir), _sentences, "section_id long, sentence_no long, sentence string", [pa.int64(), pa.int64(), pa.string()])
