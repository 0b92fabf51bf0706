"""Problem 5: texts above a size limit cut into pieces by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.sentences import ends
from filings.run import rows, table

LIMIT, OVERLAP = 2000, 200
MARKS = 32
I64, STR = pa.int64(), pa.string()
_PARAGRAPH = re.compile(r"\n\s*\n\s*")
_BLANK = re.compile(r"\s+")
_CLAUSE = re.compile(r"[、，；：,;]\s*")


def _nearest(at: list[int], low: int, high: int, mid: int) -> int | None:
    """The place of at in [low, high] that is nearest to mid."""
    k = bisect_left(at, mid)
    best = min((x for x in at[max(0, k - 1) : k + 1] if low <= x <= high), key=lambda x: abs(x - mid), default=None)
    return best


def _boundaries(s: str) -> list[list[int]]:
    """Where pieces may begin, the strongest kind first: paragraphs, sentences, words, clauses of texts without blanks."""
    skip = lambda e: (m.end() if (m := _BLANK.match(s, e)) else e)
    return [[m.end() for m in _PARAGRAPH.finditer(s)], [skip(e) for e in ends(s)], [m.end() for m in _BLANK.finditer(s)], [m.end() for m in _CLAUSE.finditer(s)]]


def pieces(s: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of s as positions. Shorter texts are one piece; without any boundary a text is cut at its middle, not before a combining mark unless MARKS of them follow one another."""
    if len(s) <= limit:
        return [(0, len(s))]
    kinds, core, todo = _boundaries(s), [], [(0, len(s))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit - overlap:
            core.append((a, b))
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        cut = next((x for at in kinds if (x := _nearest(at, mid - quarter, mid + quarter, mid)) is not None), None) or next((x for at in kinds if (x := _nearest(at, a + 1, b - 1, mid)) is not None), None)
        if cut is None:
            cut = next((x for x in range(mid, max(a, mid - MARKS), -1) if not unicodedata.combining(s[x])), mid)
        todo += [(cut, b), (a, cut)]
    out = core[:1]
    for a, b in core[1:]:
        start = max(a - overlap, out[-1][0] + 1)
        if not s[start - 1].isspace() and (m := _BLANK.search(s, start, a)) and m.end() < a:
            start = m.end()
        out.append((start, b))
    return out


def contents(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    one = lambda t, k: table(spark, sf_dir, t).where("content is not null").select(F.lit(t).alias("table_name"), F.col(k).alias("item_id"), "content", *more)
    return one("filing_sections", "section_id").unionAll(one("chunks", "chunk_id"))


def _pieces(table_name, item_id, content) -> Iterator[tuple]:
    for no, (a, b) in enumerate(pieces(content)):
        yield table_name, item_id, no, a, b, content[a:b]


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-null content as its pieces; shorter and empty ones as they are."""
    return rows(contents(spark, sf_dir), _pieces, "table_name string, item_id long, piece_no long, start_pos long, end_pos long, piece string", [STR, I64, I64, I64, I64, STR])


def _cut(table_name, item_id, content) -> Iterator[tuple]:
    if len(pieces(content)) > 1:
        yield table_name, item_id


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the bisection cuts; null contents are none."""
    return rows(contents(spark, sf_dir), _cut, "table_name string, item_id long", [STR, I64]).distinct()
