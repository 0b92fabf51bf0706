"""Problem 9: documents that hold passages of held-out items.

MinHash containment: items are partitioned by their number of shingles (NGRAM words), and each partition's sketch is as
long as its largest item, because a single shingle is a case: a bottom-k sketch with k below that could miss it. So every
shingle of a document that is in an item's sketch makes a candidate; an exact comparison of the words follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.form import words
from filings.llm.lines import Hashes
from filings.run import rows, table

NGRAM = 12
#: Sketched shingles that are sent to the tasks as they are (32 bytes each); more of them are joined by a shuffle.
SENT = 1 << 18
I64 = pa.int64()
_KNOWN = Hashes()


def shingles(w: list[str]) -> np.ndarray:
    """A hash for each run of NGRAM words."""
    n = len(w) - NGRAM + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w))
    out = np.zeros(n, np.uint64)
    for j in range(NGRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def sketch(w: list[str]) -> tuple[int, list[int]]:
    """An item's size partition (sizes up to a power of two) and its bottom-k sketch, with the partition's k."""
    own = np.unique(shingles(w))
    part = int(len(own) - 1).bit_length() if len(own) else 0
    return part, own[: 1 << part].tolist()


def _sketched(item_id, text) -> Iterator[tuple]:
    w = words(text)
    part, own = sketch(w)
    for h in own:
        yield item_id, part, h


def _own(doc_id, text) -> Iterator[tuple]:
    w = words(text)
    for at, h in enumerate(shingles(w).tolist()):
        yield doc_id, h, " ".join(w[at : at + NGRAM])


def by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for any number of items: shingles meet by their hashes and are compared word for word. Repeated shingles of a document go together first."""
    d = rows(docs, _own, "doc_id long, h long, words string", [I64, I64, pa.string()]).distinct()
    i = rows(items, _own, "item_id long, h long, words string", [I64, I64, pa.string()]).distinct()
    return d.join(i, ["h", "words"]).select("doc_id", "item_id").distinct()


def _search(sketches: list[tuple[int, int, int]], texts: dict[int, str]):
    hashes = np.unique(np.array([h for _, _, h in sketches], np.int64))
    own: dict[int, dict[str, list[int]]] = {}
    for item, text in texts.items():
        w = words(text)
        for at, h in enumerate(shingles(w).tolist()):
            own.setdefault(h, {}).setdefault(" ".join(w[at : at + NGRAM]), []).append(item)

    def f(doc_id, text) -> Iterator[tuple]:
        w = words(text)
        h = shingles(w)
        if not len(h) or not len(hashes):
            return
        at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
        found: set[int] = set()
        for k in at.tolist():
            found.update(own[int(h[k])].get(" ".join(w[k : k + NGRAM]), ()))
        for item in found:
            yield doc_id, item

    return f


def contained(docs: DataFrame, items: DataFrame, sent: int = SENT) -> DataFrame:
    sketches = rows(items, _sketched, "item_id long, part int, h long", [I64, pa.int32(), I64])
    if sketches.select(F.count("*")).first()[0] > sent:
        return by_join(docs, items)
    # At most SENT shingles, so at most as many items with a shingle.
    known = sketches.collect()
    texts = dict(items.join(sketches.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "text").collect())
    return rows(docs, _search([tuple(r) for r in known], texts), "doc_id long, item_id long", [I64, I64]).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts under NGRAM words hold nothing; a document that is there twice comes out once."""
    items = table(spark, sf_dir, "eval_items").where("text is not null").select("item_id", "text")
    return contained(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), items)
