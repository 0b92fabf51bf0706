"""Problem 1: lines that recur across the sections of one ticker.

Numbers, dates and names of a line are masked; the masked lines of one ticker are clustered by locality-sensitive hashing
of their word shingles (five words, 0.8). Clusters that reach enough sections are the candidates; a line of a candidate
is a case if the lines that are the same after the consistent form reach as many sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.form import line_keys
from filings.run import STEP, components, cut, rows, table, ticker

RECURS = 5  # sections of one ticker in which a line recurs
SHINGLE, BANDS, WIDTH = 5, 4, 2  # lines of similarity 0.8 share a band with a probability of 0.98
I64, STR, BIN = pa.int64(), pa.string(), pa.binary()

#: Names of months and their short forms, in the languages of the texts.
_MONTHS = frozenset(
    "jan january januar janvier enero ene feb february februar février févr febrero mar march märz mars marzo apr april avril abril abr may mai mayo jun june juni juin junio jul july juli juillet julio aug august août agosto ago sep sept september septembre septiembre oct october okt oktober octobre octubre nov november novembre noviembre dec december dez dezember décembre déc diciembre dic".split()
)
_BETWEEN = frozenset("de of st nd rd th 年 月 日".split())  # what may stand between the parts of a date
_INNER = _MONTHS | _BETWEEN
_WORD = re.compile(r"[^\W_]+|[#¤]")
_SEED = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, BANDS * WIDTH), dtype=np.uint64) | np.uint64(1)


def masked(k: str, names: frozenset[str]) -> list[str]:
    """The words of a line's key with numbers, dates and the words of names (those of the company and its ticker) as one sign for each run of them."""
    w = _WORD.findall(k)
    if "#" not in k and names.isdisjoint(w):
        return w
    out: list[str] = []
    for x in w:
        if x == "#" or x in names:
            if len(out) > 1 and out[-1] in _INNER and out[-2] == "¤" or out and out[-1] in _MONTHS:
                out.pop()
            if out[-1:] != ["¤"]:
                out.append("¤")
        elif not (x in _MONTHS and out[-1:] == ["¤"]):
            out.append(x)
    return out


class Hashes(dict):
    """The hashes of the words that a process has met."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_KNOWN = Hashes()


def signatures(lines: list[list[str]]) -> np.ndarray:
    """BANDS hashes of each line of words. A line under SHINGLE words is filled up, so that it has one shingle."""
    if not lines:
        return np.empty((0, BANDS), np.int64)
    filled = [w if len(w) >= SHINGLE else [*w, *[""] * (SHINGLE - len(w))] for w in lines]
    size = np.fromiter(map(len, filled), np.int64, len(filled))
    h = np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(filled)), np.uint64, int(size.sum()))
    s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - SHINGLE + 1 + j]
        s ^= s >> np.uint64(29)
    # Shingles that reach into the next line are taken out.
    last = np.cumsum(size)
    inside = np.ones(len(s), bool)
    for j in range(1, SHINGLE):
        at = last[:-1] - j
        inside[at[at < len(s)]] = False
    s = s[inside]
    starts = np.r_[0, np.cumsum(size - SHINGLE + 1)[:-1]]
    least = [np.minimum.reduceat(s * a + b, starts) for a, b in _SEED.T]
    bands = [(least[2 * k] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (least[2 * k + 1] * np.uint64(0x165667B19E3779F9) + np.uint64(k)) for k in range(BANDS)]
    return np.stack([(x ^ (x >> np.uint64(31))).view(np.int64) for x in bands], axis=1)


@lru_cache(1 << 14)
def _names(*names: str | None) -> frozenset[str]:
    return frozenset(w for x in names if x for w in _WORD.findall(line_keys(x)[0]) if w.isalpha())


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            ids, ticks, keys, nos, words = [], [], [], [], []
            for section_id, tick, company, content in zip(*(c.to_pylist() for c in b.slice(at, STEP).columns)):
                names = _names(tick, company)
                own: dict[str, list[int]] = {}
                for no, k in enumerate(line_keys(content)):
                    if k:
                        own.setdefault(k, []).append(no)
                for k, where in own.items():
                    ids.append(section_id)
                    ticks.append(tick)
                    keys.append(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")))
                    nos.append(where)
                    words.append(masked(k, names) or [k])
            sig = signatures(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, I64), pa.array(ticks, STR), pa.array(keys, BIN), pa.array(nos, pa.list_(I64)), pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * BANDS, sig.ravel())],
                names=["section_id", "ticker", "k", "nos", "sig"],
            )


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each section and different line, with the places of the line."""
    s = table(spark, sf_dir, "filing_sections").where("content is not null").select("section_id", ticker().alias("ticker"), "company", "content")
    r = s.mapInArrow(_lines, "section_id long, ticker string, k binary, nos array<long>, sig array<long>")
    # A section delivered in several rows counts once: its lines come together by section first.
    # They are read several times below, and so written out once.
    return cut(r.groupBy("ticker", "k", "section_id").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"), F.first("sig").alias("sig")))


def _keys(own: DataFrame) -> DataFrame:
    """The different lines of each ticker: id, in how many sections they are, and their buckets."""
    k = own.groupBy("ticker", "k").agg(F.count("*").alias("sections"), F.first("sig").alias("sig"))
    return k.select("ticker", "k", F.xxhash64("ticker", "k").alias("id"), "sections", "sig")


def clusters(keys: DataFrame) -> DataFrame:
    """(id, cluster) of the lines that share a bucket with another line. Each line of a bucket is linked to the bucket's least line only."""
    b = keys.select("id", F.posexplode("sig").alias("band", "h"), "ticker").select("id", F.xxhash64("ticker", "band", "h").alias("bucket"))
    heads = b.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
    return components(b.join(heads, "bucket").select(F.col("id").alias("a"), F.col("head").alias("b"))).withColumnRenamed("root", "cluster")


def recurring(own: DataFrame) -> DataFrame:
    """(ticker, k, cluster, sections, cluster_sections): the lines of all clusters that reach RECURS sections. cluster_sections adds up its lines' sections."""
    keys = _keys(own)
    of = clusters(keys)
    all_ = keys.drop("sig").join(of, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    often = all_.groupBy("cluster").agg(F.sum("sections").alias("cluster_sections")).where(F.col("cluster_sections") >= RECURS)
    return all_.join(often, "cluster").select("ticker", "k", "cluster", "sections", "cluster_sections")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank contents have no lines; lines of a null ticker make one source; texts of any length are read whole."""
    own = _own(spark, sf_dir)
    often = recurring(own).where(F.col("sections") >= RECURS).select("ticker", "k")
    return own.join(often, (own["k"] == often["k"]) & own["ticker"].eqNullSafe(often["ticker"]), "left_semi").select("section_id", F.explode("nos").alias("line_no"))


def _without(section_id, content, nos) -> Iterator[tuple]:
    nos = set(nos or ())
    yield section_id, content if content is None or not nos else "\n".join(x for n, x in enumerate(content.split("\n")) if n not in nos)


def p1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section, null contents too, without the lines of p1_found."""
    gone = p1_found(spark, sf_dir).groupBy("section_id").agg(F.collect_list("line_no").alias("nos"))
    s = table(spark, sf_dir, "filing_sections").select("section_id", "content").join(gone, "section_id", "left").select("section_id", "content", "nos")
    return rows(s, _without, "section_id long, content string", [I64, STR])


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of near-duplicate lines: how many different lines and sections each has."""
    r = recurring(_own(spark, sf_dir))
    return r.groupBy("ticker", "cluster").agg(F.count("*").alias("lines"), F.max("cluster_sections").alias("sections"))
