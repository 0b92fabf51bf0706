"""Problems 6 and 8: token counts and ids under a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.bpe import CHUNK, OVERLAP, VOCABULARY, bpe
from filings.llm.split import contents
from filings.run import STEP, table, ticker


def _batches(df: DataFrame, f, schema: str) -> DataFrame:
    """f gets and gives record batches of at most STEP rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                yield f(b.slice(at, STEP))

    return df.mapInArrow(run, schema)


def p6_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each non-null content; an empty one has 0. Each task encodes its distinct pieces once, so no occurrence is shuffled."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        n = bpe(vocabulary).count(b.column("content").to_pylist())
        keep = [k for k in b.schema.names if k != "content"]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, "tokens"])

    c = contents(spark, sf_dir, ticker().alias("ticker"), "lang", "section_name")
    return _batches(c, f, "table_name string, item_id long, ticker string, lang string, section_name string, tokens long")


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of p6_tokens by ticker, lang and section_name; a null lang or section_name is a slice of its own."""
    own = p6_tokens(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(k).alias("slice_by"), F.col(k).alias("slice")) for k in ("ticker", "lang", "section_name")))).alias("x"), "tokens")
    return own.groupBy("x.slice_by", "x.slice").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def p6_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each combination of ticker, lang and section_name that there is."""
    return p6_tokens(spark, sf_dir).groupBy("ticker", "lang", "section_name").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


_IDS = pa.list_(pa.int32())


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ids of every document's text, without special tokens; null and empty texts have an empty list.

    Texts above chunk characters are cut into overlapping chunks that several tasks pre-tokenise; their boundaries come
    together by document, are stitched where they meet and the pieces are encoded. Every row comes out once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    long_ = F.coalesce(F.length("text") > chunk, F.lit(False))

    def short(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe(vocabulary).encode([x or "" for x in b.column(1).to_pylist()]), _IDS)], names=["doc_id", "ids"])

    def bounds(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [[a + x for x in bpe(vocabulary).boundaries(t)] for a, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "start", "bounds"])

    def stitched(b: pa.RecordBatch) -> pa.RecordBatch:
        e, out = bpe(vocabulary), []
        for text, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            at = [*e.stitch(text, [p["bounds"] for p in sorted(parts, key=lambda p: p["start"])], chunk, overlap), len(text)]
            split = [text[x:y] for x, y in zip(at, at[1:])]
            e.learn([split])
            out.append([i for p in split for i in e.kept[p]])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _IDS)], names=["doc_id", "ids"])

    big = docs.where(long_)
    parts = big.select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("start"), "text").select("doc_id", F.col("start").cast("long").alias("start"), F.col("text").substr(F.col("start") + 1, F.lit(chunk + overlap)).alias("part"))
    parts = _batches(parts.repartition("doc_id", "start"), bounds, "doc_id long, start long, bounds array<long>")
    met = big.join(parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "bounds")).alias("parts")), "doc_id").select("doc_id", "text", "parts")
    schema = "doc_id long, ids array<int>"
    return _batches(docs.where(~long_), short, schema).unionAll(_batches(met, stitched, schema))
