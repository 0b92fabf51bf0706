"""Row functions over Arrow batches, and where lineage is cut."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 256  # rows held as Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def ticker() -> F.Column:
    """The ticker upper-cased and without blanks around it."""
    return F.upper(F.regexp_replace("ticker", r"(?U)^\s+|\s+$", ""))


def rows(df: DataFrame, f: Callable[..., Iterable[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """f(*row) gives rows of schema; df's columns are f's arguments."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                out = [r for row in zip(*(c.to_pylist() for c in b.slice(at, STEP).columns)) for r in f(*row)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return df.mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder of spark.checkpoint.dir; only a local session may have one of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): the least id of its connected component.

    Alternating large-star and small-star steps: each step sends every edge to the least neighbour of one of its ends, so
    that hubs shrink as they are met; a hub's edges are only grouped by partial aggregates and joins, never listed in one task.
    """

    def count(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = count(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = cut(small)
        now = count(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("id"), "root").unionAll(roots.select(F.col("root").alias("id"), "root").distinct())
