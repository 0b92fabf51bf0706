"""Problem 2: texts that look the same but are stored in different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.form import form, readable
from filings.run import key, rows, table

I64, STR, BIN = pa.int64(), pa.string(), pa.binary()


def _looks(section_id, accession_number, content, title) -> Iterator[tuple]:
    for field, within, s in (("content", "", content), ("section_title", accession_number, title)):
        if s is not None and within is not None and (f := form(s)).strip():
            yield field, key(f"{within}\0{f}"), section_id, key(s)


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the consistent form and of the stored string; texts themselves aren't shuffled."""
    s = table(spark, sf_dir, "filing_sections").select("section_id", "accession_number", "content", "section_title")
    seen = rows(s, _looks, "field_name string, k binary, id long, raw binary", [STR, BIN, I64, BIN])
    ways = seen.groupBy("field_name", "k").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("field_name", "k")
    return seen.join(ways, ["field_name", "k"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts are no cases, nor are titles without an accession number; rows repeated under one section_id make no pair with themselves."""
    some = _seen(spark, sf_dir).distinct()
    a, b = some.alias("a"), some.alias("b")
    return a.join(b, F.expr("a.field_name = b.field_name and a.k = b.k and a.id < b.id and a.raw <> b.raw")).select("a.field_name", F.col("a.id").alias("section_id_a"), F.col("b.id").alias("section_id_b")).distinct()


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes behind p2_found: every section of a look that is stored in several ways, with the least section_id of its class."""
    some = _seen(spark, sf_dir)
    least = some.groupBy("field_name", "k").agg(F.min("id").alias("class_id"))
    return some.join(least, ["field_name", "k"]).select("field_name", F.col("id").alias("section_id"), "class_id").distinct()


def _formed(section_id, title, content) -> Iterator[tuple]:
    yield section_id, title and readable(title), content and readable(content)


def p2_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section with its title and content in the consistent form; nulls stay null."""
    s = table(spark, sf_dir, "filing_sections").select("section_id", "section_title", "content")
    return rows(s, _formed, "section_id long, section_title string, content string", [I64, STR, STR])
