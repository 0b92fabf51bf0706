"""Files in and out: filings, questions, logs, results, vectors and settings."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.operators.records import FILING, as_filings

QUESTION = "qid string, bucket string, ticker string, field string, text string, expected_kind string, expected_value_millions double, expected_period_end string, expected_form string, notes string"
RUN = "qid string, bucket string, ticker string, field string, pipeline string, answer_prose string, verdict string, is_pass boolean, latency_s double, error string"


def write_filings(sections: DataFrame, path: str) -> None:
    """JSON filings in one folder for each ticker; writing again replaces only the tickers that are written."""
    as_filings(sections).select("ticker", F.col("json").alias("value")).write.option("partitionOverwriteMode", "dynamic").partitionBy("ticker").mode("overwrite").text(path)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """The sections of all filings under path, or under what a pattern such as raw/*_filings.json matches."""
    d = spark.read.text(path, wholetext=False)
    return d.select(F.explode(F.from_json("value", FILING)).alias("f")).select(F.explode("f.sections").alias("s")).select("s.*")


def read_companyfacts(spark: SparkSession, path: str) -> DataFrame:
    """(tag, unit, pos, form, fy, fp, start, end, val, filed) of company fact files in the public shape facts.us-gaap.TAG.units.UNIT; pos is the order of a unit's entries."""
    entry = "array<struct<form: string, fy: bigint, fp: string, start: string, `end`: string, val: double, filed: string>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.facts.us-gaap"), f"map<string, struct<units: map<string, {entry}>>>").alias("m"))
    tags = d.select(F.explode("m").alias("tag", "x")).select("tag", F.explode("x.units").alias("unit", "e"))
    return tags.select("tag", "unit", F.posexplode("e").alias("pos", "e")).select("tag", "unit", "pos", "e.*")


def write_questions(questions: DataFrame, path: str) -> None:
    questions.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path, multiLine=False)


def append_log(rows: DataFrame, path: str, resume: bool) -> None:
    """Rows of a run log; without resume the log begins anew."""
    rows.write.mode("append" if resume else "overwrite").json(path)


def read_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A run log; strict raises on a line that isn't JSON, otherwise it is passed over."""
    return spark.read.schema(RUN).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A vector collection, made anew."""
    vectors.write.mode("overwrite").parquet(path)


def settings(path: str | None = None) -> dict:
    """Settings from a JSON file, or from a YAML file where a YAML reader is installed; FILINGS_* variables of the environment go before both."""
    out: dict = {}
    if path:
        text = Path(path).read_text()
        try:
            out = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path} isn't JSON, and there is no YAML reader") from e
            out = yaml.safe_load(text) or {}
    return out | {k[8:].lower(): v for k, v in os.environ.items() if k.startswith("FILINGS_")}
