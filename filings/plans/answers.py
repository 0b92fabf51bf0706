"""Whole runs: questions through pipelines to a scored log, resumed where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.operators import outputs, scoring
from filings.run import table, ticker
from filings.sources.files import append_log, read_log

PIPELINES = ("prose", "verified")


def pending(spark: SparkSession, sf_dir: str, done: DataFrame | None) -> DataFrame:
    q = table(spark, sf_dir, "eval_items").select("item_id", "qid", "bucket", ticker().alias("ticker"), "field", "expected_kind", "expected_value_millions")
    work = q.withColumn("pipeline", F.explode(F.array(*map(F.lit, PIPELINES))))
    return work if done is None else work.join(done.select("qid", "pipeline").distinct(), ["qid", "pipeline"], "left_anti")


def run(spark: SparkSession, sf_dir: str, log: str, resume: bool = True) -> DataFrame:
    """Answer and score what isn't in the log yet, append it and give the log back."""
    try:
        done = read_log(spark, log) if resume else None
    except Exception:  # there is no log yet
        done = None
    work = pending(spark, sf_dir, done)
    a = outputs.verified_answers(spark, sf_dir).select("item_id", "prose")
    v = scoring.score_verified(spark, sf_dir).select("item_id", F.col("verdict").alias("verified_verdict"))
    claimed = scoring.claims(F.col("prose"))
    prose, _ = scoring.prose_verdict(F.col("expected_kind"), F.col("expected_value_millions"), claimed, scoring.refuses(F.col("prose")), F.col("prose").rlike(scoring._PERIOD))
    j = work.join(a, "item_id").join(v, "item_id")
    verdict = F.when(F.col("pipeline") == "prose", prose).otherwise(F.col("verified_verdict"))
    rows = j.select("qid", "bucket", "ticker", "field", "pipeline", F.col("prose").alias("answer_prose"), verdict.alias("verdict")).withColumn("is_pass", F.col("verdict").isin("correct", "correctly_refused")).withColumns({"latency_s": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    append_log(rows, log, resume and done is not None)
    return read_log(spark, log)
