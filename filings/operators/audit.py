"""Two independent readings of a document's figures: consensus, consistency, rounds of dispute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.text import TICKER
from filings.registry import query
from filings.run import table, ticker

FIELDS = ("revenue", "cogs", "gross_profit", "ebitda", "net_income")
MORE = ("gross_margin_pct", "ebitda_margin_pct", "net_margin_pct", "yoy_revenue_growth_pct", "prior_period_revenue")
DISPUTED, FLOOR = 0.0001, 1e-9
RELATIVE, POINTS, ORDER = 0.005, 0.5, 1.005
ROUNDS = 3


def delta(h: Column, a: Column) -> Column:
    """Relative to the larger; infinite if only one side has a value, null if none has."""
    return F.when(h.isNull() & a.isNull(), F.lit(None)).when(h.isNull() | a.isNull(), F.lit(float("inf"))).otherwise(F.abs(h - a) / F.greatest(F.abs(h), F.abs(a), F.lit(FLOOR)))


PARTS = 8  # documents that a company's facts are dealt to, by their chunks
_DOC = f"{TICKER} || '/' || coalesce(chunk_id % {PARTS}, {PARTS})"
_IN = "(" + ", ".join(f"'{f}'" for f in FIELDS) + ")"
_READ = f"""
    n AS (SELECT {_DOC} AS document, field_name AS field, fact_value AS v, row_number() OVER (PARTITION BY {_DOC}, field_name ORDER BY structured_fact_id) AS up, row_number() OVER (PARTITION BY {_DOC}, field_name ORDER BY structured_fact_id DESC) AS down FROM structured_facts WHERE fact_value IS NOT NULL AND field_name IS NOT NULL),
    hunter AS (SELECT document, field, up AS round, v AS h FROM n WHERE up <= 3), auditor AS (SELECT document, field, down AS round, v AS a FROM n WHERE down <= 3),
    both_ AS (SELECT document, field, round, h, a, CASE WHEN h IS NULL OR a IS NULL THEN CAST('inf' AS DOUBLE) ELSE abs(h - a) / greatest(abs(h), abs(a), 1e-9) END AS delta FROM hunter FULL JOIN auditor USING (document, field, round) WHERE field IN {_IN})"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, field, round, h, a): in each round one agent reads the next fact from the front, the other from the back."""
    s = table(spark, sf_dir, "structured_facts").where("fact_value is not null and field_name is not null").select(F.concat(ticker(), F.lit("/"), F.coalesce(F.col("chunk_id") % PARTS, F.lit(PARTS))).alias("document"), F.col("field_name").alias("field"), F.col("fact_value").alias("v"), F.col("structured_fact_id").alias("id"))
    by = Window.partitionBy("document", "field")
    up = s.withColumn("round", F.row_number().over(by.orderBy("id"))).where(F.col("round") <= ROUNDS).select("document", "field", "round", F.col("v").alias("h"))
    down = s.withColumn("round", F.row_number().over(by.orderBy(F.desc("id")))).where(F.col("round") <= ROUNDS).select("document", "field", "round", F.col("v").alias("a"))
    return up.join(down, ["document", "field", "round"], "full_outer")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).where(F.col("field").isin(*FIELDS)).withColumn("delta", delta(F.col("h"), F.col("a")))


@query("V6 J4", f"WITH {_READ} SELECT document, field, h, a, round(delta, 6) AS delta, delta > {DISPUTED} AS disputed FROM both_ WHERE round = 1")
def agent_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir).where("round = 1").select("document", "field", "h", "a", F.round("delta", 6).alias("delta"), (F.col("delta") > DISPUTED).alias("disputed"))


@query("V8 V9 V21", f"""WITH {_READ}, r AS (SELECT document, round, bool_and(delta <= {DISPUTED}) AS met FROM both_ GROUP BY ALL)
    SELECT document, CAST(coalesce(min(round) FILTER (met), 3) AS INTEGER) AS rounds, CASE WHEN bool_or(met) THEN 'consensus' ELSE 'max_iterations' END AS outcome FROM r GROUP BY document""")
def audit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After how many rounds the readings agree; a disagreement opens the next round, up to three."""
    r = _both(spark, sf_dir).groupBy("document", "round").agg(F.bool_and(F.col("delta") <= DISPUTED).alias("met"))
    return r.groupBy("document").agg(F.coalesce(F.min(F.when(F.col("met"), F.col("round"))), F.lit(ROUNDS)).cast("int").alias("rounds"), F.when(F.bool_or("met"), "consensus").otherwise("max_iterations").alias("outcome"))


_WIDE = f"wide AS (SELECT document, {', '.join(f'''max(h) FILTER (field = '{f}') AS {f}''' for f in FIELDS + MORE)} FROM hunter WHERE round = 1 GROUP BY document)"
#: check: the inputs that must be there, expected, stated, whether it's off, severity.
_CHECKS = {
    "gross_profit_arithmetic": ("revenue - cogs", "gross_profit", f"abs(revenue - cogs - gross_profit) / greatest(abs(gross_profit), {FLOOR}) > {RELATIVE}", "high"),
    "gross_margin_consistency": ("gross_profit / nullif(revenue, 0) * 100", "gross_margin_pct", f"abs(gross_profit / nullif(revenue, 0) * 100 - gross_margin_pct) > {POINTS}", "high"),
    "ebitda_margin_consistency": ("ebitda / nullif(revenue, 0) * 100", "ebitda_margin_pct", f"abs(ebitda / nullif(revenue, 0) * 100 - ebitda_margin_pct) > {POINTS}", "high"),
    "net_margin_consistency": ("net_income / nullif(revenue, 0) * 100", "net_margin_pct", f"abs(net_income / nullif(revenue, 0) * 100 - net_margin_pct) > {POINTS}", "high"),
    "yoy_growth_consistency": ("(revenue - prior_period_revenue) / nullif(prior_period_revenue, 0) * 100", "yoy_revenue_growth_pct", f"abs((revenue - prior_period_revenue) / nullif(prior_period_revenue, 0) * 100 - yoy_revenue_growth_pct) > {POINTS}", "high"),
    "ordering_net_vs_gross": ("gross_profit", "net_income", f"net_income > gross_profit * {ORDER}", "medium"),
}
_ANOMALIES = "anomalies AS (" + " UNION ALL ".join(f"SELECT document, '{k}' AS \"check\", round({e}, 2) AS expected, round({s}, 2) AS stated, '{v}' AS severity FROM wide WHERE {off}" for k, (e, s, off, v) in _CHECKS.items()) + ")"


def anomalies(wide: DataFrame) -> DataFrame:
    """(document, check, expected, stated, severity). A check runs only if its inputs are there and its divisor isn't 0: null is never off."""
    all_ = F.array(*(F.when(F.expr(off), F.struct(F.lit(k).alias("check"), F.round(F.expr(f"cast({e} as double)"), 2).alias("expected"), F.round(F.expr(s), 2).alias("stated"), F.lit(v).alias("severity"))) for k, (e, s, off, v) in _CHECKS.items()))
    return wide.select("document", F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("x")).select("document", "x.*")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = readings(spark, sf_dir).where("round = 1 and h is not null")
    return first.groupBy("document").agg(*(F.max(F.when(F.col("field") == f, F.col("h"))).alias(f) for f in FIELDS + MORE))


@query("V4", f'WITH {_READ}, {_WIDE}, {_ANOMALIES} SELECT document, "check", expected, stated, severity FROM anomalies')
def consistency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(_wide(spark, sf_dir))


@query("V7 V5 M13", f"""WITH {_READ}, {_WIDE}, {_ANOMALIES},
    c AS (SELECT document, bool_and(delta <= {DISPUTED}) AS met, string_agg(field, ', ' ORDER BY field) FILTER (delta > {DISPUTED}) AS disputed, count(h) FILTER (field = 'revenue') > 0 AS claimed FROM both_ WHERE round = 1 GROUP BY document),
    a AS (SELECT document, count(*) AS n, string_agg("check", ', ' ORDER BY "check") AS checks FROM anomalies GROUP BY document)
    SELECT document, met AND n IS NULL AS consensus, claimed <> met OR (met AND n IS NOT NULL) AS overridden, coalesce(disputed, '') AS disputed, coalesce(checks, '') AS anomalies FROM c LEFT JOIN a USING (document)""")
def arbiter_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arithmetic overrides what the arbiter claims (offline: consensus wherever there is revenue), and an anomaly forces a dispute."""
    c = _both(spark, sf_dir).where("round = 1").groupBy("document").agg(F.bool_and(F.col("delta") <= DISPUTED).alias("met"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("delta") > DISPUTED, F.col("field")))), ", ").alias("disputed"), (F.count(F.when(F.col("field") == "revenue", F.col("h"))) > 0).alias("claimed"))
    a = anomalies(_wide(spark, sf_dir)).groupBy("document").agg(F.array_join(F.array_sort(F.collect_list("check")), ", ").alias("anomalies"))
    j = c.join(a, "document", "left")
    off = F.col("anomalies").isNotNull()
    return j.select("document", (F.col("met") & ~off).alias("consensus"), ((F.col("claimed") != F.col("met")) | (F.col("met") & off)).alias("overridden"), "disputed", F.coalesce("anomalies", F.lit("")).alias("anomalies"))


@query("E28", """SELECT user_id, string_agg(props, ' | ' ORDER BY first, props) AS message FROM (SELECT user_id, props, min(ts) AS first FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY 1, 2) GROUP BY user_id""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct error messages in the order in which they came."""
    e = table(spark, sf_dir, "events").where("event_type = 'error' and props is not null").groupBy("user_id", "props").agg(F.min("ts").alias("first"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "props"))), lambda x: x["props"]), " | ").alias("message"))
