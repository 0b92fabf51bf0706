"""Prose figures against tagged ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions.text import TICKER
from filings.registry import query
from filings.run import table, ticker

TOLERANCE = 0.5  # percent, included
#: Fixed values.
PATTERNS = ("no_delta", "non_gaap_vs_gaap", "periodicity", "hierarchy", "versioning", "metric_mapping", "unexplained", "lookup_failed")
LEGITIMATE = PATTERNS[:6]
#: The offline rules of the delta classifier: words of a rationale or quote that speak for a pattern.
SIGNS = {
    "non_gaap_vs_gaap": r"adjusted|non-gaap|pro forma|excluding|excludes|one-time",
    "periodicity": r"trailing|year-to-date|first (?:six|nine) months|latest quarter|cumulative",
    "hierarchy": r"segment|business unit|division|consolidated",
    "versioning": r"restated|amended|revised|previously reported|original",
    "metric_mapping": r"mapped|operating income reported as|related metric",
}


def delta_pct(prose: Column, tagged: Column) -> Column:
    """Signed, in percent of the tagged figure; against 0 infinite, or 0 if both are."""
    return F.when(tagged == 0, F.when(prose == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise((prose - tagged) / tagged * 100)


def pattern(prose: Column, tagged: Column, words: Column) -> Column:
    d = delta_pct(prose, tagged)
    out = F.lit("unexplained")
    for name, sign in reversed(SIGNS.items()):
        out = F.when(F.lower(words).rlike(sign), name).otherwise(out)
    return F.when(tagged.isNull(), "lookup_failed").when(F.abs(d) <= TOLERANCE, "no_delta").otherwise(out)


_DELTA = "CASE WHEN xbrl_value = 0 THEN CASE WHEN prose_value = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE (prose_value - xbrl_value) / xbrl_value * 100 END"
_PATTERN = f"CASE WHEN xbrl_value IS NULL THEN 'lookup_failed' WHEN abs({_DELTA}) <= {TOLERANCE} THEN 'no_delta' {' '.join(f'''WHEN regexp_matches(lower(rationale), '{s}') THEN '{n}' ''' for n, s in SIGNS.items())} ELSE 'unexplained' END"
_FOUND = f"found AS (SELECT finding_id, {TICKER} AS ticker, field_name, round({_DELTA}, 4) AS delta_pct, {_PATTERN} AS pattern FROM reconciliation_findings WHERE prose_value IS NOT NULL AND field_name IS NOT NULL AND field_name NOT LIKE '%\\_pct' ESCAPE '\\')"


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "reconciliation_findings").where(F.col("prose_value").isNotNull() & F.col("field_name").isNotNull() & ~F.col("field_name").endswith("_pct"))
    p, x = F.col("prose_value"), F.col("xbrl_value")
    return f.select("finding_id", ticker().alias("ticker"), "field_name", F.round(delta_pct(p, x), 4).alias("delta_pct"), pattern(p, x, F.col("rationale")).alias("pattern"))


@query("V12 E10 F8 V26 M14 V27", f"WITH {_FOUND} SELECT *, pattern IN ('unexplained', 'lookup_failed') AS human_review, pattern = 'no_delta' AS matches FROM found")
def reconcile_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each money finding with its delta and pattern; within the tolerance nothing is classified."""
    return reconciled(spark, sf_dir).select("*", F.col("pattern").isin("unexplained", "lookup_failed").alias("human_review"), (F.col("pattern") == "no_delta").alias("matches"))


_LEGIT = "(" + ", ".join(f"'{p}'" for p in LEGITIMATE) + ")"


@query("A12 E27", f"""SELECT {TICKER} AS ticker, count(*) AS total, count(*) FILTER (delta_pattern = 'no_delta') AS matches, count(*) FILTER (delta_pattern IN {_LEGIT} AND delta_pattern <> 'no_delta') AS legitimate,
    count(*) FILTER (human_review_recommended) AS review, count(*) FILTER (delta_pattern = 'lookup_failed') AS failed FROM reconciliation_findings GROUP BY 1""")
def reconciliation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("delta_pattern")
    f = table(spark, sf_dir, "reconciliation_findings")
    return f.groupBy(ticker().alias("ticker")).agg(F.count("*").alias("total"), F.count_if(p == "no_delta").alias("matches"), F.count_if(p.isin(*LEGITIMATE) & (p != "no_delta")).alias("legitimate"), F.count_if(F.col("human_review_recommended")).alias("review"), F.count_if(p == "lookup_failed").alias("failed"))


@query("A12", f"SELECT coalesce(delta_pattern, 'none') AS pattern, coalesce(delta_pattern IN {_LEGIT}, false) AS legitimate, count(*) AS n FROM reconciliation_findings GROUP BY 1, 2")
def pattern_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("delta_pattern")
    return table(spark, sf_dir, "reconciliation_findings").groupBy(F.coalesce(p, F.lit("none")).alias("pattern"), F.coalesce(p.isin(*LEGITIMATE), F.lit(False)).alias("legitimate")).agg(F.count("*").alias("n"))


@query("A16", f"""SELECT ticker, field_name FROM (SELECT ticker, field_name, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, first) AS r FROM
    (SELECT {TICKER} AS ticker, field_name, count(*) AS n, min(finding_id) AS first FROM reconciliation_findings WHERE field_name IS NOT NULL GROUP BY 1, 2)) WHERE r = 1""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest field of each ticker; of equals the one that came first."""
    n = table(spark, sf_dir, "reconciliation_findings").where("field_name is not null").groupBy(ticker().alias("ticker"), "field_name").agg(F.count("*").alias("n"), F.min("finding_id").alias("first"))
    return n.groupBy("ticker").agg(F.max_by("field_name", F.struct("n", -F.col("first"))).alias("field_name"))


# --- scores of the reconciliation ---------------------------------------------------------------------------------------

#: The questions ask for a pattern in their notes; here the patterns take turns over the items.
_ASKED = [*LEGITIMATE[1:], "nonsense"]
_NOTES_SQL = "'k=v; expected_pattern=' || [" + ", ".join(f"'{p}'" for p in _ASKED) + "][CAST(item_id % 6 + 1 AS INTEGER)] || ' ; x=y'"


def expected_pattern(notes: Column) -> Column:
    """What notes of the form a=b; c=d say after expected_pattern=, if it is a legitimate pattern."""
    p = F.trim(F.regexp_extract(notes, r"(?:^|;)\s*expected_pattern=([^;]*)", 1))
    return F.when(p.isin(*LEGITIMATE), p)


def verdict(expected: Column, actual: Column) -> Column:
    return (
        F.when(expected.isNull(), "not_bucket_d").when(actual.isNull(), "no_report").when(actual == "no_delta", "no_delta_when_expected").when(actual == "lookup_failed", "lookup_failed")
        .when(actual == "unexplained", "incorrectly_flagged_unexplained").when(actual == expected, "pattern_match").when(actual.isin(*LEGITIMATE), "pattern_legitimate_alternative").otherwise("incorrectly_flagged_unexplained")
    )


def credit(v: Column) -> Column:
    return F.when(v == "pattern_match", 1.0).when(v == "pattern_legitimate_alternative", 0.5).otherwise(0.0)


_SCORED = f"""
    asked AS (SELECT qid, ticker, field, CASE WHEN trim(regexp_extract(notes, '(?:^|;)\\s*expected_pattern=([^;]*)', 1)) IN {_LEGIT} THEN trim(regexp_extract(notes, '(?:^|;)\\s*expected_pattern=([^;]*)', 1)) END AS expected FROM (SELECT qid, {TICKER} AS ticker, field, {_NOTES_SQL} AS notes FROM eval_items)),
    own AS (SELECT {TICKER} AS ticker, field_name AS field, arg_min(delta_pattern, finding_id) AS own FROM reconciliation_findings WHERE delta_pattern IS NOT NULL GROUP BY 1, 2),
    any AS (SELECT {TICKER} AS ticker, arg_min(delta_pattern, finding_id) AS any FROM reconciliation_findings WHERE delta_pattern IS NOT NULL GROUP BY 1),
    s AS (SELECT qid, expected, coalesce(own, "any") AS actual FROM asked LEFT JOIN own USING (ticker, field) LEFT JOIN "any" USING (ticker)),
    v AS (SELECT *, CASE WHEN expected IS NULL THEN 'not_bucket_d' WHEN actual IS NULL THEN 'no_report' WHEN actual = 'no_delta' THEN 'no_delta_when_expected' WHEN actual = 'lookup_failed' THEN 'lookup_failed'
        WHEN actual = 'unexplained' THEN 'incorrectly_flagged_unexplained' WHEN actual = expected THEN 'pattern_match' WHEN actual IN {_LEGIT} THEN 'pattern_legitimate_alternative' ELSE 'incorrectly_flagged_unexplained' END AS verdict FROM s),
    scored AS (SELECT *, CASE verdict WHEN 'pattern_match' THEN 1.0::DOUBLE WHEN 'pattern_legitimate_alternative' THEN 0.5 ELSE 0 END AS credit FROM v)"""
_SCORED = _SCORED.replace("any AS (SELECT", '"any" AS (SELECT', 1).replace("AS any FROM", 'AS "any" FROM', 1)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding of a question's field, else the ticker's first finding, decides."""
    which = F.element_at(F.array(*map(F.lit, _ASKED)), (F.pmod("item_id", F.lit(6)) + 1).cast("int"))
    q = table(spark, sf_dir, "eval_items").select("qid", ticker().alias("ticker"), "field", expected_pattern(F.concat(F.lit("k=v; expected_pattern="), which, F.lit(" ; x=y"))).alias("expected"))
    f = table(spark, sf_dir, "reconciliation_findings").where("delta_pattern is not null").select(ticker().alias("ticker"), F.col("field_name").alias("field"), "delta_pattern", "finding_id")
    own = f.groupBy("ticker", "field").agg(F.min_by("delta_pattern", "finding_id").alias("own"))
    any_ = f.groupBy("ticker").agg(F.min_by("delta_pattern", "finding_id").alias("any"))
    s = q.join(own, ["ticker", "field"], "left").join(any_, "ticker", "left").select("qid", "expected", F.coalesce("own", "any").alias("actual"))
    return s.withColumn("verdict", verdict(F.col("expected"), F.col("actual"))).withColumn("credit", credit(F.col("verdict")))


@query("V16 J16 E21", f"WITH {_SCORED} SELECT qid, expected, actual, verdict, credit FROM scored")
def bucket_d_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


_KINDS = ("pattern_match", "pattern_legitimate_alternative", "incorrectly_flagged_unexplained", "no_delta_when_expected", "lookup_failed", "no_report")


@query("A13", f"WITH {_SCORED} SELECT count(*) AS n, round(coalesce(sum(credit), 0), 2) AS credit_sum, round(CASE WHEN count(*) > 0 THEN sum(credit) / count(*) * 100 ELSE 0 END, 1) AS accuracy_pct, " + ", ".join(f"count(*) FILTER (verdict = '{k}') AS {k}" for k in _KINDS) + " FROM scored WHERE verdict <> 'not_bucket_d'")
def bucket_d_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).where("verdict <> 'not_bucket_d'")
    n = F.count("*")
    return s.agg(n.alias("n"), F.round(F.coalesce(F.sum("credit"), F.lit(0.0)), 2).alias("credit_sum"), F.round(F.when(n > 0, F.sum("credit") / n * 100).otherwise(0.0), 1).alias("accuracy_pct"), *(F.count_if(F.col("verdict") == k).alias(k) for k in _KINDS))
