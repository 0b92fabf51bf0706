"""The index of tagged facts, lookups in it, and what a filing may know of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.text import TICKER
from filings.registry import query
from filings.run import table, ticker
from filings.sources.submissions import listed

#: The tags of each field.
TAGS = {
    "Revenues": "revenue", "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue", "RevenueFromContractWithCustomerIncludingAssessedTax": "revenue", "SalesRevenueNet": "revenue",
    "CostOfRevenue": "cogs", "CostOfGoodsAndServicesSold": "cogs", "CostOfGoodsSold": "cogs",
    "GrossProfit": "gross_profit", "OperatingIncomeLoss": "operating_income", "NetIncomeLoss": "net_income", "ProfitLoss": "net_income",
}
FORMS = ("10-K", "10-Q")
QUARTER, YEAR = (80, 100), (350, 380)  # days, both included
LAG = 90  # days from a period's end to its filing
FIELD_WORDS = {"revenue": "total revenue", "cogs": "cost of revenue", "net_income": "net income"}
_TAGS_SQL = "(VALUES " + ", ".join(f"('{t}', '{f}')" for t, f in TAGS.items()) + ") AS tags(xbrl_tag, mapped)"


def tagged(c: str = "xbrl_tag") -> Column:
    """The field of a tag, or null."""
    return F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[F.col(c)]


def period(form: str = "form", fp: str = "fiscal_period") -> Column:
    p = F.trim(F.upper(F.coalesce(fp, F.lit(""))))
    return F.when(p.isin("FY", "Q1", "Q2", "Q3"), p).when((F.col(form) == "10-K") & (p == "Q4"), "Q4").when(F.col(form) == "10-K", "FY").otherwise(F.when(p == "", "?").otherwise(p))


_PERIOD = "CASE WHEN p IN ('FY', 'Q1', 'Q2', 'Q3') THEN p WHEN form = '10-K' AND p = 'Q4' THEN 'Q4' WHEN form = '10-K' THEN 'FY' WHEN p = '' THEN '?' ELSE p END"


def long_enough(p: Column, days: Column) -> Column:
    """Quarters and years must have their length; a missing length is 0 days. Other periods may have any."""
    d = F.coalesce(days, F.lit(0))
    return F.when(p.startswith("Q"), d.between(*QUARTER)).when(p == "FY", d.between(*YEAR)).otherwise(True)


_LONG = "CASE WHEN period LIKE 'Q%' THEN coalesce(duration_days, 0) BETWEEN 80 AND 100 WHEN period = 'FY' THEN coalesce(duration_days, 0) BETWEEN 350 AND 380 ELSE true END"


def in_millions(value: Column, unit: Column) -> Column:
    """USD millions to one decimal; null for other units. Of facts whose unit is spelled in other ways see problem 7."""
    u = F.lower(unit)
    return F.round(F.when(u == "usd", value / 1e6).when(u == "usd_millions", value), 1)


_MILLIONS = "round(CASE lower(unit) WHEN 'usd' THEN value_usd_millions / 1e6 WHEN 'usd_millions' THEN value_usd_millions END, 1)"
_INDEX = f"""
    usable AS (SELECT fact_id, {TICKER} AS ticker, mapped AS field, period_end, {_PERIOD} AS period, fiscal_year, {_MILLIONS} AS value, form, xbrl_tag, duration_days FROM (SELECT *, trim(upper(coalesce(fiscal_period, ''))) AS p FROM xbrl_facts) JOIN {_TAGS_SQL} USING (xbrl_tag)
        WHERE form IN ('10-K', '10-Q') AND fiscal_year IS NOT NULL AND period_end IS NOT NULL),
    idx AS (SELECT * EXCLUDE (r, duration_days) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, field, period_end, period, fiscal_year ORDER BY fact_id) AS r FROM usable WHERE value IS NOT NULL AND {_LONG}) WHERE r = 1)"""
_KEY = ["ticker", "field", "period_end", "period", "fiscal_year"]


def index(facts: DataFrame) -> DataFrame:
    """One fact for each key: the first that was delivered. Minimum by partial aggregation, so a much-reported key is no hot spot."""
    f = facts.withColumn("field", tagged()).where(F.col("form").isin(*FORMS) & F.col("field").isNotNull() & F.col("fiscal_year").isNotNull() & F.col("period_end").isNotNull())
    f = f.select("fact_id", ticker().alias("ticker"), "field", "period_end", period().alias("period"), "fiscal_year", in_millions(F.col("value_usd_millions"), F.col("unit")).alias("value"), "form", "xbrl_tag", "duration_days")
    f = f.where(F.col("value").isNotNull() & long_enough(F.col("period"), F.col("duration_days")))
    return f.groupBy(*_KEY).agg(F.min(F.struct("fact_id", "value", "form", "xbrl_tag")).alias("x")).select(*_KEY, "x.*")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(table(spark, sf_dir, "xbrl_facts"))


@query("V13 A20 F4 E11 E12 J1 S3", f"WITH {_INDEX} SELECT ticker, field, period_end, period, fiscal_year, fact_id, value, form, xbrl_tag FROM idx")
def xbrl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query("F5 E13", f"""SELECT fact_id, CAST(date_diff('day', start, CAST(period_end AS DATE)) AS INTEGER) AS days, {_LONG} AS passes
    FROM (SELECT *, CAST(period_end AS DATE) - duration_days AS start, {_PERIOD} AS period FROM (SELECT *, trim(upper(coalesce(fiscal_period, ''))) AS p FROM xbrl_facts))""")
def period_duration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "xbrl_facts").withColumn("end", F.try_to_date("period_end")).withColumn("start", F.date_sub("end", F.col("duration_days")))
    return f.select("fact_id", F.date_diff("end", "start").alias("days"), long_enough(period(), F.col("duration_days")).alias("passes"))


_CUT = f"cutoff AS (SELECT {TICKER} AS ticker, CAST(max(CAST(filing_date AS DATE)) - 90 AS DATE) AS cutoff FROM filing_sections GROUP BY 1)"


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last period end that a ticker's filings can know of."""
    return table(spark, sf_dir, "filing_sections").groupBy(ticker().alias("ticker")).agg(F.date_sub(F.max(F.try_to_date("filing_date")), LAG).alias("cutoff"))


@query("F6 E14", f"WITH {_INDEX}, {_CUT} SELECT ticker, cutoff, count(*) FILTER (CAST(period_end AS DATE) <= cutoff) AS known, count(*) FILTER (CAST(period_end AS DATE) > cutoff) AS gated FROM idx JOIN cutoff USING (ticker) GROUP BY ticker, cutoff")
def availability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.try_to_date("period_end")
    return _index(spark, sf_dir).join(cutoffs(spark, sf_dir), "ticker").groupBy("ticker", "cutoff").agg(F.count_if(end <= F.col("cutoff")).alias("known"), F.count_if(end > F.col("cutoff")).alias("gated"))


def latest(idx: DataFrame) -> DataFrame:
    """(ticker, field, latest): each field's last quarter, Q1 to Q3."""
    return idx.where(F.col("period").isin("Q1", "Q2", "Q3")).groupBy("ticker", "field").agg(F.max_by(F.struct("period_end", "value", "xbrl_tag"), F.struct("period_end", -F.col("fact_id"))).alias("latest"))


@query("J3 W6 F9 V25", f"""
    WITH {_INDEX},
    exact AS (SELECT ticker, field, period_end, arg_min(value, fact_id) AS value FROM idx GROUP BY ALL),
    last AS (SELECT ticker, field, value, period_end FROM (SELECT *, row_number() OVER (PARTITION BY ticker, field ORDER BY period_end DESC, fact_id) AS r FROM idx WHERE period IN ('Q1', 'Q2', 'Q3')) WHERE r = 1)
    SELECT finding_id, CASE WHEN e.value IS NOT NULL THEN 'exact' WHEN l.value IS NOT NULL THEN 'latest' ELSE 'none' END AS found, coalesce(e.value, l.value) AS value, CASE WHEN e.value IS NOT NULL THEN f.xbrl_period_end ELSE l.period_end END AS period_end
    FROM (SELECT *, {TICKER} AS t FROM reconciliation_findings) f LEFT JOIN exact e ON e.ticker = f.t AND e.field = f.field_name AND e.period_end = f.xbrl_period_end LEFT JOIN last l ON l.ticker = f.t AND l.field = f.field_name""")
def latest_fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's tagged fact: that of its period, else of the latest quarter. Unknown tickers find nothing."""
    idx = _index(spark, sf_dir)
    exact = idx.groupBy("ticker", F.col("field").alias("field_name"), F.col("period_end").alias("xbrl_period_end")).agg(F.min_by("value", "fact_id").alias("e"))
    f = table(spark, sf_dir, "reconciliation_findings").select("finding_id", ticker().alias("ticker"), "field_name", "xbrl_period_end")
    j = f.join(exact, ["ticker", "field_name", "xbrl_period_end"], "left").join(latest(idx).withColumnRenamed("field", "field_name"), ["ticker", "field_name"], "left")
    found = F.when(F.col("e").isNotNull(), "exact").when(F.col("latest.value").isNotNull(), "latest").otherwise("none")
    return j.select("finding_id", found.alias("found"), F.coalesce("e", "latest.value").alias("value"), F.when(F.col("e").isNotNull(), F.col("xbrl_period_end")).otherwise(F.col("latest.period_end")).alias("period_end"))


_NTH = "nth AS (SELECT ticker, period_end FROM (SELECT ticker, period_end, dense_rank() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS r FROM (SELECT DISTINCT ticker, period_end FROM idx WHERE field = 'revenue' AND period IN ('Q1', 'Q2', 'Q3'))) WHERE r = 5)"


def nth(idx: DataFrame, n: int = 5) -> DataFrame:
    d = idx.where((F.col("field") == "revenue") & F.col("period").isin("Q1", "Q2", "Q3")).select("ticker", "period_end").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period_end")))).where(F.col("r") == n).drop("r")


@query("W5", f"WITH {_INDEX}, {_NTH} SELECT * FROM nth")
def nth_latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth latest quarter of revenue; distinct periods are counted."""
    return nth(_index(spark, sf_dir))


@query("A24", f"""WITH {_INDEX}, m AS (SELECT *, max(fiscal_year) OVER (PARTITION BY ticker, period) AS y FROM idx)
    SELECT ticker, period, fiscal_year, field, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period, field ORDER BY fact_id DESC) AS r FROM m WHERE fiscal_year = y) WHERE r = 1""")
def latest_period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ticker and kind of period the last fiscal year's facts, the last one of each field."""
    idx = _index(spark, sf_dir)
    years = idx.groupBy("ticker", "period").agg(F.max("fiscal_year").alias("fiscal_year"))
    return idx.join(years, ["ticker", "period", "fiscal_year"]).groupBy("ticker", "period", "fiscal_year", "field").agg(F.max_by("value", "fact_id").alias("value"))


_WORDS = "CASE field WHEN 'revenue' THEN 'total revenue' WHEN 'cogs' THEN 'cost of revenue' WHEN 'net_income' THEN 'net income' END"
_QUESTIONS = f"""{_INDEX}, {_CUT}, {_NTH},
    recent AS (SELECT ticker, max(period_end) AS period_end FROM idx JOIN cutoff USING (ticker) WHERE period IN ('Q1', 'Q2', 'Q3') AND CAST(period_end AS DATE) <= cutoff GROUP BY ticker),
    one AS (SELECT ticker, field, period_end, arg_min(value, fact_id) AS value FROM idx WHERE period IN ('Q1', 'Q2', 'Q3') GROUP BY ALL),
    questions AS (
        SELECT 'A_' || ticker || '_' || field AS qid, 'A_clean' AS bucket, ticker, field, 'What was the most recent quarterly ' || {_WORDS} || ' of ' || ticker || '?' AS text, value AS expected FROM recent JOIN one USING (ticker, period_end) WHERE field IN ('revenue', 'cogs', 'net_income')
        UNION ALL SELECT 'B_' || ticker || '_' || field || '_' || period_end, 'B_period', ticker, field, 'What was the ' || {_WORDS} || ' of ' || ticker || ' for the quarter ending ' || strftime(CAST(period_end AS DATE), '%B %d, %Y') || '?', value FROM nth JOIN one USING (ticker, period_end) WHERE field IN ('revenue', 'cogs'))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = _index(spark, sf_dir)
    quarters = idx.where(F.col("period").isin("Q1", "Q2", "Q3"))
    one = quarters.groupBy("ticker", "field", "period_end").agg(F.min_by("value", "fact_id").alias("value"))
    recent = quarters.join(cutoffs(spark, sf_dir), "ticker").where(F.try_to_date("period_end") <= F.col("cutoff")).groupBy("ticker").agg(F.max("period_end").alias("period_end"))
    words = F.create_map(*[F.lit(x) for kv in FIELD_WORDS.items() for x in kv])[F.col("field")]
    a = recent.join(one, ["ticker", "period_end"]).where(F.col("field").isin("revenue", "cogs", "net_income"))
    b = nth(idx).join(one, ["ticker", "period_end"]).where(F.col("field").isin("revenue", "cogs"))
    day = F.date_format(F.try_to_date("period_end"), "MMMM dd, yyyy")
    a = a.select(F.concat_ws("_", F.lit("A"), "ticker", "field").alias("qid"), F.lit("A_clean").alias("bucket"), "ticker", "field", F.concat(F.lit("What was the most recent quarterly "), words, F.lit(" of "), "ticker", F.lit("?")).alias("text"), F.col("value").alias("expected"))
    b = b.select(F.concat_ws("_", F.lit("B"), "ticker", "field", "period_end").alias("qid"), F.lit("B_period").alias("bucket"), "ticker", "field", F.concat(F.lit("What was the "), words, F.lit(" of "), "ticker", F.lit(" for the quarter ending "), day, F.lit("?")).alias("text"), F.col("value").alias("expected"))
    return a.unionAll(b)


@query("V17 J15 E15 X1 S6", f"WITH {_QUESTIONS} SELECT * FROM questions")
def question_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from the index: the most recent quarter that the filings can know, and the fifth latest one."""
    return questions(spark, sf_dir)


@query("A19", f"WITH {_QUESTIONS} SELECT bucket, count(*) AS n FROM questions GROUP BY bucket UNION ALL SELECT bucket, count(*) FROM eval_items GROUP BY bucket")
def questions_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda d: d.groupBy("bucket").agg(F.count("*").alias("n"))
    return one(questions(spark, sf_dir)).unionAll(one(table(spark, sf_dir, "eval_items")))


@query("J2 E24 A18 S1", f"""
    SELECT DISTINCT {TICKER} AS ticker, lpad(ltrim(cik, '0'), 10, '0') AS cik, accession_number, replace(accession_number, '-', '') AS bare, 'data/' || ltrim(cik, '0') || '/' || replace(accession_number, '-', '') AS path
    FROM filing_sections WHERE cik IS NOT NULL AND accession_number IS NOT NULL""")
def company_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers with their padded numbers and the paths of their filings."""
    s = table(spark, sf_dir, "filing_sections").where("cik is not null and accession_number is not null")
    bare, cik = F.replace("accession_number", F.lit("-"), F.lit("")), F.regexp_replace("cik", "^0+", "")
    return s.select(ticker().alias("ticker"), F.lpad(cik, 10, "0").alias("cik"), "accession_number", bare.alias("bare"), F.concat(F.lit("data/"), cik, F.lit("/"), bare).alias("path")).distinct()


@query("S1 F1 F2", f"""
    SELECT ticker, accession_number, filing_date, CAST(r AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession_number) - 1 AS r FROM
        (SELECT DISTINCT {TICKER} AS ticker, accession_number, filing_date FROM filing_sections WHERE filing_type = '10-K' AND section_name IN ('risk_factors', 'mda'))) WHERE r < 4""")
def filings_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest four annual reports of each ticker, read from parallel arrays as a listing delivers them."""
    s = table(spark, sf_dir, "filing_sections").where(F.col("section_name").isin("risk_factors", "mda")).select(ticker().alias("ticker"), "accession_number", "filing_date", "filing_type").distinct()
    one = s.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("filing_date", "accession_number", "filing_type")), lambda a, b: F.when(a["filing_date"] > b["filing_date"], -1).when(a["filing_date"] < b["filing_date"], 1).when(a["accession_number"] < b["accession_number"], -1).otherwise(1)).alias("l"))
    listing = one.select("ticker", "l.filing_date", "l.accession_number", "l.filing_type")
    return listed(listing, "ticker", "10-K", 4)
