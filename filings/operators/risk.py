"""Risk signals by the offline keyword rules, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.text import TICKER
from filings.registry import query
from filings.run import table, ticker

#: Keywords of the six categories.
KEYWORDS = {
    "litigation": ("lawsuit", "litigation", "legal proceedings", "settlement", "plaintiff", "defendant"),
    "regulatory": ("regulation", "regulatory", "compliance", "sec", "ftc", "antitrust", "consent decree"),
    "supply_chain": ("supply chain", "supplier", "shortage", "logistics", "procurement", "inventory"),
    "macroeconomic": ("inflation", "interest rate", "recession", "economic downturn", "currency", "tariff"),
    "cybersecurity": ("cybersecurity", "data breach", "ransomware", "unauthorized access", "security incident"),
    "competitive": ("competition", "market share", "competitive pressure", "pricing pressure", "disruption"),
}
RANKS = ("low", "medium", "high")
EVIDENCE = 200
_HITS = {k: " + ".join(f"CAST(contains(lower(content), '{w}') AS INT)" for w in ws) for k, ws in KEYWORDS.items()}
_RANK = "CASE WHEN hits >= 3 THEN 'high' WHEN hits = 2 THEN 'medium' ELSE 'low' END"
_SIGNALS = "signals AS (" + " UNION ALL ".join(f"SELECT section_id, {TICKER} AS ticker, filing_date, '{k}' AS category, {h} AS hits, content[1:{EVIDENCE}] AS evidence FROM filing_sections WHERE section_name = 'risk_factors' AND content IS NOT NULL AND {h} > 0" for k, h in _HITS.items()) + ")"


def signals(sections: DataFrame) -> DataFrame:
    """(section_id, ticker, filing_date, category, hits, severity, evidence) of the risk sections: how many of a category's keywords are there."""
    low = F.lower("content")

    def hits(words: tuple[str, ...]):
        out = F.lit(0)
        for w in words:
            out = out + low.contains(w).cast("int")
        return out

    all_ = F.array(*(F.struct(F.lit(k).alias("category"), hits(ws).alias("hits")) for k, ws in KEYWORDS.items()))
    s = sections.where((F.col("section_name") == "risk_factors") & F.col("content").isNotNull())
    s = s.select("section_id", ticker().alias("ticker"), "filing_date", F.substring("content", 1, EVIDENCE).alias("evidence"), F.explode(F.filter(all_, lambda x: x["hits"] > 0)).alias("x"))
    return s.select("section_id", "ticker", "filing_date", "x.category", "x.hits", F.when(F.col("x.hits") >= 3, "high").when(F.col("x.hits") == 2, "medium").otherwise("low").alias("severity"), "evidence")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(table(spark, sf_dir, "filing_sections"))


@query("M4 F2 F11 S9", f"WITH {_SIGNALS} SELECT section_id, ticker, filing_date, category, hits, {_RANK} AS severity, evidence FROM signals")
def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query("A17", f"WITH {_SIGNALS} SELECT category, {_RANK} AS severity, count(*) AS n FROM signals GROUP BY 1, 2")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("n"))


_LEVEL = "max(CASE WHEN hits >= 3 THEN 3 WHEN hits = 2 THEN 2 ELSE 1 END)"
_PROFILE = f"{_SIGNALS}, profile AS (SELECT ticker, filing_date, category, {_LEVEL} AS level FROM signals WHERE filing_date IS NOT NULL GROUP BY 1, 2, 3), latest AS (SELECT ticker, max(filing_date) AS filing_date FROM profile GROUP BY 1), own AS (SELECT * FROM profile JOIN latest USING (ticker, filing_date))"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, filing_date, category, level 1 to 3)."""
    return _signals(spark, sf_dir).where("filing_date is not null").groupBy("ticker", "filing_date", "category").agg(F.max(F.when(F.col("hits") >= 3, 3).when(F.col("hits") == 2, 2).otherwise(1)).alias("level"))


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir)
    return p.join(p.groupBy("ticker").agg(F.max("filing_date").alias("filing_date")), ["ticker", "filing_date"])


@query("M5 W2", f"WITH {_PROFILE} SELECT ticker, filing_date, count(*) AS categories, CAST(sum(level) AS BIGINT) AS risk, string_agg(category, ', ' ORDER BY category) AS names FROM own GROUP BY 1, 2")
def risk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's latest filing with signals."""
    return _own(spark, sf_dir).groupBy("ticker", "filing_date").agg(F.count("*").alias("categories"), F.sum("level").cast("long").alias("risk"), F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("names"))


@query("X8 M6", f"""WITH {_PROFILE}, t AS (SELECT ticker AS a, lead(ticker) OVER (ORDER BY ticker) AS b FROM (SELECT DISTINCT ticker FROM own)),
    x AS (SELECT a, b, category, level FROM t JOIN own ON ticker = a), y AS (SELECT a, b, category, level FROM t JOIN own ON ticker = b)
    SELECT coalesce(x.a, y.a) AS ticker_a, coalesce(x.b, y.b) AS ticker_b, coalesce(x.category, y.category) AS category, CASE WHEN y.a IS NULL THEN 'only_a' WHEN x.a IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM (SELECT * FROM x WHERE b IS NOT NULL) x FULL JOIN y ON x.a = y.a AND x.category = y.category""")
def shared_unique_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring companies (by ticker) compared: categories that both, or only one of them, reports."""
    own = _own(spark, sf_dir).select("ticker", "category")
    # The tickers alone are ordered: few rows, whatever the filings are.
    t = own.select("ticker").distinct().select(F.col("ticker").alias("ticker_a"), F.lead("ticker").over(Window.orderBy("ticker")).alias("ticker_b")).where("ticker_b is not null")
    x = t.join(own.withColumnRenamed("ticker", "ticker_a"), "ticker_a").withColumn("a", F.lit(True))
    y = t.join(own.withColumnRenamed("ticker", "ticker_b"), "ticker_b").withColumn("b", F.lit(True))
    j = x.join(y, ["ticker_a", "ticker_b", "category"], "full_outer")
    return j.select("ticker_a", "ticker_b", "category", F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("shared").alias("side"))


@query("X9 M7 W3", f"""WITH {_PROFILE}, d AS (SELECT ticker, filing_date AS newer, lag(filing_date) OVER (PARTITION BY ticker ORDER BY filing_date) AS older FROM (SELECT DISTINCT ticker, filing_date FROM profile)),
    o AS (SELECT ticker, newer, category, level FROM d JOIN profile USING (ticker) WHERE filing_date = older), n AS (SELECT ticker, newer, category, level FROM d JOIN profile USING (ticker) WHERE filing_date = newer AND older IS NOT NULL)
    SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.newer, n.newer) AS filing_date, coalesce(o.category, n.category) AS category, CASE WHEN o.level IS NULL THEN 'new' WHEN n.level IS NULL THEN 'removed' WHEN n.level > o.level THEN 'escalated' WHEN n.level < o.level THEN 'deescalated' ELSE 'same' END AS change
    FROM o FULL JOIN n ON o.ticker = n.ticker AND o.newer = n.newer AND o.category = n.category""")
def consecutive_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a company's risks did from each filing date to the next."""
    p = profiles(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("filing_date")
    d = p.select("ticker", "filing_date").distinct().select("ticker", F.col("filing_date").alias("newer"), F.lag("filing_date").over(w).alias("older")).where("older is not null")
    o = d.join(p.withColumnRenamed("filing_date", "older"), ["ticker", "older"]).select("ticker", "newer", "category", F.col("level").alias("o"))
    n = d.join(p.withColumnRenamed("filing_date", "newer"), ["ticker", "newer"]).select("ticker", "newer", "category", F.col("level").alias("n"))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(F.col("n") > F.col("o"), "escalated").when(F.col("n") < F.col("o"), "deescalated").otherwise("same")
    return o.join(n, ["ticker", "newer", "category"], "full_outer").select("ticker", F.col("newer").alias("filing_date"), "category", change.alias("change"))
