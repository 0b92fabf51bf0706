"""What changed between filings of one company."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.functions.text import TICKER
from filings.registry import query
from filings.run import table, ticker

SIMILAR, SAME, LONG = 0.6, 0.85, 50
SEVERITIES = ("critical", "high", "medium", "low")
#: The offline rules of the change classifier: words that make a change of a severity.
RULES = {"critical": r"bankrupt|going concern|default|fraud|restat", "high": r"litigation|lawsuit|regulator|breach|impairment|investigation", "medium": r"risk|tariff|supply|customer|competition|decline"}


@query("W4", f"SELECT ticker, filing_date, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC) AS r FROM (SELECT DISTINCT {TICKER} AS ticker, filing_date FROM filing_sections WHERE filing_date IS NOT NULL)) WHERE r <= 2")
def two_latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "filing_sections").where("filing_date is not null").select(ticker().alias("ticker"), "filing_date").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filing_date")))).where("r <= 2")


@query("W3", f"SELECT ticker, older, newer FROM (SELECT ticker, lag(filing_date) OVER (PARTITION BY ticker ORDER BY filing_date) AS older, filing_date AS newer FROM (SELECT DISTINCT {TICKER} AS ticker, filing_date FROM filing_sections WHERE filing_date IS NOT NULL)) WHERE older IS NOT NULL")
def consecutive_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "filing_sections").where("filing_date is not null").select(ticker().alias("ticker"), "filing_date").distinct()
    w = Window.partitionBy("ticker").orderBy("filing_date")
    return d.select("ticker", F.lag("filing_date").over(w).alias("older"), F.col("filing_date").alias("newer")).where("older is not null")


@query("F3 F1", f"SELECT {TICKER} AS ticker, section_name, count(*) AS sections, CAST(sum(word_count) AS BIGINT) AS words FROM filing_sections WHERE contains(lower(section_name), 'risk') OR contains(lower(section_name), 'state') GROUP BY 1, 2")
def sections_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose name holds a text, whatever its case."""
    low = F.lower("section_name")
    s = table(spark, sf_dir, "filing_sections").where(low.contains("risk") | low.contains("state"))
    return s.groupBy(ticker().alias("ticker"), "section_name").agg(F.count("*").alias("sections"), F.sum("word_count").alias("words"))


def ratio(a: str, b: str, floor: float) -> float:
    """The matching-blocks ratio, or 0 if it can't exceed floor; its two upper bounds spare most comparisons."""
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() > floor and m.quick_ratio() > floor else 0.0


def diff(old: list[str], new: list[str]) -> Iterator[tuple[str, int, int, float]]:
    """(change_type, old index or -1, new index or -1, score): each new paragraph takes the likest old one that is left, in order; the first of equals."""
    left: dict[int, str] = dict(enumerate(old))
    where: dict[str, list[int]] = {}
    for i, t in enumerate(old):
        where.setdefault(t, []).append(i)
    for n, t in enumerate(new):
        best, at = 0.0, -1
        if same := [i for i in where.get(t, ()) if i in left]:
            best, at = 1.0, same[0]
        else:
            for i, o in left.items():
                if (r := ratio(o, t, max(best, 1e-12))) > best:
                    best, at = r, i
        if best >= SIMILAR:
            del left[at]
        if best < SAME:
            yield ("modified", at, n, best) if best >= SIMILAR else ("added", -1, n, 0.0)
    for i in left:
        yield "removed", i, -1, 0.0


def severity(c: Column) -> Column:
    out = F.lit("low")
    for k, sign in reversed(RULES.items()):
        out = F.when(F.lower(c).rlike(sign), k).otherwise(out)
    return out


def filing_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, change_type, section_name, old_text, new_text, similarity, severity) between each company's two latest dates; all changes are kept and classified.

    A group holds two filings of one company, not all that a company filed.
    """
    dates = two_latest_dates(spark, sf_dir)
    s = table(spark, sf_dir, "filing_sections").where("content is not null").select(ticker().alias("ticker"), "filing_date", "section_id", "section_name", "content").join(dates, ["ticker", "filing_date"])
    p = s.select("ticker", "r", "section_id", "section_name", F.posexplode(F.split("content", "\n\n")).alias("pos", "t")).withColumn("text", T.strip(F.col("t"))).where(F.length("text") > LONG).select("ticker", "r", "section_id", "section_name", "pos", "text")
    schema = "ticker string, change_type string, section_name string, old_text string, new_text string, similarity double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["section_id", "pos"])
        new, old = pdf[pdf.r == 1], pdf[pdf.r == 2]
        out = []
        for kind, i, n, score in diff(old.text.tolist(), new.text.tolist()) if len(old) else ():
            out.append((pdf.ticker.iloc[0], kind, (new.section_name.iloc[n] if n >= 0 else old.section_name.iloc[i]), old.text.iloc[i] if i >= 0 else None, new.text.iloc[n] if n >= 0 else None, round(score, 3) if kind == "modified" else None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return p.groupBy("ticker").applyInPandas(one, schema).withColumn("severity", severity(F.coalesce("new_text", "old_text")))


@query("J12 E23 X7 V18 M10 J13")
def paragraph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing_diff(spark, sf_dir)


SPAN = 1 << 16  # ids that are numbered in one task


def numbered(df: DataFrame, keys: list[str], parts: list, order: str) -> DataFrame:
    """df with r, the place from 1 of each row of its group by parts and order. Only a part is ever sorted in one task: what is before it comes from the counts of the parts."""
    names = [f"_p{k}" for k in range(len(parts))]
    d = df.withColumns({n: F.col(p) if isinstance(p, str) else p for n, p in zip(names, parts)})
    counts = d.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy(*names)) - F.col("_n")).drop("_n")
    own = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(order)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *names)]
    j = own.alias("a").join(before.alias("b"), same)
    return j.select("a.*", (F.col("b._before") + F.col("a._r")).cast("int").alias("r")).drop(*names, "_r")


_KIND = "CASE WHEN regexp_matches(lower(trim(change_type)), '^(add|new)') THEN 'added' WHEN regexp_matches(lower(trim(change_type)), '^(rem|del)') THEN 'removed' WHEN regexp_matches(lower(trim(change_type)), '^(mod|cha|upd|edit)') THEN 'modified' ELSE 'unknown' END"


def kind_of(c: str = "change_type") -> Column:
    k = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(k.rlike("^(add|new)"), "added").when(k.rlike("^(rem|del)"), "removed").when(k.rlike("^(mod|cha|upd|edit)"), "modified").otherwise("unknown")


@query("A14", f"SELECT upper(trim(ticker)) AS ticker, {', '.join(f'''count(*) FILTER (k = '{k}') AS {k}''' for k in ('added', 'removed', 'modified', 'unknown'))}, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM (SELECT *, {_KIND} AS k FROM filing_changes) GROUP BY 1")
def change_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all logged changes of a ticker, in whatever spelling their type is."""
    c = table(spark, sf_dir, "filing_changes").withColumn("k", kind_of())
    return c.groupBy(ticker().alias("ticker")).agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("added", "removed", "modified", "unknown")), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))


_ORDER = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query("W8 W9", f"SELECT change_id, ticker, severity, CAST(r AS INTEGER) AS r FROM (SELECT change_id, upper(trim(ticker)) AS ticker, severity, row_number() OVER (PARTITION BY upper(trim(ticker)) ORDER BY {_ORDER}, change_id) AS r FROM filing_changes)")
def severity_sorted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's changes from critical to low, others last, otherwise as logged."""
    s = F.lower("severity")
    order = F.when(s == "critical", 0).when(s == "high", 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)
    c = table(spark, sf_dir, "filing_changes").select("change_id", ticker().alias("ticker"), "severity", order.alias("o"))
    return numbered(c, ["ticker"], ["o", F.floor(F.col("change_id") / SPAN)], "change_id").select("change_id", "ticker", "severity", "r")


_SEVERITY = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{k}'" for k, p in RULES.items()) + " ELSE 'low' END"


@query("M10", f"SELECT change_id, {_SEVERITY} AS severity FROM (SELECT change_id, coalesce(new_text, old_text, '') AS t FROM filing_changes)")
def change_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' severity of each logged change."""
    return table(spark, sf_dir, "filing_changes").select("change_id", severity(F.coalesce("new_text", "old_text", F.lit(""))).alias("severity"))
