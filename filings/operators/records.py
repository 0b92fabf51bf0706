"""Records as they are stored: filings and logs as JSON, signals as CSV, reports as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.operators import scoring
from filings.registry import query
from filings.run import table, ticker

SECTION = "section_id long, company string, ticker string, cik string, filing_type string, filing_date string, accession_number string, section_name string, section_title string, content string, word_count long, url string"
FILING = f"array<struct<accession_number: string, total_words: long, sections: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SECTION.split(', '))}>>>>"
_NAMES = [x.split()[0] for x in SECTION.split(", ")]


def as_filings(sections: DataFrame) -> DataFrame:
    """(ticker, accession_number, json): each filing as a JSON array of one, with its sections nested in it. A group is a filing, never all that a ticker filed."""
    one = sections.groupBy(ticker().alias("t"), "accession_number").agg(F.sum("word_count").alias("total_words"), F.collect_list(F.struct(*_NAMES)).alias("sections"))
    return one.select(F.col("t").alias("ticker"), "accession_number", F.to_json(F.array(F.struct("accession_number", "total_words", "sections"))).alias("json"))


def from_filings(json: DataFrame) -> DataFrame:
    """The sections of JSON filings."""
    return json.select(F.explode(F.from_json("json", FILING)).alias("f")).select(F.explode("f.sections").alias("s")).select("s.*")


@query("S4 S5", f"SELECT section_id, {T.TICKER} AS ticker, accession_number, section_name, CAST(length(content) AS INTEGER) AS n FROM filing_sections")
def sections_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written as the sink writes them and scanned again."""
    back = from_filings(as_filings(table(spark, sf_dir, "filing_sections")))
    return back.select("section_id", ticker().alias("ticker"), "accession_number", "section_name", F.length("content").alias("n"))


@query("S7 S8 S10 V24", "SELECT event_id AS line, user_id AS qid, event_type AS verdict, value AS latency FROM events WHERE event_id % 9 <> 4")
def run_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines read back; blank lines and lines that aren't JSON (each ninth here) are passed over."""
    json = F.to_json(F.struct(F.col("event_id").alias("line"), F.col("user_id").alias("qid"), F.col("event_type").alias("verdict"), F.col("value").alias("latency")))
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 == 4, F.when(F.col("event_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("{broken "), json))).otherwise(json).alias("value"))
    x = F.from_json("value", "line long, qid long, verdict string, latency double, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.where(F.trim("value") != "").select(x.alias("x")).where("x is not null and x._bad is null").select("x.line", "x.qid", "x.verdict", "x.latency")


@query("S9", "SELECT change_id, upper(trim(ticker)) AS ticker, severity, category FROM filing_changes WHERE severity <> '' AND category <> ''")
def signals_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV lines and parsed again."""
    c = table(spark, sf_dir, "filing_changes").where("severity <> '' and category <> ''").select(F.to_csv(F.struct("change_id", ticker().alias("ticker"), "severity", "category")).alias("line"))
    return c.select(F.from_csv("line", "change_id long, ticker string, severity string, category string").alias("x")).select("x.*")


@query("V19 V29", f"""WITH {scoring._LOG}, r AS (SELECT pipeline, bucket, count(*) AS n, count(*) FILTER (is_pass) AS k FROM runs GROUP BY 1, 2)
    SELECT pipeline, string_agg('b' || bucket || ' ' || k || '/' || n, ' | ' ORDER BY bucket) AS line FROM r GROUP BY pipeline""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's grid: one line for each pipeline, with what passed in each bucket."""
    r = scoring.last_runs(scoring.log(spark, sf_dir)).groupBy("pipeline", "bucket").agg(F.count("*").alias("n"), F.count_if("is_pass").alias("k"))
    cell = F.concat(F.lit("b"), "bucket", F.lit(" "), "k", F.lit("/"), "n")
    return r.groupBy("pipeline").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", cell.alias("c")))), lambda x: x["c"]), " | ").alias("line"))
