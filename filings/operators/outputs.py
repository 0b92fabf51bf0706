"""What models return: lenient JSON, checked classifier outputs, extraction and answers by the offline rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.operators import provenance as P
from filings.operators import retrieval as R
from filings.operators.reconciliation import PATTERNS
from filings.registry import SQL, query
from filings.run import table, ticker

#: In order, within the outermost object: curly quotes, commas before a closing bracket, Python's names, digits parted by underscores.
_REPAIRS = [("[“”]", '"'), (r",\s*([}\]])", "$1"), (r":\s*True\b", ": true"), (r":\s*False\b", ": false"), (r":\s*None\b", ": null"), (r"([0-9])_([0-9])", "$1$2")]
_OBJECT = r"(?s)(\{.*\})"


def repaired(c: Column) -> Column:
    c = F.regexp_extract(c, _OBJECT, 1)
    for p, to in _REPAIRS:
        c = F.regexp_replace(c, p, to)
    return c


def sql_repaired(c: str) -> str:
    c = f"regexp_extract({c}, '{_OBJECT}', 1)"
    for p, to in _REPAIRS:
        c = f"regexp_replace({c}, '{p}', '{to.replace('$', chr(92))}', 'g')"
    return c


#: A log's JSON as models tend to return it.
_RAW = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || replace(props, '}', ', "ok": True, }') || ' Done.' ELSE replace(replace(props, '"', chr(8220)), '}', ', "n": 95_359}') END"""


@query("E17 E18 E19", f"SELECT event_id, CAST(json_extract({sql_repaired(_RAW)}, '$.k') AS BIGINT) AS k, CAST(json_extract({sql_repaired(_RAW)}, '$.n') AS BIGINT) AS n FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, chatty and sloppy JSON, read after repair; what still is none gives nulls."""
    p, m = F.col("props"), F.col("event_id") % 4
    raw = F.when(m == 0, p).when(m == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), F.replace(p, F.lit("}"), F.lit(', "ok": True, }')), F.lit(" Done."))).otherwise(F.replace(F.replace(p, F.lit('"'), F.lit("“")), F.lit("}"), F.lit(', "n": 95_359}')))
    x = F.from_json(repaired(raw), "k long, n long")
    return table(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), x["n"].alias("n"))


_NAMES = "(" + ", ".join(f"'{p}'" for p in PATTERNS) + ")"


@query("E20 E16", f"SELECT finding_id, CASE WHEN delta_pattern IN {_NAMES} AND finding_id % 7 <> 0 THEN delta_pattern ELSE 'unexplained' END AS pattern, CASE WHEN delta_pattern IN {_NAMES} AND finding_id % 7 <> 0 THEN coalesce(nullif(trim(coalesce(rationale, ''))[1:240], ''), 'no rationale provided') ELSE 'unrecognized pattern' END AS rationale FROM reconciliation_findings")
def classifier_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as a classifier's JSON (every seventh with a pattern that there isn't) and parsed: unknown patterns are unexplained, rationales at most 240 characters."""
    name = F.when(F.col("finding_id") % 7 == 0, "other").otherwise(F.col("delta_pattern"))
    f = table(spark, sf_dir, "reconciliation_findings").select("finding_id", F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(name.alias("pattern"), "rationale")), F.lit("\n```")).alias("raw"))
    x = f.select("finding_id", F.from_json(repaired(F.col("raw")), "pattern string, rationale string").alias("x"))
    known = F.coalesce(F.col("x.pattern").isin(*PATTERNS), F.lit(False))
    why = F.substring(F.trim(F.coalesce("x.rationale", F.lit(""))), 1, 240)
    return x.select("finding_id", F.when(known, F.col("x.pattern")).otherwise("unexplained").alias("pattern"), F.when(known, F.when(why == "", "no rationale provided").otherwise(why)).otherwise("unrecognized pattern").alias("rationale"))


@query("M15", """SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 END AS INTEGER) AS attempts, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def healed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three attempts the first that parses; none if all fail."""
    e = table(spark, sf_dir, "events")
    tries = F.array(*(F.when(F.col("event_id") % 5 == k, F.col("props")).otherwise(F.lit("not json")) for k in range(3)))
    parsed = F.transform(tries, lambda t: F.from_json(t, "k long")["k"])
    at = F.array_position(F.transform(parsed, lambda k: k.isNotNull()), True)
    return e.select("event_id", F.when(at > 0, at).cast("int").alias("attempts"), F.when(at > 0, F.try_element_at(parsed, at.cast("int"))).alias("k"))


FIELDS = {"revenue": "revenue|net sales", "net_income": "net income|net profit", "gross_profit": "gross profit", "cogs": "cost of (?:revenue|sales|goods sold)", "ebitda": "ebitda"}
_MONEY = r"\$\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(thousand|million|billion|trillion|bn|mn)?"


def _patterns(words: str) -> tuple[str, str]:
    return rf"(?i)(?:{words})[^.$]{{0,60}}{_MONEY}", rf"(?i){_MONEY}[^.$]{{0,40}}(?:{words})"


def _sql_read(p: str) -> str:
    return f"CASE WHEN regexp_extract(content, '{p}', 1) <> '' THEN CAST(replace(regexp_extract(content, '{p}', 1), ',', '') AS DOUBLE) * {P._by(f'''regexp_extract(content, '{p}', 2)''')} END"


@query("M11 M12", "SELECT chunk_id, field, round(hunter, 6) AS hunter, round(auditor, 6) AS auditor FROM (" + " UNION ALL ".join(f"SELECT chunk_id, '{k}' AS field, {_sql_read(_patterns(w)[0])} AS hunter, {_sql_read(_patterns(w)[1])} AS auditor FROM chunks WHERE content IS NOT NULL" for k, w in FIELDS.items()) + ") WHERE hunter IS NOT NULL OR auditor IS NOT NULL")
def extracted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two independent readings of each chunk by rule: figures after a field's words, and figures before them."""

    def read(p: str) -> Column:
        n = F.regexp_extract("content", p, 1)
        return F.when(n != "", P.scaled(n, F.regexp_extract("content", p, 2)))

    all_ = F.array(*(F.struct(F.lit(k).alias("field"), F.round(read(_patterns(w)[0]), 6).alias("hunter"), F.round(read(_patterns(w)[1]), 6).alias("auditor")) for k, w in FIELDS.items()))
    c = table(spark, sf_dir, "chunks").where("content is not null").select("chunk_id", F.explode(all_).alias("x")).select("chunk_id", "x.*")
    return c.where("hunter is not null or auditor is not null")


_BEST = f"best AS (WITH {R._sql()} SELECT query_id, id FROM sparse WHERE rank = 0 AND score > 0)"


@query("M3 V20", f"""WITH {_BEST}, assembled AS ({SQL["fact_assembly"]}),
    n AS (SELECT {T.TICKER} AS ticker, field_name AS field, count(*) AS n FROM reconciliation_findings GROUP BY 1, 2)
    SELECT e.item_id, coalesce({T.sql_sentences('c.content')}[1], '') AS prose, coalesce(a.facts, 0) AS facts, coalesce(a.status, 'prose_only') AS status, coalesce(n.n, 0) AS reconciled
    FROM eval_items e LEFT JOIN best b ON b.query_id = e.item_id LEFT JOIN chunks c ON c.chunk_id = b.id LEFT JOIN assembled a ON a.chunk_id = b.id LEFT JOIN n ON n.ticker = upper(trim(e.ticker)) AND n.field = e.field""")
def verified_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's answer: the first sentence of its best chunk, the facts of that chunk with their status, and how many findings there are of its field. A step without rows leaves the prose alone."""
    best = R.bm25_topk(spark, sf_dir).where("rank = 0").select(F.col("query_id").alias("item_id"), F.col("id").alias("chunk_id"))
    c = table(spark, sf_dir, "chunks").select("chunk_id", "content").join(F.broadcast(best), "chunk_id")  # a row for each item is sent to the texts
    best = c.select("item_id", "chunk_id", F.try_element_at(T.sentences(F.col("content")), F.lit(1)).alias("prose"))
    n = table(spark, sf_dir, "reconciliation_findings").groupBy(ticker().alias("ticker"), F.col("field_name").alias("field")).agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "eval_items").select("item_id", ticker().alias("ticker"), "field")
    j = e.join(best, "item_id", "left").join(P.fact_assembly(spark, sf_dir), "chunk_id", "left").join(n, ["ticker", "field"], "left")
    return j.select("item_id", F.coalesce("prose", F.lit("")).alias("prose"), F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("status", F.lit("prose_only")).alias("status"), F.coalesce("n", F.lit(0)).alias("reconciled"))


@query("M8", f"WITH {R._sql(T.TICKER)} SELECT query_id, count(*) AS companies, string_agg(part || ':' || id, ' ' ORDER BY part) AS cited FROM sparse WHERE rank = 0 AND score > 0 AND part IS NOT NULL GROUP BY 1")
def multi_doc_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question over all companies: the best evidence of each, cited in the order of the tickers."""
    t = R.by_company(spark, sf_dir, 1)
    cited = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "id"))), lambda x: F.concat(x["ticker"], F.lit(":"), x["id"])), " ")
    return t.groupBy("query_id").agg(F.count("*").alias("companies"), cited.alias("cited"))
