"""Quality of retrieval and answers, and comparisons of configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.operators import retrieval as R
from filings.registry import query
from filings.run import table, ticker

#: What an item expects: sections by its field, and as entities its ticker and the words of its field.
_SECTIONS_SQL = "CASE field WHEN 'revenue' THEN ['financial_statements', 'mda'] WHEN 'cogs' THEN ['financial_statements'] WHEN 'net_income' THEN ['financial_statements', 'risk_factors'] ELSE CAST([] AS VARCHAR[]) END"
DIVERSE = 5


@query("A5 X2 X5", f"""WITH {R._sql()},
    hits AS (SELECT query_id, s.score, c.content, c.section_name, upper(trim(c.ticker)) AS ticker, c.filing_date FROM sparse s JOIN chunks c ON c.chunk_id = s.id WHERE s.rank < {R.TOP} AND s.score > 0),
    g AS (SELECT query_id, lower(string_agg(content, ' ' ORDER BY content)) AS text, list_distinct(list(section_name)) AS found, count(DISTINCT ticker || '/' || filing_date) AS sources, avg(score) AS mean FROM hits GROUP BY 1),
    e AS (SELECT item_id, list_concat([lower(trim(ticker))], string_split(field, '_')) AS entities, {_SECTIONS_SQL} AS expected FROM eval_items)
    SELECT item_id, round(CASE WHEN g.query_id IS NULL THEN 0 ELSE len(list_filter(entities, lambda x: contains(text, x))) / len(entities) END, 3) AS entity_coverage, round(CASE WHEN g.query_id IS NULL THEN 0 WHEN len(expected) = 0 THEN 1 ELSE len(list_intersect(expected, found)) / len(expected) END, 3) AS section_accuracy,
        round(CASE WHEN g.query_id IS NULL THEN 0 ELSE least(sources / {DIVERSE}, 1) END, 3) AS source_diversity, round(coalesce(mean, 0), 3) AS mean_score FROM e LEFT JOIN g ON g.query_id = item_id""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item's hits: how many entities and sections it expects are there, from how many filings they come, and their mean score. Without hits all are 0."""
    c = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "content", "section_name", F.concat(ticker(), F.lit("/"), "filing_date").alias("source"))
    h = c.join(F.broadcast(R.bm25_topk(spark, sf_dir)), "id")  # a few rows for each item are sent to the texts
    g = h.groupBy("query_id").agg(F.lower(F.array_join(F.array_sort(F.collect_list("content")), " ")).alias("text"), F.collect_set("section_name").alias("found"), F.countDistinct("source").alias("sources"), F.avg("score").alias("mean"))
    field = F.col("field")
    expected = F.when(field == "revenue", F.array(F.lit("financial_statements"), F.lit("mda"))).when(field == "cogs", F.array(F.lit("financial_statements"))).when(field == "net_income", F.array(F.lit("financial_statements"), F.lit("risk_factors"))).otherwise(F.array().cast("array<string>"))
    e = table(spark, sf_dir, "eval_items").select("item_id", F.concat(F.array(F.lower(F.trim("ticker"))), F.split("field", "_")).alias("entities"), expected.alias("expected"))
    j = e.join(g, e["item_id"] == g["query_id"], "left")
    none = F.col("query_id").isNull()
    entity = F.when(none, 0.0).otherwise(F.size(F.filter("entities", lambda x: F.col("text").contains(x))) / F.size("entities"))
    section = F.when(none, 0.0).when(F.size("expected") == 0, 1.0).otherwise(F.size(F.array_intersect("expected", "found")) / F.size("expected"))
    return j.select("item_id", F.round(entity, 3).alias("entity_coverage"), F.round(section, 3).alias("section_accuracy"), F.round(F.when(none, 0.0).otherwise(F.least(F.col("sources") / DIVERSE, F.lit(1.0))), 3).alias("source_diversity"), F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("mean_score"))


@query("A25 X4 J9", f"""WITH {R._sql()},
    a AS (SELECT e.item_id, list_distinct({T.sql_words('lower(e.text)')}) AS ref, list_distinct(d.w) AS ans FROM eval_items e LEFT JOIN (SELECT query_id, id FROM sparse WHERE rank = 0 AND score > 0) s ON s.query_id = e.item_id LEFT JOIN docs d ON d.id = s.id)
    SELECT item_id, round(CASE WHEN len(ref) = 0 THEN 0 ELSE coalesce(len(list_intersect(ref, ans)), 0) / len(ref) END, 3) AS word_overlap FROM a""")
def gold_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of an item's words that its best chunk has."""
    c = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "content")
    best = c.join(F.broadcast(R.bm25_topk(spark, sf_dir).where("rank = 0")), "id").select(F.col("query_id").alias("item_id"), T.words(F.lower(F.col("content"))).alias("ans"))  # a row for each item is sent to the texts
    e = table(spark, sf_dir, "eval_items").select("item_id", F.array_distinct(T.words(F.lower(F.col("text")))).alias("ref")).join(best, "item_id", "left")
    both = F.when(F.col("ans").isNull(), 0).otherwise(F.size(F.array_intersect("ref", "ans")))
    return e.select("item_id", F.round(F.when(F.size("ref") == 0, 0.0).otherwise(both / F.size("ref")), 3).alias("word_overlap"))


#: A judge's five dimensions from 1 to 5, one for each kind of event of a user; a missing one is 3.
_DIMENSIONS = {"click": ("grounding", 0.25), "view": ("completeness", 0.20), "signup": ("citation", 0.20), "purchase": ("precision", 0.20), "error": ("coherence", 0.15)}
_DIM = "least(5, 1 + floor({}::DOUBLE / 25))"
_RUBRIC = "rubric AS (SELECT user_id, " + ", ".join(f"coalesce({_DIM.format(f'''avg(value) FILTER (event_type = '{k}')''')}, 3) AS {n}" for k, (n, _) in _DIMENSIONS.items()) + " FROM events GROUP BY user_id)"
_OVERALL = "round(" + " + ".join(f"{w}::DOUBLE * {n}" for n, w in _DIMENSIONS.values()) + ", 2)"


def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = lambda k: F.coalesce(F.least(F.lit(5.0), 1.0 + F.floor(F.avg(F.when(F.col("event_type") == k, F.col("value"))) / 25)), F.lit(3.0))
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(*(dim(k).alias(n) for k, (n, _) in _DIMENSIONS.items()))
    total = sum((F.lit(w) * F.col(n) for n, w in _DIMENSIONS.values()), F.lit(0.0))
    return r.withColumn("overall", F.round(total, 2))


@query("A4 M9", f"WITH {_RUBRIC} SELECT *, {_OVERALL} AS overall FROM rubric")
def rubric_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rubric(spark, sf_dir)


@query("A3", f"""WITH {_RUBRIC}, m AS (SELECT user_id, {_OVERALL} AS overall, grounding / 5 AS ent, completeness / 5 AS sec, citation / 5 AS div, precision / 5 AS gold FROM rubric)
    SELECT user_id, round(0.25::DOUBLE * (0.5::DOUBLE * ent + 0.3::DOUBLE * sec + 0.2::DOUBLE * div) + 0.5::DOUBLE * overall / 5 + 0.25::DOUBLE * gold, 3) AS composite FROM m""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval, judgement and gold in one: a quarter, a half and a quarter."""
    r = rubric(spark, sf_dir)
    retrieved = 0.5 * (F.col("grounding") / 5) + 0.3 * (F.col("completeness") / 5) + 0.2 * (F.col("citation") / 5)
    return r.select("user_id", F.round(0.25 * retrieved + 0.5 * F.col("overall") / 5 + 0.25 * (F.col("precision") / 5), 3).alias("composite"))


_MEANS = "configs AS (SELECT event_type AS config, user_id, avg(value) AS score FROM events GROUP BY 1, 2), top AS (SELECT config, row_number() OVER (ORDER BY round(avg(score), 6) DESC, config) AS pos FROM configs GROUP BY 1)"


def _configs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each configuration's mean score for each question (kinds of events and users stand in), and the best four configurations in order."""
    c = table(spark, sf_dir, "events").where("event_type is not null").groupBy(F.col("event_type").alias("config"), "user_id").agg(F.avg("value").alias("score"))
    best = c.groupBy("config").agg(F.round(F.avg("score"), 6).alias("m")).orderBy(F.desc("m"), "config").limit(4)
    names = [r["config"] for r in best.collect()]
    pos = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]) if names else F.create_map().cast("map<string,int>")
    return c, c.select("config").distinct().withColumn("pos", pos[F.col("config")]).where("pos is not null")


@query("A15 J11 W7", f"""WITH {_MEANS}, s AS (SELECT c.*, pos FROM configs c JOIN top USING (config) WHERE pos <= 4),
    p AS (SELECT a.config AS a, b.config AS b, CASE WHEN abs(a.score - b.score) < 10 THEN 'tie' WHEN a.score > b.score THEN 'A' ELSE 'B' END AS winner FROM s a JOIN s b ON a.user_id = b.user_id AND a.pos < b.pos),
    w AS (SELECT a AS config, CASE winner WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0 ELSE 0.5 END AS win FROM p UNION ALL SELECT b, CASE winner WHEN 'B' THEN 1.0::DOUBLE WHEN 'A' THEN 0 ELSE 0.5 END FROM p)
    SELECT config, count(*) AS total, sum(win) AS wins, round(sum(win) / greatest(count(*), 1), 6) AS rate FROM w GROUP BY config""")
def pairwise_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the best four configurations over all questions; a tie is half a win for both."""
    c, top = _configs(spark, sf_dir)
    s = c.join(top, "config")
    a, b = s.alias("a"), s.alias("b")
    winner = F.when(F.abs(F.col("a.score") - F.col("b.score")) < 10, "tie").when(F.col("a.score") > F.col("b.score"), "A").otherwise("B")
    p = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.config").alias("a"), F.col("b.config").alias("b"), winner.alias("winner"))
    side = lambda c, w: F.struct(F.col(c).alias("config"), F.when(F.col("winner") == w, 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0).alias("win"))
    w = p.select(F.explode(F.array(side("a", "A"), side("b", "B"))).alias("x")).select("x.*")
    return w.groupBy("config").agg(F.count("*").alias("total"), F.sum("win").alias("wins"), F.round(F.sum("win") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


@query("A2 W7 S10 S11", """
    WITH m AS (SELECT event_type AS config, count(*) AS runs, round(avg(value), 6) AS mean_score, round(coalesce(avg(value) FILTER (user_id % 3 = 0), 0), 6) AS mean_gold FROM events GROUP BY 1)
    SELECT config, 'runs' AS metric, CAST(runs AS DOUBLE) AS value FROM m UNION ALL SELECT config, 'mean_score', mean_score FROM m UNION ALL SELECT config, 'mean_gold', mean_gold FROM m""")
def config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of each configuration as rows of an experiment log; gold only over questions that have it, 0 if none has."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config")).agg(F.count("*").cast("double").alias("runs"), F.round(F.avg("value"), 6).alias("mean_score"), F.round(F.coalesce(F.avg(F.when(F.col("user_id") % 3 == 0, F.col("value"))), F.lit(0.0)), 6).alias("mean_gold"))
    return m.unpivot(["config"], ["runs", "mean_score", "mean_gold"], "metric", "value")


@query("A1 A23", "SELECT accession_number, count(*) AS sections, CAST(sum(word_count) AS BIGINT) AS total_words FROM filing_sections GROUP BY 1")
def filing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "filing_sections").groupBy("accession_number").agg(F.count("*").alias("sections"), F.sum("word_count").alias("total_words"))
