"""Answers against expected figures, and the statistics of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.text import TICKER
from filings.operators.provenance import _NUMBER, close, scaled, sql_close
from filings.operators.provenance import _by as by_scale
from filings.registry import query
from filings.run import table, ticker

BARE = 10_000  # a figure with a dollar sign and no scale below it is a price, not a total
Z = 1.96
_CLAIM = rf"(?i)(\$?)\s*({_NUMBER})\s*(million|billion|trillion|thousand|bn|mn|[mbtk])?(?![A-Za-z0-9_])"
_SQL_CLAIM = _CLAIM.replace("(?![A-Za-z0-9_])", r"\b")
#: Fixed values.
REFUSALS = ("not reported", "not disclosed", "is not provided", "isn't provided", "do not have", "cannot find", "cannot extract", "unable to find", "no specific figure", "not available", "not a gaap", "not provided in", "could not find", "i don't have", "i do not have")
_PERIOD = r"(?i)(?:^|[^A-Za-z0-9_])(20[0-9][0-9]|Q[1-4]|quarter|January|February|March|April|May|June|July|August|September|October|November|December)(?:[^A-Za-z0-9_]|$)"


def claims(c: Column) -> Column:
    """The figures that a text claims, in USD millions and in order; one within half a percent of an earlier kept one is that one again."""
    all_ = lambda k: F.regexp_extract_all(c, F.lit(_CLAIM), F.lit(k))
    x = F.arrays_zip(all_(1).alias("sign"), all_(2).alias("n"), all_(3).alias("s"))
    bare = F.filter(x, lambda x: (x["s"] != "") | ((x["sign"] != "") & (F.replace(x["n"], F.lit(","), F.lit("")).cast("double") >= BARE)))
    values = F.transform(bare, lambda x: scaled(x["n"], x["s"]))
    return F.aggregate(values, F.array().cast("array<double>"), lambda kept, v: F.when(F.exists(kept, lambda k: close(v, k)), kept).otherwise(F.concat(kept, F.array(v))))


def sql_claims(c: str) -> str:
    all_ = lambda k: f"regexp_extract_all({c}, '{_SQL_CLAIM}', {k})"
    lists = f"list_zip({all_(1)}, {all_(2)}, {all_(3)})"
    kept = f"list_filter({lists}, lambda x: coalesce(x[3], '') <> '' OR (coalesce(x[1], '') <> '' AND CAST(replace(x[2], ',', '') AS DOUBLE) >= {BARE}))"
    values = f"list_transform({kept}, lambda x: [CAST(replace(x[2], ',', '') AS DOUBLE) * {by_scale('''coalesce(x[3], '')''')}])"
    fold = f"lambda a, b: CASE WHEN len(list_filter(a, lambda k: {sql_close('b[1]', 'k')})) > 0 THEN a ELSE list_concat(a, b) END"
    return f"coalesce(CASE WHEN len({values}) > 0 THEN list_reduce({values}, {fold}) END, CAST([] AS DOUBLE[]))"


_DOCS = f"docs AS (SELECT doc_id, {TICKER} AS ticker, text, {sql_claims('text')} AS claims FROM documents WHERE text IS NOT NULL)"


@query("E7 A22", f"WITH {_DOCS} SELECT doc_id, CAST(generate_subscripts(claims, 1) - 1 AS INTEGER) AS pos, round(unnest(claims), 6) AS value FROM docs")
def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(claims(F.col("text"))).alias("pos", "v"))
    return d.select("doc_id", "pos", F.round("v", 6).alias("value"))


def refuses(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for m in REFUSALS:
        out = out | low.contains(m)
    return out


_REFUSES = "(" + " OR ".join(f"contains(lower(text), '{m.replace(chr(39), chr(39) * 2)}')" for m in REFUSALS) + ")"


@query("E8 E9", f"SELECT doc_id, {_REFUSES} AS refuses, regexp_matches(text, '{_PERIOD}') AS period FROM documents WHERE text IS NOT NULL")
def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", refuses(F.col("text")).alias("refuses"), F.col("text").rlike(_PERIOD).alias("period"))


def prose_verdict(kind: Column, expected: Column, found: Column, refused: Column, period: Column) -> tuple[Column, Column]:
    """(verdict, extracted). An expectation that is null can't be met."""
    some = F.size(found) > 0
    hit = F.filter(found, lambda x: close(x, expected))
    nearest = F.aggregate(found, F.lit(None).cast("double"), lambda best, x: F.when(best.isNull() | (F.abs(x - expected) < F.abs(best - expected)), x).otherwise(best))
    exact = F.when(F.size(hit) > 0, "correct").when(some, "confident_wrong").otherwise("no_number")
    absent = F.when(refused & ~some, "correctly_refused").when(some, "confabulated").otherwise("no_number")
    open_ = F.when(refused, "correctly_refused").when(some & period, "correct").when(some, "confident_wrong").otherwise("no_number")
    verdict = F.when(kind == "exact_number", exact).when(kind == "not_reported", absent).otherwise(open_)
    value = F.when(kind == "exact_number", F.when(F.size(hit) > 0, hit[0]).otherwise(nearest)).when((kind == "ambiguous") & refused, F.lit(None)).otherwise(F.try_element_at(found, F.lit(1)))
    return verdict, value


@query("V14", f"""WITH {_DOCS},
    j AS (SELECT item_id, doc_id, expected_kind AS kind, expected_value_millions AS expected, claims, {_REFUSES.replace('text', 'd.text')} AS refused, regexp_matches(d.text, '{_PERIOD}') AS period, list_filter(claims, lambda x: {sql_close('x', 'expected_value_millions')}) AS hit
        FROM eval_items e JOIN docs d ON d.ticker = upper(trim(e.ticker)))
    SELECT item_id, doc_id, CASE kind WHEN 'exact_number' THEN CASE WHEN len(hit) > 0 THEN 'correct' WHEN len(claims) > 0 THEN 'confident_wrong' ELSE 'no_number' END
        WHEN 'not_reported' THEN CASE WHEN refused AND len(claims) = 0 THEN 'correctly_refused' WHEN len(claims) > 0 THEN 'confabulated' ELSE 'no_number' END
        ELSE CASE WHEN refused THEN 'correctly_refused' WHEN len(claims) > 0 AND period THEN 'correct' WHEN len(claims) > 0 THEN 'confident_wrong' ELSE 'no_number' END END AS verdict,
        round(CASE WHEN kind = 'exact_number' THEN CASE WHEN len(hit) > 0 THEN hit[1] ELSE list_reduce(claims, lambda a, b: CASE WHEN abs(b - expected) < abs(a - expected) THEN b ELSE a END) END WHEN kind = 'ambiguous' AND refused THEN NULL ELSE claims[1] END, 6) AS extracted FROM j""".replace("list_reduce(claims,", "CASE WHEN len(claims) > 0 THEN list_reduce(claims,").replace("ELSE a END) END WHEN kind", "ELSE a END) END END WHEN kind"))
def score_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of an item's ticker, taken as its answer."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ticker().alias("ticker"), claims(F.col("text")).alias("claims"), refuses(F.col("text")).alias("refused"), F.col("text").rlike(_PERIOD).alias("period"))
    e = table(spark, sf_dir, "eval_items").select("item_id", ticker().alias("ticker"), "expected_kind", "expected_value_millions")
    v, x = prose_verdict(F.col("expected_kind"), F.col("expected_value_millions"), F.col("claims"), F.col("refused"), F.col("period"))
    return e.join(d, "ticker").select("item_id", "doc_id", v.alias("verdict"), F.round(x, 6).alias("extracted"))


@query("V15 J17", f"""
    WITH f AS (SELECT {TICKER} AS ticker, field_name AS field, arg_min(fact_value, structured_fact_id) AS v, arg_min(provenance_verified, structured_fact_id) AS ok, arg_min(confidence, structured_fact_id) AS confidence FROM structured_facts WHERE fact_value IS NOT NULL AND provenance_verified IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2)
    SELECT item_id, CASE WHEN f.v IS NULL THEN CASE expected_kind WHEN 'exact_number' THEN 'no_number' ELSE 'correctly_refused' END
        WHEN expected_kind = 'exact_number' THEN CASE WHEN {sql_close('f.v', 'expected_value_millions')} THEN 'correct' WHEN ok THEN 'confident_wrong' ELSE 'wrong_number' END
        WHEN expected_kind = 'not_reported' THEN CASE WHEN confidence = 'low' THEN 'correctly_refused' ELSE 'confabulated' END
        ELSE CASE WHEN ok THEN 'correct' ELSE 'confident_wrong' END END AS verdict, f.v AS extracted
    FROM eval_items e LEFT JOIN f ON f.ticker = upper(trim(e.ticker)) AND f.field = e.field""")
def score_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of an item's ticker and field; one of low confidence counts as disputed. Without a fact an empty prose answer is scored."""
    f = table(spark, sf_dir, "structured_facts").where("fact_value is not null and provenance_verified is not null and confidence is not null").select(ticker().alias("ticker"), F.col("field_name").alias("field"), "structured_fact_id", F.struct("fact_value", "provenance_verified", "confidence").alias("x"))
    f = f.groupBy("ticker", "field").agg(F.min_by("x", "structured_fact_id").alias("x")).select("ticker", "field", F.col("x.fact_value").alias("v"), F.col("x.provenance_verified").alias("ok"), "x.confidence")
    e = table(spark, sf_dir, "eval_items").select("item_id", ticker().alias("ticker"), "field", "expected_kind", "expected_value_millions").join(f, ["ticker", "field"], "left")
    kind, v, ok = F.col("expected_kind"), F.col("v"), F.col("ok")
    verdict = (
        F.when(v.isNull(), F.when(kind == "exact_number", "no_number").otherwise("correctly_refused"))
        .when(kind == "exact_number", F.when(close(v, F.col("expected_value_millions")), "correct").when(ok, "confident_wrong").otherwise("wrong_number"))
        .when(kind == "not_reported", F.when(F.col("confidence") == "low", "correctly_refused").otherwise("confabulated"))
        .otherwise(F.when(ok, "correct").otherwise("confident_wrong"))
    )
    return e.select("item_id", verdict.alias("verdict"), v.alias("extracted"))


# --- run logs: each event is a row of a log ------------------------------------------------------------------------------

_VERDICTS = {"purchase": "correct", "click": "no_number", "view": "confident_wrong", "signup": "confabulated"}
_LOG = """
    log AS (SELECT event_id AS line, user_id AS qid, CASE WHEN event_id % 2 = 0 THEN 'prose' ELSE 'verified' END AS pipeline, user_id % 4 AS bucket, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'no_number' WHEN 'view' THEN 'confident_wrong' WHEN 'signup' THEN 'confabulated' END AS verdict,
        event_type IN ('purchase', 'click') AS is_pass, value AS latency, event_type = 'error' AS failed FROM events),
    runs AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, qid ORDER BY line DESC) AS r FROM log) WHERE r = 1)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.create_map(*[F.lit(x) for kv in _VERDICTS.items() for x in kv])[kind]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("qid"), F.when(F.col("event_id") % 2 == 0, "prose").otherwise("verified").alias("pipeline"), (F.col("user_id") % 4).alias("bucket"), verdict.alias("verdict"), kind.isin("purchase", "click").alias("is_pass"), F.col("value").alias("latency"), (kind == "error").alias("failed"))


def last_runs(rows: DataFrame) -> DataFrame:
    """Of each question and pipeline the last row of the log."""
    rest = [c for c in rows.columns if c not in ("pipeline", "qid", "line")]
    return rows.groupBy("pipeline", "qid").agg(F.max(F.struct("line", *rest)).alias("x")).select("pipeline", "qid", "x.*")


@query("A26 S7 S8", f"WITH {_LOG} SELECT pipeline, qid, line, bucket, verdict, is_pass, latency, failed FROM runs")
def last_run_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_runs(log(spark, sf_dir))


@query("A6", f"WITH {_LOG} SELECT pipeline, coalesce(verdict, 'error') AS verdict, count(*) AS n FROM runs GROUP BY 1, 2")
def verdict_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_runs(log(spark, sf_dir)).groupBy("pipeline", F.coalesce("verdict", F.lit("error")).alias("verdict")).agg(F.count("*").alias("n"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of k of n, in [0, 1]; (0, 1) of none."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def _wilson_sql(k: str, n: str) -> str:
    mid, half = f"({k} / {n} + {Z * Z} / (2 * {n})) / (1 + {Z * Z} / {n})", f"{Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n})) / (1 + {Z * Z} / {n})"
    return f"round(greatest(0, {mid} - {half}), 6) AS ci_low, round(least(1, {mid} + {half}), 6) AS ci_high"


def rates(rows: DataFrame, keys: list[str], good: Column, name: str) -> DataFrame:
    n, k = F.count("*"), F.count_if(good)
    lo, hi = wilson(F.col(name).cast("double"), F.col("n").cast("double"))
    return rows.groupBy(*keys).agg(n.alias("n"), k.alias(name)).select(*keys, "n", name, F.round(F.col(name) / F.col("n"), 6).alias("rate"), F.round(lo, 6).alias("ci_low"), F.round(hi, 6).alias("ci_high"))


def _rates_sql(keys: str, good: str, name: str) -> str:
    return f"WITH {_LOG} SELECT {keys}, n, {name}, round({name} / n, 6) AS rate, {_wilson_sql(f'CAST({name} AS DOUBLE)', 'CAST(n AS DOUBLE)')} FROM (SELECT {keys}, count(*) AS n, count(*) FILTER ({good}) AS {name} FROM runs GROUP BY {keys})"


@query("A7 A10", _rates_sql("pipeline, bucket", "is_pass", "passed"))
def pass_rate_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(last_runs(log(spark, sf_dir)), ["pipeline", "bucket"], F.col("is_pass"), "passed")


@query("A8", _rates_sql("pipeline", "verdict IN ('confident_wrong', 'confabulated')", "confident_wrong"))
def confident_wrong_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(last_runs(log(spark, sf_dir)), ["pipeline"], F.col("verdict").isin("confident_wrong", "confabulated"), "confident_wrong")


def picked(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """(key, name, value): of each key's sorted values the ones at the places (from 0, functions of n).

    Exact without sorting a whole group in one task: values are counted by their whole part, running counts tell in which
    part a place falls, and only that part is ranked.
    """
    v = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), F.floor(value).alias("part"))
    w = Window.partitionBy(key).orderBy("part")
    parts = v.groupBy(key, "part").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    asked = parts.select(key, "part", "c", "upto", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at.cast("long").alias("at")) for name, at in places.items()))).alias("x")).select(key, "part", "c", "upto", "x.*")
    asked = asked.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))).select(key, "part", "name", (F.col("at") - F.col("upto") + F.col("c") + 1).alias("nth"))
    ranked = v.join(asked.select(key, "part").distinct(), [key, "part"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(key, "part").orderBy("v")).cast("long"))
    return ranked.join(asked, [key, "part", "nth"]).select(key, "name", F.col("v").alias("value"))


@query("A9 F10", f"WITH {_LOG}, s AS (SELECT pipeline, list_sort(list(latency)) AS l, avg(latency) AS mean FROM runs WHERE NOT failed GROUP BY 1) SELECT pipeline, len(l) AS n, round(mean, 6) AS mean_s, l[len(l) // 2 + 1] AS median_s, l[least(CAST(floor(0.95::DOUBLE * len(l)) AS BIGINT), len(l) - 1) + 1] AS p95_s FROM s")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median and the 95th percentile are members of the sample, not means between two."""
    r = last_runs(log(spark, sf_dir)).where(~F.col("failed"))
    p = picked(r, "pipeline", "latency", {"median_s": F.floor(F.col("n") / 2), "p95_s": F.least(F.floor(0.95 * F.col("n")), F.col("n") - 1)})
    p = p.groupBy("pipeline").agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("median_s", "p95_s")))
    return r.groupBy("pipeline").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_s")).join(p, "pipeline")


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b against c discordant pairs; 1 of none. Terms of the binomial tail are made one from the other, in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    start = F.struct(F.lit(0.0).alias("l"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))
    step = lambda a, i: F.struct((a["l"] + F.log((n - i + 1) / i)).alias("l"), (a["s"] + F.exp(a["l"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("s"))
    tail = F.aggregate(F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0), start, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


@query("A11 J10 X3", f"""WITH {_LOG}, p AS (SELECT a.bucket, count(*) FILTER (a.is_pass AND b.is_pass) AS both_pass, count(*) FILTER (a.is_pass AND NOT b.is_pass) AS only_prose, count(*) FILTER (NOT a.is_pass AND b.is_pass) AS only_verified, count(*) FILTER (NOT a.is_pass AND NOT b.is_pass) AS both_fail
        FROM runs a JOIN runs b ON a.qid = b.qid AND a.pipeline = 'prose' AND b.pipeline = 'verified' GROUP BY 1)
    SELECT *, round(CASE WHEN only_prose + only_verified = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(generate_series(0, least(only_prose, only_verified)), lambda i: exp(lgamma(only_prose + only_verified + 1) - lgamma(i + 1) - lgamma(only_prose + only_verified - i + 1) - (only_prose + only_verified) * ln(2))))) END, 6) AS p FROM p""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that both pipelines answered, by bucket."""
    r = last_runs(log(spark, sf_dir))
    one = lambda k: r.where(F.col("pipeline") == k).select("qid", "bucket", F.col("is_pass").alias(k))
    a, b = F.col("prose"), F.col("verified")
    j = one("prose").join(one("verified").drop("bucket"), "qid")
    t = j.groupBy("bucket").agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("only_prose"), F.count_if(~a & b).alias("only_verified"), F.count_if(~a & ~b).alias("both_fail"))
    return t.withColumn("p", F.round(mcnemar(F.col("only_prose"), F.col("only_verified")), 6))


_DAILY = "daily AS (SELECT DISTINCT user_id * 100 + day(ts) AS qid, CASE WHEN event_id % 2 = 0 THEN 'prose' ELSE 'verified' END AS pipeline FROM events)"


@query("F7 X6 V23", f"WITH {_DAILY}, w AS (SELECT DISTINCT qid, unnest(['prose', 'verified']) AS pipeline FROM daily) SELECT w.qid, w.pipeline FROM w ANTI JOIN daily d ON d.qid = w.qid AND d.pipeline = w.pipeline")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's question of a day, for the pipelines that haven't answered it; a row with an error counts as done."""
    done = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("qid"), F.when(F.col("event_id") % 2 == 0, "prose").otherwise("verified").alias("pipeline")).distinct()
    work = done.select("qid").distinct().withColumn("pipeline", F.explode(F.array(F.lit("prose"), F.lit("verified"))))
    return work.join(done, ["qid", "pipeline"], "left_anti")
