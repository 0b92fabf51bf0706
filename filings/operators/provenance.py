"""Dollar figures of texts, and whether an extracted figure stands where it is said to stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.operators.parsing import SQL_PARAGRAPHS, chunk_paragraphs
from filings.registry import query
from filings.run import table

CLOSE = 0.005
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_DOLLAR = rf"(?i)\$\s*({_NUMBER})(?:\s*(thousand|million|billion|trillion|mm|bn|mn|[mbkt])(?![A-Za-z0-9_]))?"
_PARENS = r"\(\s*(\d{1,3}(?:,\d{3})+(?:\.\d+)?)\s*\)"
_SQL_DOLLAR = _DOLLAR.replace("(?![A-Za-z0-9_])", r"\b")
#: How many millions one of the scale is.
SCALES = {"thousand": 1e-3, "k": 1e-3, "million": 1.0, "m": 1.0, "mm": 1.0, "mn": 1.0, "billion": 1e3, "b": 1e3, "bn": 1e3, "trillion": 1e6, "t": 1e6}


def scaled(number: Column, scale: Column) -> Column:
    """In USD millions; without a scale as it is."""
    by = F.coalesce(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])[F.lower(scale)], F.lit(1.0))
    return F.replace(number, F.lit(","), F.lit("")).cast("double") * by


def _by(scale: str) -> str:
    return f"CASE lower({scale}) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in SCALES.items()) + " ELSE 1 END"


def figures(c: Column) -> Column:
    """Of a paragraph: all dollar figures in order, then all numbers in brackets, as structs of raw and value."""
    all_ = lambda p, k: F.regexp_extract_all(c, F.lit(p), F.lit(k))
    d = F.transform(F.arrays_zip(all_(_DOLLAR, 0).alias("r"), all_(_DOLLAR, 1).alias("n"), all_(_DOLLAR, 2).alias("s")), lambda x: F.struct(x["r"].alias("raw"), scaled(x["n"], x["s"]).alias("value")))
    p = F.transform(F.arrays_zip(all_(_PARENS, 0).alias("r"), all_(_PARENS, 1).alias("n")), lambda x: F.struct(x["r"].alias("raw"), F.replace(x["n"], F.lit(","), F.lit("")).cast("double").alias("value")))
    return F.concat(d, p)


def close(a: Column, to: Column) -> Column:
    """Within half a percent of the second; of 0, within the number itself."""
    return F.when(to == 0, F.abs(a) <= CLOSE).otherwise(F.abs(a - to) / F.abs(to) <= CLOSE)


def sql_close(a: str, to: str) -> str:
    return f"CASE WHEN {to} = 0 THEN abs({a}) <= {CLOSE} ELSE abs({a} - {to}) / abs({to}) <= {CLOSE} END"


_ALL = lambda p, k: f"regexp_extract_all(text, '{p}', {k})"
SQL_CANDIDATES = rf"""{SQL_PARAGRAPHS},
    lists AS (SELECT chunk_id, paragraph, {_ALL(_SQL_DOLLAR, 0)} AS dr, {_ALL(_SQL_DOLLAR, 1)} AS dn, {_ALL(_SQL_DOLLAR, 2)} AS ds, {_ALL(_PARENS, 0)} AS pr, {_ALL(_PARENS, 1)} AS pn FROM paragraphs),
    candidates AS (SELECT chunk_id, paragraph, pos, raw, CAST(replace(n, ',', '') AS DOUBLE) * {_by('s')} AS value FROM (
        SELECT chunk_id, paragraph, CAST(generate_subscripts(dr, 1) - 1 AS INTEGER) AS pos, unnest(dr) AS raw, unnest(dn) AS n, coalesce(unnest(ds), '') AS s FROM lists
        UNION ALL SELECT chunk_id, paragraph, CAST(len(dr) + generate_subscripts(pr, 1) - 1 AS INTEGER), unnest(pr), unnest(pn), '' FROM lists))"""


def candidates(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("chunk_id", "paragraph", F.posexplode(figures(F.col("text"))).alias("pos", "x")).select("chunk_id", "paragraph", "pos", "x.raw", "x.value")


@query("E1 E2 E3 E4", f"WITH {SQL_CANDIDATES} SELECT chunk_id, paragraph, pos, raw, round(value, 6) AS value FROM candidates")
def dollar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(chunk_paragraphs(spark, sf_dir)).withColumn("value", F.round("value", 6))


_FACTS = "facts AS (SELECT structured_fact_id AS id, chunk_id, fact_value AS v FROM structured_facts WHERE chunk_id IS NOT NULL AND fact_value IS NOT NULL)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "structured_facts").where("chunk_id is not null and fact_value is not null").select(F.col("structured_fact_id").alias("id"), "chunk_id", F.col("fact_value").alias("v"))


@query("J8 E6", f"WITH {SQL_CANDIDATES}, {_FACTS} SELECT id, count(*) AS candidates, count(*) FILTER ({sql_close('value', 'v')}) AS matching FROM facts JOIN candidates USING (chunk_id) GROUP BY id")
def value_band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many figures of a fact's chunk there are, and how many are its value."""
    j = _facts(spark, sf_dir).join(candidates(chunk_paragraphs(spark, sf_dir)), "chunk_id")
    return j.groupBy("id").agg(F.count("*").alias("candidates"), F.count_if(close(F.col("value"), F.col("v"))).alias("matching"))


@query("W10", f"WITH {SQL_CANDIDATES}, {_FACTS} SELECT id, round(value, 6) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value - v), paragraph, pos) AS r FROM facts JOIN candidates USING (chunk_id)) WHERE r = 1")
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _facts(spark, sf_dir).join(candidates(chunk_paragraphs(spark, sf_dir)), "chunk_id")
    return j.groupBy("id").agg(F.round(F.min_by("value", F.struct(F.abs(F.col("value") - F.col("v")), "paragraph", "pos")), 6).alias("nearest"))


def verified(metrics: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, passed, reason, found_paragraph) of metrics (id, chunk_id, value, quote, cited).

    In order: no value passes; a cited paragraph must exist; the quote is looked for there, then in the other paragraphs
    (the first holds), then the value anywhere stands in for it; without a citation the quote must be somewhere; without
    either the value must be. Last, the value must be among the figures of the paragraph that was found.
    """
    p = paragraphs.withColumn("norm", T.normal(F.col("text")))
    # A metric meets the paragraphs of its own document only.
    m = metrics.join(p, "chunk_id", "left")
    has = F.col("quote").isNotNull() & (F.col("quote") != "") & F.col("norm").contains(T.normal(F.col("quote")))
    at_cited = F.col("paragraph") == F.col("cited")
    values = F.transform(F.coalesce(figures(F.col("text")), F.array().cast("array<struct<raw:string,value:double>>")), lambda x: x["value"])
    hit = F.exists(values, lambda x: close(x, F.col("value")))
    one = m.withColumns({"has": F.coalesce(has, F.lit(False)), "hit": F.coalesce(hit, F.lit(False)), "at": F.coalesce(at_cited, F.lit(False))}).groupBy("id", "value", "quote", "cited").agg(
        F.bool_or("at").alias("exists_"), F.bool_or(F.col("at") & F.col("has")).alias("in_cited"), F.min(F.when(F.col("has"), F.col("paragraph"))).alias("elsewhere"),
        F.bool_or("hit").alias("anywhere"), F.bool_or(F.col("at") & F.col("hit")).alias("hit_cited"), F.min(F.when(F.col("hit"), F.col("paragraph"))).alias("hit_first"), F.collect_set(F.when(F.col("hit"), F.col("paragraph"))).alias("hits"),
    )
    quoted, cited = F.coalesce(F.col("quote") != "", F.lit(False)), F.col("cited").isNotNull()
    soft = quoted & cited & ~F.col("in_cited") & F.col("elsewhere").isNull()
    found = F.when(quoted & cited & ~F.col("in_cited"), F.col("elsewhere")).when(cited, F.col("cited")).when(quoted, F.col("elsewhere"))
    reason = (
        F.when(F.col("value").isNull(), "not extracted").when(cited & ~F.col("exists_"), "no such paragraph").when(soft & F.col("anywhere"), "value without quote").when(soft, "neither quote nor value")
        .when(quoted & ~cited & F.col("elsewhere").isNull(), "quote not found").when(found.isNull() & F.col("anywhere"), "value without anchor").when(found.isNull(), "value not found")
        .when(F.array_contains("hits", found), "value in paragraph").otherwise("value not in paragraph")
    )
    at = F.when(reason == "value without quote", F.when(F.col("hit_cited"), F.col("cited")).otherwise(F.col("hit_first"))).when(reason.isin("value in paragraph", "value not in paragraph"), found)
    return one.select("id", reason.isin("not extracted", "value without quote", "value without anchor", "value in paragraph").alias("passed"), reason.alias("reason"), at.cast("int").alias("found_paragraph"))


_FACT_METRICS = """SELECT structured_fact_id AS id, chunk_id, CASE WHEN field_name LIKE '%\\_pct' ESCAPE '\\' THEN NULL ELSE fact_value END AS value, source_quote AS quote, CASE WHEN chunk_index >= 0 THEN chunk_index + 1 END AS cited FROM structured_facts WHERE chunk_id IS NOT NULL"""


def _sql_verified(metrics: str) -> str:
    return f"""{SQL_CANDIDATES},
    m AS ({metrics}),
    h AS (SELECT DISTINCT id, paragraph FROM m JOIN candidates c USING (chunk_id) WHERE {sql_close('c.value', 'm.value')}),
    j AS (SELECT m.*, p.paragraph, coalesce(quote <> '' AND contains({T.sql_normal('p.text')}, {T.sql_normal('quote')}), false) AS has, h.paragraph IS NOT NULL AS hit, coalesce(p.paragraph = cited, false) AS here
        FROM m LEFT JOIN paragraphs p USING (chunk_id) LEFT JOIN h ON h.id = m.id AND h.paragraph = p.paragraph),
    one AS (SELECT id, value, quote, cited, bool_or(here) AS exists_, bool_or(here AND has) AS in_cited, min(paragraph) FILTER (has) AS elsewhere, bool_or(hit) AS anywhere, bool_or(here AND hit) AS hit_cited, min(paragraph) FILTER (hit) AS hit_first, list(paragraph) FILTER (hit) AS hits FROM j GROUP BY ALL),
    f AS (SELECT *, coalesce(quote <> '', false) AS quoted, CASE WHEN coalesce(quote <> '', false) AND cited IS NOT NULL AND NOT in_cited THEN elsewhere WHEN cited IS NOT NULL THEN cited WHEN coalesce(quote <> '', false) THEN elsewhere END AS found FROM one),
    r AS (SELECT *, CASE WHEN value IS NULL THEN 'not extracted' WHEN cited IS NOT NULL AND NOT exists_ THEN 'no such paragraph' WHEN quoted AND cited IS NOT NULL AND NOT in_cited AND elsewhere IS NULL AND anywhere THEN 'value without quote'
        WHEN quoted AND cited IS NOT NULL AND NOT in_cited AND elsewhere IS NULL THEN 'neither quote nor value' WHEN quoted AND cited IS NULL AND elsewhere IS NULL THEN 'quote not found' WHEN found IS NULL AND anywhere THEN 'value without anchor' WHEN found IS NULL THEN 'value not found'
        WHEN list_contains(hits, found) THEN 'value in paragraph' ELSE 'value not in paragraph' END AS reason FROM f),
    verified AS (SELECT id, reason IN ('not extracted', 'value without quote', 'value without anchor', 'value in paragraph') AS passed, reason, CAST(CASE WHEN reason = 'value without quote' THEN CASE WHEN hit_cited THEN cited ELSE hit_first END WHEN reason IN ('value in paragraph', 'value not in paragraph') THEN found END AS INTEGER) AS found_paragraph FROM r)"""


_VERIFIED = _sql_verified(_FACT_METRICS)


def fact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as metrics: percentages have no figure to look for; the chunk's index is the citation, where it is known."""
    f = table(spark, sf_dir, "structured_facts").where("chunk_id is not null")
    return f.select(F.col("structured_fact_id").alias("id"), "chunk_id", F.when(F.col("field_name").endswith("_pct"), F.lit(None)).otherwise(F.col("fact_value")).alias("value"), F.col("source_quote").alias("quote"), F.when(F.col("chunk_index") >= 0, F.col("chunk_index") + 1).alias("cited"))


def fact_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(fact_metrics(spark, sf_dir), chunk_paragraphs(spark, sf_dir))


@query("V1 J7 E5", f"WITH {_VERIFIED} SELECT * FROM verified")
def quote_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_verdicts(spark, sf_dir)


_CASE = "(chunk_id + paragraph + pos) % 8"
_OWN_METRICS = f"""SELECT chunk_id * 1000000 + paragraph * 1000 + pos AS id, chunk_id, CASE WHEN {_CASE} IN (6, 7) THEN value * 1.5::DOUBLE + 7 ELSE value END AS value,
        CASE WHEN {_CASE} IN (3, 4) THEN 'this was never said' WHEN {_CASE} IN (5, 7) THEN NULL ELSE text[1:40] END AS quote, CAST(CASE {_CASE} WHEN 0 THEN paragraph WHEN 1 THEN 1 WHEN 3 THEN paragraph WHEN 6 THEN paragraph END AS INTEGER) AS cited FROM candidates JOIN paragraphs USING (chunk_id, paragraph)"""


def own_metrics(paragraphs: DataFrame) -> DataFrame:
    """Metrics made of the figures of all chunks, so that every way of citing comes up: right and wrong paragraphs, quotes and values, and none."""
    c = candidates(paragraphs).join(paragraphs, ["chunk_id", "paragraph"])
    k = (F.col("chunk_id") + F.col("paragraph") + F.col("pos")) % 8
    value = F.when(k.isin(6, 7), F.col("value") * 1.5 + 7).otherwise(F.col("value"))
    quote = F.when(k.isin(3, 4), "this was never said").when(k.isin(5, 7), F.lit(None)).otherwise(F.substring("text", 1, 40))
    cited = F.when(k.isin(0, 3, 6), F.col("paragraph")).when(k == 1, 1)
    return c.select((F.col("chunk_id") * 1000000 + F.col("paragraph") * 1000 + F.col("pos")).alias("id"), "chunk_id", value.alias("value"), quote.alias("quote"), cited.alias("cited"))


@query("V1 J7 J8 E6", f"WITH {_sql_verified(_OWN_METRICS)} SELECT * FROM verified")
def figure_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chunk_paragraphs(spark, sf_dir)
    return verified(own_metrics(p), p)


@query("V2 A21 V3 V22", f"""WITH {_VERIFIED}
    SELECT s.chunk_id, bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS failed_count, count(*) AS metrics, coalesce(string_agg(lower(trim(field_name)) || ': ' || reason, '; ' ORDER BY id) FILTER (NOT passed), '') AS dispute
    FROM verified v JOIN structured_facts s ON s.structured_fact_id = v.id GROUP BY s.chunk_id""")
def provenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document: whether all metrics pass, how many don't, and the text that a dispute is opened with."""
    s = table(spark, sf_dir, "structured_facts").select(F.col("structured_fact_id").alias("id"), "chunk_id", F.lower(F.trim("field_name")).alias("field"))
    v = fact_verdicts(spark, sf_dir).join(s, "id")
    failed = ~F.col("passed")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("id", F.concat("field", F.lit(": "), "reason").alias("t"))))), lambda x: x["t"]), "; ")
    return v.groupBy("chunk_id").agg(F.bool_and("passed").alias("all_passed"), F.count_if(failed).alias("failed_count"), F.count("*").alias("metrics"), text.alias("dispute"))


@query("V10 J5 J6 V11 E26 V24 E25", f"""WITH {_VERIFIED},
    a AS (SELECT s.chunk_id, replace(lower(trim(field_name)), ' ', '_') AS field, arg_min(fact_value, structured_fact_id) AS value, arg_min(coalesce(v.passed, false), structured_fact_id) AS provenance_verified, arg_min(CASE WHEN chunk_index >= 0 THEN chunk_index ELSE -1 END, structured_fact_id) AS chunk_index
        FROM structured_facts s LEFT JOIN verified v ON v.id = s.structured_fact_id WHERE s.chunk_id IS NOT NULL AND field_name IS NOT NULL AND fact_value IS NOT NULL GROUP BY 1, 2)
    SELECT chunk_id, count(*) AS facts, count(*) FILTER (provenance_verified) AS verified, count(*) FILTER (chunk_index = -1) AS unknown_place, CASE WHEN bool_and(provenance_verified) THEN 'verified' WHEN bool_or(provenance_verified) THEN 'verified_with_warnings' ELSE 'disputed' END AS status FROM a GROUP BY chunk_id""")
def fact_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of an answer: one for each field, with its verdict (none counts as failed) and place, and the status they add up to."""
    s = table(spark, sf_dir, "structured_facts").where("chunk_id is not null and field_name is not null and fact_value is not null")
    j = s.join(fact_verdicts(spark, sf_dir).withColumnRenamed("id", "structured_fact_id"), "structured_fact_id", "left")
    first = lambda c: F.min_by(c, "structured_fact_id")
    a = j.groupBy("chunk_id", F.replace(F.lower(F.trim("field_name")), F.lit(" "), F.lit("_")).alias("field")).agg(first(F.col("fact_value")).alias("value"), first(F.coalesce("passed", F.lit(False))).alias("ok"), first(F.when(F.col("chunk_index") >= 0, F.col("chunk_index")).otherwise(-1)).alias("place"))
    status = F.when(F.bool_and("ok"), "verified").when(F.bool_or("ok"), "verified_with_warnings").otherwise("disputed")
    return a.groupBy("chunk_id").agg(F.count("*").alias("facts"), F.count_if("ok").alias("verified"), F.count_if(F.col("place") == -1).alias("unknown_place"), status.alias("status"))
