"""Chunkers: windows, groups of sentences, semantic splits."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.registry import query
from filings.run import rows, table

SIZE, STRIDE_OVERLAP = 512, 64
LEAST, MOST = 3, 8
THRESHOLD, MIN_TOKENS, MAX_TOKENS, PART_OVERLAP = 0.75, 100, 1000, 32


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = STRIDE_OVERLAP) -> DataFrame:
    """docs' columns with chunk_index, token_count and text for the column content. Windows start every size - overlap words; the first that reaches the end is the last. Texts without words have no chunk."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    n, stride = F.size("_w"), size - overlap
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    d = docs.where("content is not null").withColumn("_w", T.words(F.col("content"))).withColumn("_n", count).where("_n > 0")
    d = d.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_p", F.slice("_w", F.col("chunk_index") * stride + 1, F.lit(size)))
    return d.withColumn("token_count", F.size("_p")).withColumn("text", F.array_join("_p", " ")).drop("_w", "_n", "_p", "content")


def sentence_groups(docs: DataFrame, id_: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(id, chunk_index, sentences, text): groups of most sentences; a rest under least joins the group before, and a text of fewer has no chunk."""
    s = F.col("_s")
    groups = F.floor(F.size(s) / most) + F.when(F.size(s) % most >= least, 1).otherwise(0)
    d = docs.select(id_, T.sentences(F.col("content")).alias("_s")).withColumn("_g", groups.cast("int")).where("_g > 0")
    d = d.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    end = F.when(F.col("chunk_index") == F.col("_g") - 1, F.size(s)).otherwise((F.col("chunk_index") + 1) * most)
    d = d.withColumn("_p", F.slice(s, F.col("chunk_index") * most + 1, end - F.col("chunk_index") * most))
    return d.select(id_, "chunk_index", F.size("_p").alias("sentences"), F.array_join("_p", " ").alias("text"))


def _windows_sql(table_: str, id_: str, more: str = "") -> str:
    return f"""(SELECT {id_}{more}, CAST(i AS INTEGER) AS chunk_index, CAST(len(w[i * 448 + 1:i * 448 + 512]) AS INTEGER) AS token_count, array_to_string(w[i * 448 + 1:i * 448 + 512], ' ') AS text
        FROM (SELECT *, unnest(generate_series(0, CAST(CASE WHEN len(w) <= 512 THEN 0 ELSE ceil((len(w) - 512) / 448.0) END AS BIGINT))) AS i FROM (SELECT {id_}{more}, {T.sql_words('content')} AS w FROM {table_} WHERE content IS NOT NULL) WHERE len(w) > 0))"""


_GROUPS_SQL = f"""(SELECT section_id, CAST(k AS INTEGER) AS chunk_index, CAST(count(*) AS INTEGER) AS sentences, string_agg(x, ' ' ORDER BY pos) AS text FROM (
        SELECT section_id, x, pos, least((pos - 1) // 8, g - 1) AS k FROM (SELECT section_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos, len(s) // 8 + CASE WHEN len(s) % 8 >= 3 THEN 1 ELSE 0 END AS g
        FROM (SELECT section_id, {T.sql_sentences('content')} AS s FROM filing_sections WHERE content IS NOT NULL)) WHERE g > 0) GROUP BY section_id, k)"""


@query("C1 P8", f"SELECT * FROM {_windows_sql('filing_sections', 'section_id')}")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed(table(spark, sf_dir, "filing_sections").select("section_id", "content"))


@query("C2", f"SELECT * FROM {_GROUPS_SQL}")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_groups(table(spark, sf_dir, "filing_sections"), "section_id")


_DATE = "coalesce(filing_date, '')"


@query("C4 C5", f"SELECT {T.TICKER} || '_' || {_DATE} || '_' || coalesce(section_name, '') || '_fixed_' || chunk_index || '_' || accession_number AS id, section_id, company, {T.TICKER} AS ticker, filing_type, filing_date, section_name AS section, token_count FROM {_windows_sql('filing_sections', 'section_id', ', company, ticker, filing_type, filing_date, section_name, accession_number')} WHERE accession_number IS NOT NULL")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section's windows with its six metadata and an id; the accession number keeps filings of one day apart."""
    c = fixed(table(spark, sf_dir, "filing_sections").where("accession_number is not null").select("section_id", "company", F.upper(F.trim("ticker")).alias("ticker"), "filing_type", "filing_date", F.col("section_name").alias("section"), "accession_number", "content"))
    id_ = F.concat(F.concat_ws("_", "ticker", F.coalesce("filing_date", F.lit("")), F.coalesce("section", F.lit("")), F.lit("fixed"), "chunk_index"), F.lit("_"), F.col("accession_number"))
    return c.select(id_.alias("id"), "section_id", "company", "ticker", "filing_type", "filing_date", "section", "token_count")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


@query("E22 C3", """
    WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    c AS (SELECT label, vec_id, list_dot_product(e, b) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(b, b)) + 1e-8) AS c FROM p WHERE b IS NOT NULL)
    SELECT label, vec_id, round(c, 6) AS cosine, c < 0.75 AS split FROM c""")
def chunk_semantic_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where neighbours of one label are less alike than the threshold."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding").withColumn("b", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    c = e.where("b is not null").withColumn("c", cosine(F.col("embedding"), F.col("b")))
    return c.select("label", "vec_id", F.round("c", 6).alias("cosine"), (F.col("c") < THRESHOLD).alias("split"))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def bag(s: str) -> Counter:
    """The offline stand-in for a sentence's vector: its words."""
    return Counter(s.lower().split())


def semantic(text: str, embed: Callable[[str], Counter] = bag, threshold: float = THRESHOLD, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> list[list[str]]:
    """The chunks of text as lists of words or sentences. A small segment joins the chunk before if there is one; a large one is cut into windows of most // 2; the last segment is never cut."""
    s = [x for x in _SENTENCE.split(text.strip()) if x]
    if len(s) <= 1:
        return [s] if s else []
    v = [embed(x) for x in s]
    norm = [math.sqrt(sum(n * n for n in x.values())) for x in v]
    segments: list[list[str]] = [[s[0]]]
    for k in range(1, len(s)):
        dot = sum(n * v[k - 1][w] for w, n in v[k].items() if w in v[k - 1])
        if dot / (norm[k] * norm[k - 1] + 1e-8) < threshold:
            segments.append([])
        segments[-1].append(s[k])
    out: list[list[str]] = []
    for k, seg in enumerate(segments):
        w = " ".join(seg).split()
        if len(w) < least and out:
            out[-1] = out[-1] + seg
        elif len(w) > most and k < len(segments) - 1:
            step = most // 2 - PART_OVERLAP
            for a in range(0, max(1, len(w) - PART_OVERLAP), step):
                out.append([" ".join(w[a : a + most // 2])])
                if a + most // 2 >= len(w):
                    break
        else:
            out.append(seg)
    return out


def _semantic(section_id, content) -> Iterator[tuple]:
    for no, c in enumerate(semantic(content)):
        yield section_id, no, len(c), " ".join(c)


@query("C3 M1")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over a text's segments depends on the chunk before, so it runs by row in Arrow batches."""
    s = table(spark, sf_dir, "filing_sections").where("content is not null").select("section_id", "content")
    return rows(s, _semantic, "section_id long, chunk_index int, sentences int, text string", [pa.int64(), pa.int32(), pa.int32(), pa.string()])


CHUNKERS = {"fixed": chunk_fixed, "sentence": chunk_sentence, "semantic": chunk_semantic}


def chunker(strategy: str) -> Callable:
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return CHUNKERS[strategy]


@query("C6 V30", f"""
    SELECT 'fixed' AS chunk_strategy, section_id, count(*) AS chunks FROM {_windows_sql('filing_sections', 'section_id')} GROUP BY section_id
    UNION ALL SELECT 'sentence', section_id, count(*) FROM {_GROUPS_SQL} GROUP BY section_id""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: chunker(k)(spark, sf_dir).groupBy("section_id").agg(F.count("*").alias("chunks")).select(F.lit(k).alias("chunk_strategy"), "section_id", "chunks")
    return one("fixed").unionAll(one("sentence"))
