"""Parsing and segmentation of filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions import text as T
from filings.registry import query
from filings.run import table

SECTION_WORDS = 50  # a section has more
#: How a section's heading may begin: the item's number and words of its title.
_HEADS = {"risk_factors": ("1a", "risk factors"), "mda": ("7", "management"), "business_overview": ("1", "business"), "financial_statements": ("8", "financial statements")}
_GAP = r"[\s\u00a0.:\-–—]*"


@query("P2", f"SELECT section_id, {T.sql_clean('content')} AS content FROM filing_sections WHERE content IS NOT NULL")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "filing_sections").where("content is not null").select("section_id", T.clean(F.col("content")).alias("content"))


def html_text(c: Column) -> Column:
    """Scripts, styles and heads' tags dropped, other tags to line breaks, the common entities to characters."""
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<(?:meta|link)\b[^>]*>", ""), r"<[^>]+>", "\n")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(to))
    return T.strip(F.regexp_replace(c, rf"{T.WS}*\n{T.WS}*", "\n"))


_PAGE = ("<html><head><meta charset=utf-8><style>p {color: red}</style><script>var a = '<p>';</script></head><body><h1>", "</h1>\n<p>", "</p><link rel=x></body></html>")


def _sql_html() -> str:
    c = "'" + "' || coalesce(section_title, '') || '".join((_PAGE[0].replace("'", "''"), _PAGE[1])) + "' || content || '" + _PAGE[2] + "'"
    for tag in ("script", "style"):
        c = f"regexp_replace({c}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?i)<(?:meta|link)\\b[^>]*>', '', 'g'), '<[^>]+>', chr(10), 'g')"
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{to}')"
    return T.sql_strip(f"regexp_replace({c}, '{T.SQL_WS}*\\n{T.SQL_WS}*', chr(10), 'g')")


@query("P1", f"SELECT section_id, {_sql_html()} AS content FROM filing_sections WHERE content IS NOT NULL")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section, set as a page with a head, script and style, and read back as text."""
    page = F.concat(F.lit(_PAGE[0]), F.coalesce("section_title", F.lit("")), F.lit(_PAGE[1]), F.col("content"), F.lit(_PAGE[2]))
    return table(spark, sf_dir, "filing_sections").where("content is not null").select("section_id", html_text(page).alias("content"))


def _head(name: str, nbsp: str) -> str:
    gap = _GAP.replace("\\u00a0", nbsp)
    return rf"(?i)item[\s{nbsp}]*{_HEADS[name][0]}{gap}{_HEADS[name][1].replace(' ', rf'[\s{nbsp}]+')}"


_BODY = r"(?is)^(.*?)(?:\n\s*item[\s\u00a0]*\d+[a-z]?[\s\u00a0.:\-–—]+.*)?$"
_FIRST = {k: f"Item {v[0].upper()}. {v[1].title()}\n" for k, v in _HEADS.items()}
_SQL_BODY = _BODY.replace("\\u00a0", r"\x{a0}")


def _sql_sections() -> str:
    prefix = "CASE section_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIRST.items()) + " END"
    some = lambda k: f"list_transform(regexp_split_to_array(text, '{_head(k, chr(92) + 'x{a0}')}')[2:], lambda x: regexp_extract(x, '{_SQL_BODY}', 1))"
    parts = " UNION ALL ".join(f"SELECT accession_number, '{k}' AS section_name, {some(k)} AS s FROM texts" for k in _HEADS)
    content = T.sql_clean("coalesce(list_filter(s, lambda x: length(x) > 200)[1], s[1])")
    return f"""
    WITH one AS (SELECT accession_number, section_name, arg_min(content, section_id) AS content FROM filing_sections WHERE content IS NOT NULL GROUP BY 1, 2),
    texts AS (SELECT accession_number, '{''.join(_FIRST.values())}' || chr(10) || string_agg({prefix} || content, chr(10) ORDER BY section_name) AS text FROM one GROUP BY 1),
    parts AS ({parts}), cleaned AS (SELECT accession_number, section_name, {content} AS content FROM parts)
    SELECT * FROM cleaned WHERE len({T.sql_words('content')}) > {SECTION_WORDS}"""


def sections_of(filings: DataFrame) -> DataFrame:
    """(filing_id, section_name, content) of filings (filing_id, text): from a section's heading to the next item's, the whole of it.

    A first hit whose section is 200 characters or shorter is taken for the table of contents, and the next hit holds.
    """
    parts = []
    for name in _HEADS:
        split = F.split("text", _head(name, r"\u00a0"))
        some = F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda x: F.regexp_extract(x, _BODY, 1))
        long_ = F.filter(some, lambda x: F.length(x) > 200)
        parts.append(F.struct(F.lit(name).alias("section_name"), T.clean(F.when(F.size(long_) > 0, long_[0]).otherwise(F.try_element_at(some, F.lit(1)))).alias("content")))
    found = filings.select("filing_id", F.explode(F.array(*parts)).alias("s")).select("filing_id", "s.*")
    return found.where(F.size(T.words(F.col("content"))) > SECTION_WORDS)


@query("P3 S14", _sql_sections())
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings written out from their sections, with a table of contents, and sectioned again."""
    s = table(spark, sf_dir, "filing_sections").where("content is not null")
    no = F.create_map(*[F.lit(x) for kv in _FIRST.items() for x in kv])
    one = s.groupBy("accession_number", "section_name").agg(F.min_by("content", "section_id").alias("content"))
    text = one.groupBy("accession_number").agg(F.array_sort(F.collect_list(F.struct("section_name", F.concat(no[F.col("section_name")], F.col("content")).alias("c")))).alias("p"))
    toc = F.lit("".join(_FIRST.values()))
    return sections_of(text.select(F.col("accession_number").alias("filing_id"), F.concat(toc, F.lit("\n"), F.array_join(F.transform("p", lambda x: x["c"]), "\n")).alias("text"))).withColumnRenamed("filing_id", "accession_number")


_TITLE = "array_to_string(list_transform(string_split(replace(section_name, '_', ' '), ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ')"


@query("P4", f"SELECT section_id, section_name, {_TITLE} AS title, CAST(len({T.sql_words('content')}) AS INTEGER) AS words FROM filing_sections WHERE len({T.sql_words('content')}) > {SECTION_WORDS}")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of more than 50 words, with a title made from their name."""
    s = table(spark, sf_dir, "filing_sections").withColumn("words", F.size(T.words(F.col("content"))))
    return s.where(F.col("content").isNotNull() & (F.col("words") > SECTION_WORDS)).select("section_id", "section_name", F.initcap(F.replace("section_name", F.lit("_"), F.lit(" "))).alias("title"), "words")


def marked_paragraphs(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, paragraph, text): the texts after [N] or Paragraph N: at the start of a line; of one number the last holds. Without any mark, the blocks between blank lines, from 1."""
    c = F.regexp_replace(text, r"(?m)^[ \t]*(?:\[(\d+)\]|Paragraph (\d+):)", "\u0001$1$2\u0002")
    marked = docs.select(id_, F.posexplode(F.split(c, "\u0001")).alias("pos", "part")).where(F.col("part").contains("\u0002"))
    marked = marked.select(id_, "pos", F.substring_index("part", "\u0002", 1).try_cast("int").alias("paragraph"), T.strip(F.substring_index("part", "\u0002", -1)).alias("text"))
    marked = marked.groupBy(id_, "paragraph").agg(F.max_by("text", "pos").alias("text"))
    plain = docs.where(~F.coalesce(F.col(text).rlike(r"(?m)^[ \t]*(?:\[\d+\]|Paragraph \d+:)"), F.lit(True)))
    blocks = F.filter(F.transform(F.split(text, rf"\n{T.WS}*\n"), T.strip), lambda x: x != "")
    return marked.unionAll(plain.select(id_, F.posexplode(blocks).alias("p", "text")).select(id_, (F.col("p") + 1).alias("paragraph"), "text"))


SQL_PARAGRAPHS = rf"""
    docs AS (SELECT chunk_id, content, regexp_matches(content, '(?m)^[ \t]*(?:\[[0-9]+\]|Paragraph [0-9]+:)') AS m FROM chunks WHERE content IS NOT NULL),
    parts AS (SELECT chunk_id, unnest(string_split(regexp_replace(content, '(?m)^[ \t]*(?:\[([0-9]+)\]|Paragraph ([0-9]+):)', chr(1) || '\1\2' || chr(2), 'g'), chr(1))) AS part, generate_subscripts(string_split(regexp_replace(content, '(?m)^[ \t]*(?:\[([0-9]+)\]|Paragraph ([0-9]+):)', chr(1) || '\1\2' || chr(2), 'g'), chr(1)), 1) AS pos FROM docs WHERE m),
    marked AS (SELECT chunk_id, TRY_CAST(split_part(part, chr(2), 1) AS INTEGER) AS paragraph, arg_max({T.sql_strip('split_part(part, chr(2), 2)')}, pos) AS text FROM parts WHERE contains(part, chr(2)) GROUP BY ALL),
    blocks AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(content, '\n{T.SQL_WS}*\n', chr(1), 'g'), chr(1)), lambda x: {T.sql_strip('x')}), lambda x: x <> '') AS b FROM docs WHERE NOT m),
    paragraphs AS (SELECT * FROM marked UNION ALL SELECT chunk_id, CAST(generate_subscripts(b, 1) AS INTEGER) AS paragraph, unnest(b) AS text FROM blocks)"""


def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_paragraphs(table(spark, sf_dir, "chunks").where("content is not null").select("chunk_id", "content"), "chunk_id", "content")


@query("P5", f"WITH {SQL_PARAGRAPHS} SELECT chunk_id, paragraph, text FROM paragraphs")
def marker_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_paragraphs(spark, sf_dir)


@query("P6 A23", f"""
    WITH s AS (SELECT accession_number, section_id, unnest(string_split(content, chr(10) || chr(10))) AS t, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS pos FROM filing_sections WHERE content IS NOT NULL)
    SELECT accession_number, section_id, {T.sql_strip('t')} AS text, CAST(row_number() OVER (PARTITION BY accession_number ORDER BY section_id, pos) - 1 AS INTEGER) AS idx FROM s WHERE length({T.sql_strip('t')}) > 50""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of more than 50 characters, numbered over all sections of a filing."""
    s = table(spark, sf_dir, "filing_sections").where("content is not null").select("accession_number", "section_id", F.posexplode(F.split("content", "\n\n")).alias("pos", "t"))
    s = s.withColumn("text", T.strip(F.col("t"))).where(F.length("text") > 50)
    return s.select("accession_number", "section_id", "text", (F.row_number().over(Window.partitionBy("accession_number").orderBy("section_id", "pos")) - 1).alias("idx"))


@query("P7", f"WITH s AS (SELECT chunk_id, {T.sql_sentences('content')} AS s FROM chunks) SELECT chunk_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("chunk_id", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))


_PER_SECTION = "SELECT section_id, string_agg({body}, '{sep}' ORDER BY chunk_index, chunk_id) AS document FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY chunk_index, chunk_id) AS i FROM chunks WHERE content IS NOT NULL) GROUP BY section_id"
_META = "coalesce(company, '') || ' | ' || coalesce(filing_type, '') || ' | ' || coalesce(filing_date, '') || ' | ' || coalesce(section_name, '')"


def _joined(spark: SparkSession, sf_dir: str, body: Column, sep: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks").where("content is not null").withColumn("i", F.row_number().over(Window.partitionBy("section_id").orderBy("chunk_index", "chunk_id")))
    one = c.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("i", body.alias("b")))).alias("p"))
    return one.select("section_id", F.array_join(F.transform("p", lambda x: x["b"]), sep).alias("document"))


def _meta() -> Column:
    return F.concat_ws(" | ", *(F.coalesce(F.col(c), F.lit("")) for c in ("company", "filing_type", "filing_date", "section_name")))


@query("P9", _PER_SECTION.format(body=f"'[' || i || '] (' || {_META} || ')' || chr(10) || content", sep="\n\n"))
def evidence_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a section as one document of numbered paragraphs."""
    return _joined(spark, sf_dir, F.concat(F.lit("["), F.col("i"), F.lit("] ("), _meta(), F.lit(")\n"), F.col("content")), "\n\n")


@query("P10", _PER_SECTION.format(body=f"'[Document ' || i || '] ' || {_META} || chr(10) || content", sep="\n\n---\n\n"))
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir, F.concat(F.lit("[Document "), F.col("i"), F.lit("] "), _meta(), F.lit("\n"), F.col("content")), "\n\n---\n\n")


@query("P11 F12 E16", f"""SELECT {T.TICKER} AS ticker, string_agg(coalesce(section_name, '') || ' ' || coalesce(filing_date, '') || ': ' || {T.sql_shortened('content', 1500)}, chr(10) ORDER BY chunk_id) AS evidence, count(*) AS items
    FROM chunks WHERE content IS NOT NULL GROUP BY 1""")
def company_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by company, each text cut where a prompt cuts it."""
    c = table(spark, sf_dir, "chunks").where("content is not null").select(F.upper(F.trim("ticker")).alias("ticker"), "chunk_id", F.concat(F.coalesce("section_name", F.lit("")), F.lit(" "), F.coalesce("filing_date", F.lit("")), F.lit(": "), T.shortened(F.col("content"), 1500)).alias("e"))
    return c.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "e"))), lambda x: x["e"]), "\n").alias("evidence"), F.count("*").alias("items"))
