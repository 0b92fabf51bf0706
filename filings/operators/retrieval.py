"""Retrieval: exact dense top-k, BM25, rank fusion, reranking, by company and as a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from filings.functions import text as T
from filings.registry import query
from filings.run import table

K1, B, FLOOR = 1.5, 0.75, 0.25  # Okapi's usual constants; a negative idf becomes FLOOR times the mean idf
RRF, DENSE, SPARSE, KEY = 60, 0.6, 0.4, 100
TOP, POOL, PER_COMPANY = 10, 20, 5
BLOCK = 2048
SOME = 64
HITS, CELLS = 1 << 15, 1 << 20  # hits, and scores of documents and queries, that a task holds at a time
SENT = 1 << 20  # asked-for words of all queries that go to the tasks with the function


# --- dense -----------------------------------------------------------------------------------------------------------


def dense(data: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, same: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each query (id, v) the k rows of data (id, v) of the largest cosine, exactly; ties by id. Rows without a whole vector have no neighbours.

    Queries and data meet in blocks: one task multiplies at most about block queries with as many rows and keeps its k best
    of each query, so neither side is ever whole in a task. same: a column that a query and its rows share.
    """
    whole = lambda d: d.where("id is not null and v is not null and forall(v, x -> x is not null)")
    data, queries = whole(data), whole(queries)
    n, m = data.count(), queries.count()
    rows_, cols = max(1, -(-n // block)), max(1, -(-m // block))
    own = [same] if same else []
    d = data.select("id", "v", *own, F.pmod(F.xxhash64("id"), F.lit(rows_)).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), *own, F.pmod(F.xxhash64("id"), F.lit(cols)).alias("c")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows_ - 1))))
    keys = ["r", "c", *own]

    def block_best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = (np.array(t.column(c).to_pylist(), np.float64) for t, c in ((right, "qv"), (left, "v")))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
        s, ids, qs = a @ b.T, left.column("id").to_numpy(), right.column("query_id").to_numpy()
        order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 6)), axis=1)[:, :k]
        return pa.table({"query_id": np.repeat(qs, order.shape[1]), "id": ids[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})

    near = d.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(block_best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "id", F.round("score", 6).alias("score"), (F.col("r") - 1).alias("rank"))


_DENSE_SQL = """
    SELECT query_id, id, score, CAST(r - 1 AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) DESC, d.vec_id) AS r
        FROM embeddings q JOIN embeddings d ON {on} WHERE q.vec_id % 20 = 0) WHERE r <= 10"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e, e.where("id % 20 = 0")


@query("R1 S12 W1", _DENSE_SQL.format(on="true"))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(*_vectors(spark, sf_dir), TOP)


@query("R8 W1", _DENSE_SQL.format(on="q.label = d.label"))
def dense_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(*_vectors(spark, sf_dir), TOP, same="label")


def best(df: DataFrame, w, k: int) -> DataFrame:
    """The first k rows of each group, with rank from 0. The bare row number is filtered, so that each task keeps k rows of a group before anything is shuffled."""
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).withColumn("rank", F.col("r") - 1).drop("r")


# --- sparse ----------------------------------------------------------------------------------------------------------


def bags(docs: DataFrame, by: tuple = ()) -> DataFrame:
    """(*by, id, w, length, rows, words): the words of each document of docs (*by, id, content), of how many rows and words it is. Rows that share an id are one document; as putting them together shuffles all words, it is looked up first whether there are any."""
    t = docs.select(*by, "id", T.words(F.lower(F.col("content"))).alias("w"))
    if docs.groupBy(*by, "id").count().where("count > 1").isEmpty():
        return t.withColumns({"length": F.size("w"), "rows": F.lit(1), "words": F.size("w")})
    return t.groupBy(*by, "id").agg(F.flatten(F.collect_list("w")).alias("w"), F.first(F.when(F.size("w") > 0, F.size("w")), True).alias("length"), F.count("*").alias("rows"), F.sum(F.size("w")).alias("words"))


def each(c):
    """As rows (term), a null for none: before a plain explode Spark puts a filter that splits every text once more."""
    return F.explode_outer(c).alias("term")


def asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(T.words(F.lower(F.col("text")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def weights(b: DataFrame, by: tuple = ()) -> DataFrame:
    """(*by, term, weight, mean_length) of all terms of bags b, with the statistics of each part. What holds for a part is one row of it, sent to all tasks: no term is shuffled for it."""
    beside = lambda x, y: x.join(F.broadcast(y), [*by]) if by else x.crossJoin(F.broadcast(y))
    own = lambda c: F.sum(F.when(F.col("term").isNull(), F.col(c))).alias(c)
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Each document has a null beside its words, whose group has the part's totals. Both sides name all sums, so that they share one reading of the texts.
    t = b.select(*by, "rows", "words", each(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string"))))).groupBy(*by, "term").agg(F.count("*").alias("df"), own("rows"), own("words"))
    same = t.groupBy(*by, "df", "rows", "words").agg(F.count("*").alias("n"))  # a part's terms of one frequency have one idf: the mean is taken over these few rows
    totals = same.where("rows is not null and words is not null").select(*by, F.col("rows").alias("docs"), (F.col("words") / F.col("rows")).alias("mean_length"))
    part = beside(same.where("rows is null and words is null"), totals).groupBy(*by).agg((F.sum(F.col("n") * idf) / F.sum("n")).alias("mean_idf"), F.first("docs").alias("docs"), F.first("mean_length").alias("mean_length"))
    df = t.where("rows is null and words is null and df > 0").select(*by, F.coalesce("term", F.lit("")).alias("term"), "df")  # else a join by term sends a filter of its own to the texts
    return beside(df, part).withColumn("idf", idf).select(*by, "term", F.when(F.col("idf") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("idf")).alias("weight"), "mean_length")


def matched(b: DataFrame, q: DataFrame, by: tuple = (), terms: DataFrame | None = None) -> DataFrame:
    """(*by, id, term, tf, norm) for each term of a document that any query asks for, and with terms (see weights) its gain for each time that it is asked for.

    Only words that are asked for leave their task, and they are partitioned by document: all hits of a query and a document
    meet where they are made, so that of the many pairs only the best of a partition are shuffled. norm: the root of the sum of all tf squared.
    """
    run = F.aggregate(F.sort_array("w"), F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum")), lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"], a["n"] + 1).otherwise(1).alias("n"), (a["sum"] + F.when(x == a["last"], 2 * a["n"] + 1).otherwise(1)).alias("sum")))
    one = b.select(*by, "id", "length", "w", F.sqrt(run["sum"]).alias("norm")).select(*by, "id", "length", "norm", each("w"))  # the norm in a step of its own: else it is made again for each word
    words, first = q.select("term").distinct(), lambda *cs: [F.first(c).alias(c) for c in cs]
    gain_ = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    gained = lambda p: p.select(*by, "id", "term", "tf", "norm", gain_.alias("gain"))
    if terms is None:
        return one.join(words, "term", "left_semi").repartition(*by, "id").groupBy(*by, "id", "term").agg(F.count("*").alias("tf"), *first("norm"))
    if by:
        p = one.join(words, "term", "left_semi").repartition(*by, "term").groupBy(*by, "id", "term").agg(F.count("*").alias("tf"), *first("length", "norm"))
        return gained(p.join(terms.join(words, "term", "left_semi").hint("shuffle_hash"), [*by, "term"])).repartition(*by, "id")  # the weights are the fewer, and a sort by term takes longer
    # no more weights than words asked for
    p = one.join(F.broadcast(words), "term", "left_semi").repartition("id").groupBy("id", "term").agg(F.count("*").alias("tf"), *first("length", "norm"))
    return gained(p.join(F.broadcast(terms.join(words, "term", "left_semi")), "term"))


def hits(b: DataFrame, q: DataFrame, by: tuple = (), terms: DataFrame | None = None) -> DataFrame:
    """(query_id, *by, id, term, times, tf, norm) for each term that a query and a document share; see matched."""
    return matched(b, q, by, terms).join(q, "term")


def gain():
    return F.round(F.sum(F.col("times") * F.col("gain")), 6)


def dot() -> list:
    return [F.sum(F.col("tf") * F.col("times")).alias("dot"), F.first("norm").alias("norm")]


def cosine():
    return F.round(F.col("dot") / (F.col("norm") * F.col("qnorm") + 1e-8), 6)


def bm25(docs: DataFrame, queries: DataFrame, k: int, by: tuple = ()) -> DataFrame:
    """(query_id, *by, id, score, rank): the k best of each query and part, with the statistics of the part; of those only scores above 0."""
    b, q = bags(docs, by), asked(queries)
    terms = weights(b, by)
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    if by and q.count() <= SENT:
        return best(near_best(matched(b, q, by, terms), q.toArrow(), k, by).withColumn("score", F.round("score", 6)), w, k).where("score > 0")
    scores = lambda b: hits(b, q, by, terms).groupBy("query_id", *by, "id").agg(gain().alias("score"))
    s = scores(b)
    if not by:  # floors by part would be as many as queries and parts
        s = s.join(F.broadcast(floors(scores(some(b)), k)), "query_id", "left").where(reaches("score", "floor"))
    return best(s, w, k).where("score > 0").drop("floor")


def near_best(p: DataFrame, q: pa.Table, k: int, by: tuple) -> DataFrame:
    """(query_id, *by, id, score) of p (see matched) and the asked-for words q: of each query and part at least the k best above 0, score not rounded. What is left out has k better ones by more than rounding.

    Spark would make a row for each word that a query and a document share and hash and sort all pairs, which takes most of
    the time and memory. Here a task adds the scores of a few documents at a time and keeps their best of each query and part.
    """
    q = q.sort_by("term")
    names, lengths = (x := q["term"].combine_chunks().value_counts()).field("values"), x.field("counts").to_numpy()
    starts = np.cumsum(lengths) - lengths
    who = q["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    which, who, times = who.indices.to_numpy(), who.dictionary, q["times"].to_numpy().astype(np.float64)
    m, keys = len(who), [*by, "id"]
    p = p.select(*keys, "term", "gain")
    schema = S.StructType([S.StructField("query_id", S.LongType()), *(p.schema[c] for c in keys), S.StructField("score", S.DoubleType())])

    def begins(t: pa.Table, columns) -> np.ndarray:
        """Where a row differs from the last."""
        codes = [t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in columns]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, parts = begins(t, keys), begins(t, by)
        ends = np.r_[rows[1:], t.num_rows]
        word, gain_ = pc.index_in(t["term"].combine_chunks(), names).to_numpy(), t["gain"].to_numpy()
        step = max(1, CELLS // m)
        for at in range(0, len(rows), step):
            first, to = rows[at : at + step], ends[at : at + step]
            lo, hi, n = first[0], to[-1], len(first)
            many = lengths[word[lo:hi]]
            hit = np.repeat(np.arange(lo, hi), many)
            entry = np.arange(len(hit)) + np.repeat(starts[word[lo:hi]] - np.cumsum(many) + many, many)
            doc = np.repeat(np.arange(n), to - first)[hit - lo]
            s = np.bincount(doc * m + which[entry], gain_[hit] * times[entry], n * m).reshape(n, m)
            cuts = np.unique(np.r_[0, np.searchsorted(first, parts[(parts > lo) & (parts < hi)]), n])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > k:
                    s[a:b][s[a:b] < np.partition(s[a:b], b - a - k, axis=0)[b - a - k] - 2e-6] = 0
            d, x = np.nonzero(s > 0)
            found = t.select(keys).take(first[d]).combine_chunks()
            yield from pa.table([who.take(pa.array(x)), *found.columns, pa.array(s[d, x])], names=["query_id", *keys, "score"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HITS:
                t = pa.Table.from_batches(held)
                last = int(begins(t, keys)[-1])  # this document may go on
                yield from of(t.slice(0, last)) if last else ()
                held = t.slice(last).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from of(t)

    return p.sortWithinPartitions(*keys).mapInArrow(run, schema)


def some(b: DataFrame) -> DataFrame:
    """One document in SOME of b. Its best set the floors only: what they leave out can't be among the best of all."""
    return b.where(F.pmod(F.xxhash64("id"), F.lit(SOME)) == 0)


def floors(s: DataFrame, k: int, kind: tuple = ()) -> DataFrame:
    """(query_id, *kind, floor) of scores s of some documents: a little less than the kth score, as sums differ in their last digits with the order of their rows. Of all documents k at least score so much, so that pairs below needn't be sorted; queries with fewer have no floor."""
    w = Window.partitionBy("query_id", *kind).orderBy(F.desc("score"), "id")
    return best(s, w, k).where(F.col("rank") == k - 1).select("query_id", *kind, (F.col("score") - 2e-6).alias("floor"))


def reaches(score: str, floor: str):
    return F.col(floor).isNull() | (F.col(score) >= F.col(floor))


def words_cosine(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) by the cosine of word counts: the offline stand-in for sentence vectors."""
    q = asked(queries)
    qnorm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("times") * F.col("times"))).alias("qnorm"))
    s = hits(bags(docs), q).groupBy("query_id", "id").agg(*dot()).where("id is not null").join(qnorm, "query_id").select("query_id", "id", cosine().alias("score"))
    return best(s, Window.partitionBy("query_id").orderBy(F.desc("score"), "id"), k)


def _sql(part: str = "''") -> str:
    return f"""
    docs AS (SELECT {part} AS part, chunk_id AS id, content, {T.sql_words('lower(content)')} AS w FROM chunks WHERE content IS NOT NULL),
    p AS (SELECT part, id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT part, id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY part, id, term),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({T.sql_words('lower(text)')}) AS term FROM eval_items) GROUP BY query_id, term),
    totals AS (SELECT part, count(*) AS docs, avg(len(w)) AS mean_length FROM docs GROUP BY part),
    df AS (SELECT part, term, docs, mean_length, ln((docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT part, term, count(*) AS df FROM p GROUP BY part, term) JOIN totals USING (part)),
    terms AS (SELECT part, term, mean_length, CASE WHEN idf < 0 THEN {FLOOR} * mean_idf ELSE idf END AS weight FROM df JOIN (SELECT part, avg(idf) AS mean_idf FROM df GROUP BY part) USING (part)),
    bm AS (SELECT query_id, part, id, round(sum(times * weight * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * length / mean_length))), 6) AS score FROM p JOIN terms USING (part, term) JOIN q USING (term) GROUP BY query_id, part, id),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) - 1 AS rank FROM bm),
    cos AS (SELECT query_id, part, id, round(dot / (norm * qnorm + 1e-8), 6) AS score FROM (SELECT query_id, part, id, sum(tf * times) AS dot FROM p JOIN q USING (term) GROUP BY query_id, part, id)
        JOIN (SELECT part, id, sqrt(sum(tf * tf)) AS norm FROM p GROUP BY part, id) USING (part, id) JOIN (SELECT query_id, sqrt(sum(times * times)) AS qnorm FROM q GROUP BY query_id) USING (query_id)),
    near AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) - 1 AS rank FROM cos)"""


def _hybrid_sql(pool: int) -> str:
    side = lambda t: f"SELECT query_id, key, min(rank) AS first, max(rank) AS last, arg_max(id, rank) AS last_id, arg_min(id, rank) AS first_id FROM (SELECT t.*, d.content[1:{KEY}] AS key FROM {t} t JOIN docs d USING (id) WHERE rank < {2 * pool}{' AND score > 0' if t == 'sparse' else ''}) GROUP BY query_id, key"
    return f"""{_sql()},
    fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.last_id, b.first_id) AS id, round(coalesce({DENSE} / ({RRF} + a.last), 0) + coalesce({SPARSE} / ({RRF} + b.last), 0), 9) AS score, a.first AS af, b.first AS bf
        FROM ({side('near')}) a FULL JOIN ({side('sparse')}) b ON a.query_id = b.query_id AND a.key = b.key),
    hybrid AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, af ASC NULLS LAST, bf ASC NULLS LAST, id) - 1 AS rank FROM fused) WHERE rank < {pool})"""


def _docs(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("content is not null").select(*more, F.col("chunk_id").alias("id"), "content")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text")


_OUT = ("query_id", "id", "score", "rank")


@query("R2 R3 R4 F10 W1", f"WITH {_sql()} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank < {TOP} AND score > 0")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_docs(spark, sf_dir), _items(spark, sf_dir), TOP).select(*_OUT)


@query("R1 M1 W1", f"WITH {_sql()} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank < {TOP}")
def words_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_cosine(_docs(spark, sf_dir), _items(spark, sf_dir), TOP).select(*_OUT)


def tops(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(kind, query_id, id, score, rank): what words_cosine (kind dense) and bm25 (kind sparse) find, both from one reading of the texts."""
    b, q = bags(docs), asked(queries)
    terms = weights(b)
    qnorm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("times") * F.col("times"))).alias("qnorm"))
    side = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("score"))

    def pairs(b: DataFrame) -> DataFrame:
        p = hits(b, q, (), terms).groupBy("query_id", "id").agg(gain().alias("sparse"), *dot())
        return p.join(qnorm, "query_id", "left").select("query_id", "id", "sparse", F.when(F.col("id").isNotNull(), cosine()).alias("dense"))

    def sides(p: DataFrame) -> DataFrame:
        return p.select("query_id", "id", F.explode(F.array(side("dense"), side("sparse"))).alias("x")).select("query_id", "id", "x.*").where("kind = 'sparse' or score is not null")

    floor = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("floor"))).alias(f"{kind}_floor")
    f = floors(sides(pairs(some(b))), k, ("kind",)).groupBy("query_id").agg(floor("dense"), floor("sparse"))
    s = sides(pairs(b).join(F.broadcast(f), "query_id", "left").where(reaches("dense", "dense_floor") | reaches("sparse", "sparse_floor")))
    return best(s, Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id"), k).where("kind = 'dense' or score > 0")


def fuse(found: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Weighted reciprocal ranks of tops over the keys of both sides. A key's duplicates: the last has the say on the score, the first on the order of ties; the dense side's last or else the sparse side's first is shown."""
    x = docs.select("id", F.substring("content", 1, KEY).alias("key")).join(F.broadcast(found), "id")
    rank = lambda kind: F.when(F.col("kind") == kind, F.col("rank"))
    j = x.groupBy("query_id", "key").agg(F.min(rank("dense")).alias("a_first"), F.max(rank("dense")).alias("a_last"), F.max_by("id", rank("dense")).alias("a_max"), F.min(rank("sparse")).alias("b_first"), F.max(rank("sparse")).alias("b_last"), F.min_by("id", rank("sparse")).alias("b_min"))
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(RRF) + F.col(c)), F.lit(0.0))
    j = j.select("query_id", F.coalesce("a_max", "b_min").alias("id"), F.round(part(DENSE, "a_last") + part(SPARSE, "b_last"), 9).alias("score"), "a_first", "b_first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("a_first"), F.asc_nulls_last("b_first"), "id")
    return best(j, w, k).select(*_OUT)


def _hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return fuse(tops(docs, _items(spark, sf_dir), 2 * k), docs, k)


@query("R5 J14", f"WITH {_hybrid_sql(TOP)} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, TOP)


@query("R6 M2", f"""WITH {_hybrid_sql(POOL)},
    overlap AS (SELECT h.query_id, h.id, h.rank, round(len(list_intersect(list_distinct({T.sql_words('lower(e.text)')}), d.w)) / len(list_distinct({T.sql_words('lower(e.text)')})), 6) AS score FROM hybrid h JOIN docs d USING (id) JOIN eval_items e ON e.item_id = h.query_id)
    SELECT query_id, id, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM overlap) WHERE r <= {TOP}""")
def hybrid_rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid's pool, scored pair by pair with the share of the question's words (the offline stand-in for a cross-encoder)."""
    pool = _docs(spark, sf_dir).join(F.broadcast(_hybrid(spark, sf_dir, POOL)), "id").withColumn("d", T.words(F.lower(F.col("content"))))  # a few rows for each question are sent to the texts
    q = _items(spark, sf_dir).select("query_id", F.array_distinct(T.words(F.lower(F.col("text")))).alias("q"))
    s = pool.withColumnRenamed("rank", "pool_rank").join(q, "query_id").select("query_id", "id", "pool_rank", F.round(F.when(F.size("q") == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect("q", "d")), F.size("q"))), 6).alias("score"))
    return best(s.drop("rank"), Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank"), TOP).select(*_OUT)


def by_company(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return bm25(_docs(spark, sf_dir, F.upper(F.trim("ticker")).alias("ticker")).where("ticker is not null"), _items(spark, sf_dir), k, ("ticker",)).select("query_id", "ticker", "id", "score", "rank")


@query("R8 A23", f"WITH {_sql(T.TICKER)} SELECT query_id, part AS ticker, id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank < {PER_COMPANY} AND score > 0")
def multi_company_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's best chunks for each question, by the company's own statistics; one plan for all of them."""
    return by_company(spark, sf_dir, PER_COMPANY)


RETRIEVERS = {"dense": words_topk, "sparse": bm25_topk, "hybrid": hybrid_rrf, "hybrid_reranked": hybrid_rerank_lexical}


def retriever(strategy: str):
    if strategy not in RETRIEVERS:
        raise ValueError(f"unknown retrieval strategy: {strategy}")
    return RETRIEVERS[strategy]


@query("R7 R9 V30", f"""WITH {_hybrid_sql(TOP)}, c AS (SELECT chunk_id AS id, chunk_strategy FROM chunks)
    SELECT chunk_strategy, retrieval_strategy, count(*) AS hits, count(DISTINCT id) AS chunks FROM (
        SELECT 'dense' AS retrieval_strategy, id FROM near WHERE rank < {TOP} UNION ALL SELECT 'sparse', id FROM sparse WHERE rank < {TOP} AND score > 0 UNION ALL SELECT 'hybrid', id FROM hybrid) JOIN c USING (id) GROUP BY 1, 2""")
def retrieval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits each kind of chunk gets with each kind of retrieval."""
    docs = _docs(spark, sf_dir)
    found = tops(docs, _items(spark, sf_dir), 2 * TOP)  # the tops of each kind are the first of what the hybrid fuses
    hits = found.where(F.col("rank") < TOP).select(F.col("kind").alias("retrieval_strategy"), "id").unionAll(fuse(found, docs, TOP).select(F.lit("hybrid"), "id"))
    c = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("id"), "chunk_strategy")
    return c.join(F.broadcast(hits), "id").groupBy("chunk_strategy", "retrieval_strategy").agg(F.count("*").alias("hits"), F.countDistinct("id").alias("chunks"))
