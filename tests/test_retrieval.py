"""Retrieval at size: what its plans shuffle, and documents of several rows."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from filings import catalogue
from filings.operators import retrieval

SCORED = ["bm25_topk", "multi_company_topk", "hybrid_rrf"]


@pytest.mark.parametrize("name", SCORED)
def test_pairs_are_not_shuffled(spark, tables, name):
    """Not all pairs of a query and a document go through a shuffle, and no join is one of all rows with all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan
    assert not re.search(r"Exchange hashpartitioning\(query_id#\w+, (\w*#\w+, )?id#", plan)


@pytest.mark.parametrize("name", SCORED)
def test_rows_that_share_an_id(spark, tables, tmp_path, name):
    con = duckdb.connect()
    for t in ("chunks", "eval_items"):
        x = pq.read_table(f"{tables}/{t}.parquet")
        pq.write_table(x if t == "eval_items" else x.take([*range(x.num_rows), *range(0, x.num_rows, 3)]), tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    r = con.execute(catalogue.SQL[name])
    cols = [x[0] for x in r.description]
    plain = lambda rows: Counter(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows)
    assert plain(df.select(*cols).collect()) == plain(r.fetchall())


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rrf", "retrieval_grid", "gold_word_overlap", "retrieval_quality", "hybrid_rerank_lexical", "verified_answers"])
def test_floors_leave_the_best(spark, tables, tmp_path, monkeypatch, name):
    """Every second document sets floors, so that they leave out most pairs before these are sorted; the rows are those of the SQL."""
    monkeypatch.setattr(retrieval, "SOME", 2)
    con = duckdb.connect()
    for t in ("chunks", "eval_items", "reconciliation_findings", "structured_facts"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, tables)
    assert "floor#" in df._jdf.queryExecution().executedPlan().toString()
    r = con.execute(catalogue.SQL[name])
    cols = [x[0] for x in r.description]
    plain = lambda rows: Counter(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows)
    assert plain(df.select(*cols).collect()) == plain(r.fetchall())


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rrf", "multi_company_topk", "multi_doc_answers"])
def test_statistics_share_one_reading(spark, tables, name):
    """What the terms' weights need of the documents (frequencies, their mean, lengths) is one shuffle, used again."""
    df = catalogue.QUERIES[name](spark, tables)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Generate explode\(concat\(array_distinct", plan)) == 1


@pytest.mark.parametrize("name", ["retrieval_grid", "gold_word_overlap", "retrieval_quality", "hybrid_rerank_lexical", "verified_answers"])
def test_texts_are_not_shuffled_for_what_was_found(spark, tables, name):
    """What was found is sent to the chunks, not the chunks to what was found."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin \[id#", plan)
    assert name != "verified_answers" or len(re.findall(r"SortMergeJoin \[chunk_id#", plan)) == 2  # those of the facts


OF_COMPANIES = ["multi_company_topk", "multi_doc_answers"]


@pytest.mark.parametrize("name", OF_COMPANIES)
def test_pairs_of_companies_are_not_hashed(spark, tables, name):
    """A task adds scores a few documents at a time: there is no row for each pair of a question and a document that is hashed or sorted."""
    plan = catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[query_id#\w+, ticker#\w+, id#", plan)


@pytest.mark.parametrize(("name", "few"), [(n, f) for n in OF_COMPANIES for f in ({"HITS": 40, "CELLS": 200}, {"HITS": 1, "CELLS": 1}, {"SENT": 0})])
def test_companies_in_small_steps(spark, tables, tmp_path, monkeypatch, name, few):
    """Documents and companies that go on from one step to the next, rows that share an id, and nulls; the rows are those of the SQL."""
    for k, v in few.items():
        monkeypatch.setattr(retrieval, k, v)
    con = duckdb.connect()
    for t in ("chunks", "eval_items"):
        x = pq.read_table(f"{tables}/{t}.parquet")
        key = {"chunks": "chunk_id", "eval_items": "item_id"}[t]
        odd = pa.Table.from_pylist([r | {key: None} for r in x.slice(0, 1).to_pylist()] + x.slice(5, 20).to_pylist() * (t == "chunks"), schema=x.schema)
        pq.write_table(pa.concat_tables([x, odd]), tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    r = con.execute(catalogue.SQL[name])
    cols = [x[0] for x in r.description]
    plain = lambda rows: Counter(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row) for row in rows)
    assert plain(df.select(*cols).collect()) == plain(r.fetchall())


def test_answers_over_companies_keep_one_chunk_of_each(spark, tables):
    """Only the best chunk of each company is looked for: a task keeps one of each question and company."""
    plan = catalogue.QUERIES["multi_doc_answers"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert {int(k) for k in re.findall(r"WindowGroupLimit.*row_number\(\), (\d+),", plan)} == {1}
