"""Each query against its SQL, and over empty and odd tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from filings import catalogue


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for f in Path(tables).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, tables, con, name):
    df = catalogue.QUERIES[name](spark, tables)
    r = con.execute(catalogue.SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in row) for row in r.fetchall())
    assert Counter(tuple(plain(v) for v in row) for row in df.select(*cols).collect()) == want


@pytest.mark.parametrize("kind", ["empty", "odd"])
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_odd_tables(spark, odd_tables, kind, name):
    n = catalogue.QUERIES[name](spark, odd_tables[kind]).count()
    assert kind == "odd" or n == (name == "bucket_d_score")


@pytest.mark.parametrize("name", ["chunk_fixed", "chunk_sentence", "bm25_topk", "hybrid_rrf", "quote_provenance", "numeric_claims", "xbrl_index", "reconcile_delta", "risk_signals", "json_repair"])
def test_plans_stay_in_the_jvm(spark, tables, name):
    plan = catalogue.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_scans_read_only_what_is_used(spark, tables):
    plan = catalogue.QUERIES["sections_by_filter"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
