"""Files, streams, runs and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from filings import cli, report
from filings.operators.xbrl import questions
from filings.plans import answers
from filings.sources import fetch, files
from filings.streaming import ingest


def test_filings_there_and_back(spark, tables, tmp_path):
    s = spark.read.parquet(f"{tables}/filing_sections.parquet")
    files.write_filings(s, str(tmp_path / "raw"))
    back = files.read_filings(spark, str(tmp_path / "raw"))
    assert back.count() == s.count() and back.select("content").exceptAll(s.select("content")).count() == 0


def test_company_facts(spark, tmp_path):
    entry = {"form": "10-K", "fy": 2024, "fp": "FY", "start": "2024-01-01", "end": "2024-12-31", "val": 5e9, "filed": "2025-02-01"}
    (tmp_path / "a.json").write_text(json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": [entry, entry | {"start": None}]}}}}}))
    got = files.read_companyfacts(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["tag"], r["unit"], r["pos"], r["val"], r["start"]) for r in got] == [("Revenues", "USD", 0, 5e9, "2024-01-01"), ("Revenues", "USD", 1, 5e9, None)]


def test_questions_and_csv_and_vectors(spark, tables, tmp_path):
    q = questions(spark, tables)
    files.write_questions(q, str(tmp_path / "q"))
    assert files.read_questions(spark, str(tmp_path / "q")).count() == q.count()
    files.write_csv(q, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == q.count()
    files.write_vectors(q, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == q.count()


def test_log_scan(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"qid": "a", "pipeline": "prose"}\n\n{broken\n{"qid": "b", "pipeline": "prose"}\n')
    assert files.read_log(spark, str(tmp_path / "log.json")).where("qid is not null").count() == 2
    with pytest.raises(Exception):
        files.read_log(spark, str(tmp_path / "log.json"), strict=True).collect()


def test_run_resumes(spark, tables, tmp_path):
    log = str(tmp_path / "log")
    one = answers.run(spark, tables, log)
    n = one.count()
    assert n == 2 * spark.read.parquet(f"{tables}/eval_items.parquet").count()
    assert answers.run(spark, tables, log).count() == n  # nothing is answered twice


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s.json").write_text('{"size": 5, "agent": "x"}')
    monkeypatch.setenv("FILINGS_AGENT", "me@host")
    assert files.settings(str(tmp_path / "s.json")) == {"size": 5, "agent": "me@host"}


def test_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>hello</p>")
    spark.dataSource.register(fetch.Pages)
    got = spark.read.format("pages").option("urls", f"file://{tmp_path}/p.html file://{tmp_path}/none.html").load().orderBy("url").collect()
    assert got[0]["error"] is not None and got[1]["body"] == "<p>hello</p>"
    with pytest.raises(ValueError):
        fetch._Reader({"urls": "http://host/x", "agent": "nobody"})


def test_ingest_takes_files_once(spark, tables, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("src", "sink", "state"))
    s = spark.read.parquet(f"{tables}/filing_sections.parquet")
    for k in (0, 1):
        s.where(F.col("section_id") % 2 == k).write.mode("append").parquet(src)
        for _ in range(2):
            ingest.ingest(spark, src, sink, state).awaitTermination()
    assert spark.read.parquet(sink).count() == s.where("content is not null").count()


def test_late_totals(spark, tables, tmp_path):
    e = spark.readStream.schema(spark.read.parquet(f"{tables}/events.parquet").schema).parquet(f"{tables}/events.parqu[e]t")
    q = ingest.late_totals(e).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("late").agg(F.sum("n")).first()[0] <= spark.read.parquet(f"{tables}/events.parquet").count()


def test_grid_and_commands(spark, tables, capsys):
    assert "(more than 2 rows)" in report.grid(spark.range(3).toDF("a|b"), "t", 2)
    assert cli.main(["risks", tables, "--rows", "3"]) == 0
    assert "## risk_summary" in capsys.readouterr().out
