"""python -m filings.cli COMMAND DIR [--ticker T]: the queries behind each command, printed as tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from filings import catalogue
from filings.report import grid

COMMANDS = {
    "ingest": ("section_rows", "filing_totals"),
    "benchmark": ("retrieval_grid", "config_summary", "pairwise_win_rate"),
    "query": ("hybrid_rerank_lexical",),
    "risks": ("risk_summary", "risk_profile"),
    "compare": ("shared_unique_categories",),
    "temporal": ("consecutive_change",),
    "multidoc": ("multi_doc_answers",),
    "diff": ("paragraph_diff", "change_stats"),
    "verify": ("verified_answers", "provenance_report"),
    "reconcile": ("reconciliation_report", "bucket_d_score"),
    "report": ("report_lines", "pass_rate_wilson", "latency_summary", "mcnemar_exact"),
}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="filings")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("dir", help="folder of the tables")
    p.add_argument("--ticker", help="only the rows of this ticker, where a result has one")
    p.add_argument("--rows", type=int, default=50, help="rows shown of each result")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("filings").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in COMMANDS[a.command]:
        df = catalogue.QUERIES[name](spark, a.dir)
        if a.ticker and "ticker" in df.columns:
            df = df.where(F.col("ticker") == a.ticker.strip().upper())
        print(grid(df, name, a.rows), end="\n\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
