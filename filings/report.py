"""Small results as text. Only aggregates are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame


def grid(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A table of at most `most` rows in Markdown; a longer result is said to be longer."""
    rows = df.limit(most + 1).collect()
    head = df.columns
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"## {title}", ""] if title else []
    out += ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    out += ["| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows[:most]]
    return "\n".join(out + ([f"(more than {most} rows)"] if len(rows) > most else []))
