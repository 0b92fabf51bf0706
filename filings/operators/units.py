"""Problem 7: stored numbers that are not in the common unit, with the true amount."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions.units import resolve
from filings.registry import query
from filings.run import rows, table, ticker


def _alias(spelling) -> Iterator[tuple]:
    kind, by = resolve(spelling) or ("unknown", 0.0)
    yield spelling, kind, by


def aliases(units: DataFrame) -> DataFrame:
    """(spelling, kind, factor) of the distinct spellings of the one column of units."""
    return rows(units.where(F.trim(units.columns[0]) != "").distinct(), _alias, "spelling string, kind string, factor double", [pa.string(), pa.string(), pa.float64()])


def with_unit(df: DataFrame, pct: F.Column) -> DataFrame:
    """df with by: how much of the common unit one of the column unit is. Null: nothing is said. 0: another currency, shares, or a spelling near to nothing."""
    a = aliases(df.select("unit"))
    share = F.when(F.col("kind") == "percent", F.col("factor")).otherwise(1.0)
    money = F.when(F.col("kind") == "usd", F.col("factor")).otherwise(0.0)
    blank = F.trim(F.coalesce("unit", F.lit(""))) == ""
    return df.join(a, df["unit"] == a["spelling"], "left").withColumn("by", F.when(blank, F.lit(None).cast("double")).when(pct, share).otherwise(money)).drop("spelling", "kind", "factor")


_NUMBER = re.compile(r"\d{1,3}(?:[.,\s]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?")
_AFTER = re.compile(r"\s?((?:[^\W\d_]|[.'%$\-])+(?: (?:[^\W\d_]|[.'$\-])+){0,3})")
_EASTERN = re.compile(r"\s?([十億亿百万]*(?:米ドル|ドル|美元))")
_NOTE = re.compile(r"\(([^()]*)\)\s*:?\s*$|\b([Ii]n [a-z]+ of [A-Za-z ]+?),")
_SIGN = re.compile(r"(US\$|U\.S\.\$|\$)\s?$")
_COMMA = re.compile(r"\b(?:Mio|Mrd|Tsd)\b|US-Dollar|\bde dollars|\blag bei\b|\d ?,\d+ %")


def _scale(head: str, tail: str) -> float | None:
    """What the words beside a number say of its unit, in USD millions."""
    sign, note = _SIGN.search(head), _NOTE.search(head)
    if m := _EASTERN.match(tail):
        unit = resolve(m[1])
        return unit[1] if unit and unit[0] == "usd" else None
    if m := _AFTER.match(tail):
        w = m[1].split(" ")
        for n in range(len(w), 0, -1):
            said = " ".join(w[:n]).rstrip(".,")
            for phrase in (f"{sign[1]} {said}", said) if sign else (said, f"$ {said}" if n == 1 and len(said) > 2 else said):
                if (unit := resolve(phrase)) and unit[0] == "usd" and (sign or unit[1] != 1e-6 or "dollar" in phrase.lower()):
                    return unit[1]
                if unit and unit[0] == "other":
                    return None
    if note and (unit := resolve(note[1] or note[2])) and unit[0] == "usd":
        return unit[1]
    return 1e-6 if sign else None


def stated(text: str | None, pct: bool) -> float | None:
    """The figure that a text states with its unit, in the common unit."""
    if not text:
        return None
    s = " ".join(text.split())
    m = next((m for m in _NUMBER.finditer(s) if not s.startswith("000s", m.start())), None)
    if not m:
        return None
    n = m[0].replace(" ", "")
    n = n.replace(".", "").replace(",", ".") if _COMMA.search(s) else n.replace(",", "")
    x = float(n)
    head, tail = s[: m.start()], s[m.end() :]
    if pct:
        if re.search(r"\bbps\b|basis points", s):
            return x / 100
        if re.search(r"ratio|fraction", s):
            return x * 100
        return x if re.search(r"%|per ?cent", s) else None
    by = _scale(head, tail)
    return None if by is None else x * by


def _case(name, record_id, pct, value, said, unit) -> Iterator[tuple]:
    """said: a text's figure. unit: of the column, or None."""
    by = 100 if pct else 1000
    if said is not None:
        true = abs(said) if value >= 0 else -abs(said)
        if abs(value - true) > 1e-6 * abs(true):
            yield name, record_id, round(true * by)
    elif unit and unit != 1:
        yield name, record_id, round(value * unit * by)


def _structured(record_id, field, value, unit, text) -> Iterator[tuple]:
    pct = field is not None and field.endswith("_pct")
    yield from _case("structured_facts", record_id, pct, value, stated(text, pct), unit)


#: What one unit of a prose value can be in USD millions, where only the tagged value tells it.
_POWERS = (1e-6, 1e-3, 1.0, 1e3)


def _finding(record_id, field, value, xbrl, text) -> Iterator[tuple]:
    pct = field is not None and field.endswith("_pct")
    said, unit = stated(text, pct), None
    if said is None and xbrl and value and not pct:
        unit = min(_POWERS, key=lambda s: max(a := abs(value * s), b := abs(xbrl)) / min(a, b))
    yield from _case("reconciliation_findings", record_id, pct, value, said, unit)


_SCHEMA, _TYPES = "table_name string, record_id long, amount long", [pa.string(), pa.int64(), pa.int64()]


def _xbrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    t = table(spark, sf_dir, "xbrl_facts").where("value_usd_millions is not null and not isnan(value_usd_millions)").select("fact_id", ticker().alias("ticker"), "field", F.col("value_usd_millions").alias("v"), "unit", F.greatest(F.lit(1.0), F.round(F.col("duration_days") / 91)).alias("quarters"))
    t = with_unit(t, F.lit(False)).where("by is null or by <> 0")
    # The usual size of a quarter of this field: the median over all of the ticker's values, in hundredths of a power of ten, so that a group has few of them.
    size = F.round(F.log10(F.abs("v") * F.coalesce("by", F.lit(1.0)) / F.coalesce("quarters", F.lit(1.0))), 2)
    usual = t.where("v <> 0").groupBy("ticker", "field").agg(F.percentile(size, F.lit(0.5)).alias("usual"))
    doubtful = F.col("by").isNull() | (F.col("by") == 1)
    j = t.join(usual, t["ticker"].eqNullSafe(usual["ticker"]) & t["field"].eqNullSafe(usual["field"]), "left").drop(usual["ticker"], usual["field"])
    off = F.when(v == 0, 0.0).otherwise(F.coalesce(F.round((size - F.col("usual")) / 3), F.lit(0.0)))
    true = F.when(doubtful, F.pow(F.lit(1000.0), -off)).otherwise(F.col("by"))
    return j.withColumn("scale", true).where("scale <> 1").select(F.lit("xbrl_facts").alias("table_name"), F.col("fact_id").alias("record_id"), F.round(v * F.col("scale") * 1000).cast("long").alias("amount"))


@query("")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null numbers, other currencies and shares are no cases; a null field counts as money; rows repeated under one id come out once."""
    pct = F.coalesce(F.col("field_name").endswith("_pct"), F.lit(False))
    s = with_unit(table(spark, sf_dir, "structured_facts").where("fact_value is not null").select("structured_fact_id", "field_name", "fact_value", "unit", "source_quote"), pct).select("structured_fact_id", "field_name", "fact_value", "by", "source_quote")
    f = table(spark, sf_dir, "reconciliation_findings").where("prose_value is not null").select("finding_id", "field_name", "prose_value", "xbrl_value", "rationale")
    return _xbrl(spark, sf_dir).unionAll(rows(s, _structured, _SCHEMA, _TYPES)).unionAll(rows(f, _finding, _SCHEMA, _TYPES)).distinct()


@query("")
def p7_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias dictionary of the unit columns."""
    return aliases(table(spark, sf_dir, "xbrl_facts").select("unit").unionAll(table(spark, sf_dir, "structured_facts").select("unit")))
