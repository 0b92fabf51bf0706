"""Problem 4: what changed between full snapshots.

Each record's canonical row hash in one snapshot is joined with the one in the next delivered snapshot by a full outer
join on the primary key: a missing side is an addition or a removal, unequal hashes are a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.functions.text import SQL_WS, WS
from filings.registry import query
from filings.run import table

#: Date notations: pattern, and its groups of year, month and day.
_DATES = [(r"^(\d{4})-(\d{1,2})-(\d{1,2})", (1, 2, 3)), (r"^(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)), (r"^(\d{4})(\d\d)(\d\d)$", (1, 2, 3)), (r"^(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)), (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})", (3, 2, 1))]


def iso_date(c: str) -> F.Column:
    """One notation for all dates; what isn't a date stays as text, null is empty."""
    s = F.trim(c)
    out = s
    for p, (y, m, d) in reversed(_DATES):
        out = F.when(s.rlike(p), F.concat_ws("-", F.regexp_extract(s, p, y), F.lpad(F.regexp_extract(s, p, m), 2, "0"), F.lpad(F.regexp_extract(s, p, d), 2, "0"))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def held(rows: DataFrame) -> DataFrame:
    """(snapshot_no, accession_number, section_name, row): of a record's rows in a snapshot the last loaded, as the hash of what counts in it. Rows without a key or number are no records."""
    digits = F.regexp_replace("accession_number", r"[^0-9A-Za-z]", "")
    bare = F.regexp_replace(F.coalesce("content", F.lit("")), WS[:-1] + r"\u200b\ufeff\u2060]+", "")
    s = rows.select(
        F.col("snapshot_no").cast("long").alias("snapshot_no"),
        F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), digits.substr(F.lit(13), F.length(digits))).alias("accession_number"),
        F.lower(F.trim("section_name")).alias("section_name"),
        F.unhex(F.md5(F.concat_ws("\u0001", iso_date("filing_date"), bare))).alias("row"),
        "loaded_at",
    ).where("snapshot_no is not null and section_name is not null and accession_number <> ''")
    return s.groupBy("snapshot_no", "accession_number", "section_name").agg(F.max(F.struct("loaded_at", "row")).alias("x")).select("snapshot_no", "accession_number", "section_name", "x.row")


def changes(rows: DataFrame) -> DataFrame:
    """(snapshot_no, accession_number, section_name, change_type) for each pair of consecutive delivered snapshots; the first has no changes, and an empty table none at all."""
    by = Window.orderBy("snapshot_no")  # over the numbers of the delivered snapshots only
    nos = rows.where("snapshot_no is not null").select(F.col("snapshot_no").cast("long").alias("snapshot_no")).distinct().select("snapshot_no", F.lag("snapshot_no").over(by).alias("before"), F.lead("snapshot_no").over(by).alias("after"))
    h = held(rows).join(nos, "snapshot_no")
    new = h.where("before is not null").select("snapshot_no", "accession_number", "section_name", F.col("row").alias("new"))
    old = h.where("after is not null").select(F.col("after").alias("snapshot_no"), "accession_number", "section_name", F.col("row").alias("old"))
    both = new.join(old, ["snapshot_no", "accession_number", "section_name"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("snapshot_no", "accession_number", "section_name", kind.alias("change_type")).where("change_type is not null")


_ISO = "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN regexp_extract(f, '{p}', {y}) || '-' || lpad(regexp_extract(f, '{p}', {m}), 2, '0') || '-' || lpad(regexp_extract(f, '{p}', {d}), 2, '0')" for p, (y, m, d) in _DATES) + " ELSE coalesce(f, '') END"
_SQL = rf"""
    t AS (SELECT CAST(snapshot_no AS BIGINT) AS no, regexp_replace(accession_number, '[^0-9A-Za-z]', '', 'g') AS d, lower(trim(section_name)) AS section_name, trim(filing_date) AS f, regexp_replace(coalesce(content, ''), '{SQL_WS[:-1]}\x{{200b}}\x{{feff}}\x{{2060}}]+', '', 'g') AS c, loaded_at FROM section_snapshots),
    k AS (SELECT no, d[1:10] || '-' || d[11:12] || '-' || d[13:] AS accession_number, section_name, md5({_ISO} || chr(1) || c) AS row, loaded_at FROM t WHERE no IS NOT NULL AND section_name IS NOT NULL AND d <> ''),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY no, accession_number, section_name ORDER BY loaded_at DESC NULLS LAST, row DESC) AS r FROM k) WHERE r = 1),
    nos AS (SELECT no, lag(no) OVER (ORDER BY no) AS before, lead(no) OVER (ORDER BY no) AS after FROM (SELECT DISTINCT no FROM t WHERE no IS NOT NULL)),
    new AS (SELECT held.* FROM held JOIN nos USING (no) WHERE before IS NOT NULL), old AS (SELECT held.* REPLACE (after AS no) FROM held JOIN nos USING (no) WHERE after IS NOT NULL),
    changes AS (SELECT no AS snapshot_no, accession_number, section_name, CASE WHEN old.row IS NULL THEN 'added' WHEN new.row IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM new FULL JOIN old USING (no, accession_number, section_name) WHERE old.row IS DISTINCT FROM new.row)"""


@query("", f"WITH {_SQL} SELECT * FROM changes")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "section_snapshots"))


@query("", f"WITH {_SQL} SELECT snapshot_no, change_type, count(*) AS records FROM changes GROUP BY 1, 2")
def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes of each kind each snapshot brought."""
    return p4_found(spark, sf_dir).groupBy("snapshot_no", "change_type").agg(F.count("*").alias("records"))
