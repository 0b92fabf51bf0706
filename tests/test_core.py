"""Golden values, small fixtures and brute force for the core's operators."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from filings import models
from filings.functions.units import distance, resolve
from filings.operators import chunking, parsing, provenance, reconciliation, retrieval, scoring, snapshots, units
from filings.operators.changes import diff
from filings.run import components


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


# --- snapshots ---


def test_snapshot_changes(spark):
    t = [datetime.datetime(2024, 1, d) for d in range(1, 10)]
    row = lambda no, acc, sec, date, text, at: (no, acc, sec, date, text, t[at])
    rows = [
        row(1, "0009000000-24-000001", "mda", "2024-01-31", "a b", 0), row(1, "000900000024000001", "mda", "20240131", "old", 1), row(1, "000900000024000001", "MDA ", "01/31/2024", " a  b\n", 2),
        row(3, "0009000000-24-000001", "mda", "2024-01-31T00:00:00", "ab", 0),  # 2 was never delivered; only blanks and notations differ
        row(3, "0009000000-24-000002", "mda", "2024-02-01", None, 0), row(3, "0009000000-24-000003", "mda", "2024-02-01", "x", 0),
        row(5, "0009000000-24-000001", "mda", "2024-02-01", "ab", 0), row(5, "0009000000-24-000002", "mda", "2024-02-01", "", 0), row(5, "0009000000-24-000003", "mda", "2024-02-01", "y", 0), row(5, "0009000000-24-000003", "mda", "2024-02-01", "x", 3),
        row(6, "0009000000-24-000001", "mda", "2024-02-01", "ab", 0), row(6, "0009000000-24-000004", "mda", "2024-02-01", "ab", 0), row(6, None, "mda", None, "ab", 0), row(None, "0009000000-24-000009", "mda", None, "ab", 0),
    ]
    df = spark.createDataFrame(rows, "snapshot_no int, accession_number string, section_name string, filing_date string, content string, loaded_at timestamp")
    got = {(r["snapshot_no"], r["accession_number"][-1], r["change_type"]) for r in snapshots.changes(df).collect()}
    assert got == {(3, "2", "added"), (3, "3", "added"), (5, "1", "modified"), (6, "2", "removed"), (6, "3", "removed"), (6, "4", "added")}


# --- units ---


@pytest.mark.parametrize(("said", "unit"), [
    ("USD_milions", ("usd", 1.0)), ("US dolars", ("usd", 1e-6)), ("usd billons", ("usd", 1e3)), ("Milion USD", ("usd", 1.0)), ("Mrd. USD", ("usd", 1e3)), ("USDth", ("usd", 1e-3)), ("percnt", ("percent", 1.0)),
    ("EUR_millions", ("other", 0.0)), ("shares", ("shares", 0.0)), ("", None), ("nonsense", None), ("USD mn", ("usd", 1.0)), ("USD bn", ("usd", 1e3)),
])
def test_spellings(said, unit):
    assert resolve(said) == unit


def test_short_words_are_not_bent():
    assert distance("usd mn", "usd bn") > 1.5 and distance("usd milion", "usd million") < 1


@pytest.mark.parametrize(("text", "millions"), [
    ("Ebitda为0.725亿美元。", 72.5), ("Revenue约为131,340万美元。", 1313.4), ("Ebitdaは293,880万ドルにとどまった。", 2938.8), ("Gross profitは39.3百万ドルでした。", 39.3), ("Ebitdaは0.6715十億ドルに達した。", 671.5),
    ("Ebitda ($ in 000s) 153,900", 153.9), ("Gross profit von 32.200 Tsd. US-Dollar", 32.2), ("Cogs : 17 529,2 millions de dollars", 17529.2), ("Gross profit betrug 97.300.000 US-Dollar.", 97.3), ("Net income of $0.0186B", 18.6),
    ("Gross profit was $255,800K", 255.8), ("The text reads: In millions of dollars, revenue 70.4", 70.4), ("Revenue: US$2,702,900,000", 2702.9), ("Gross profit : 0,0484 milliards de dollars", 48.4), ("revenue in local currency", None),
])
def test_stated(text, millions):
    assert units.stated(text, False) == (None if millions is None else pytest.approx(millions))


def test_the_text_holds_over_the_unit_column():
    assert list(units._structured(1, "cogs", 89.4, 1e-3, "Cogsは89.4百万ドルでした。")) == []
    assert list(units._structured(1, "net_margin_pct", 0.1218, None, "Net margin lag bei 12,18 %.")) == [("structured_facts", 1, 1218)]
    assert list(units._structured(1, "cogs", 77000.0, 1e-3, "The table shows cogs.")) == [("structured_facts", 1, 77000)]


def test_the_tagged_value_decides_without_a_text():
    assert list(units._finding(1, "cogs", 43100000.0, 43.1, "Original filing")) == [("reconciliation_findings", 1, 43100)]
    assert list(units._finding(1, "cogs", 10.1, 7.0, None)) == []
    assert list(units._finding(1, "cogs", 10.1, None, None)) == []


# --- chunks ---


def windows(words, size, overlap):
    out, a = [], 0
    while words:
        out.append(words[a : a + size])
        if a + size >= len(words):
            break
        a += size - overlap
    return out


def test_windows_against_a_loop(spark):
    random.seed(1)
    texts = [(k, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate([0, 1, 6, 7, 8, 9, 10, 11, 12, 13, 40])]
    got = {}
    for r in chunking.fixed(spark.createDataFrame(texts, "i long, content string"), 7, 3).orderBy("i", "chunk_index").collect():
        got.setdefault(r["i"], []).append(r["text"])
    assert got == {k: [" ".join(w) for w in windows(t.split(), 7, 3)] for k, t in texts if t}
    with pytest.raises(ValueError):
        chunking.fixed(spark.createDataFrame(texts, "i long, content string"), 3, 3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 9, 10, 11, 16, 19])
def test_groups_of_sentences(spark, n):
    df = spark.createDataFrame([(1, " ".join(f"S{k}." for k in range(n)))], "i long, content string")
    got = [r["sentences"] for r in chunking.sentence_groups(df, "i").orderBy("chunk_index").collect()]
    want = [8] * (n // 8)
    if n % 8 >= 3:
        want.append(n % 8)
    elif n % 8 and want:
        want[-1] += n % 8
    assert got == want


def test_semantic_fold():
    assert chunking.semantic("") == [] and chunking.semantic("One only.") == [["One only."]]
    a, b = "alpha beta gamma. " * 60, "delta epsilon zeta. " * 600
    got = chunking.semantic(a + b + "tail end.")
    assert got[0] == ["alpha beta gamma."] * 60 and len(got) > 3 and got[-1][-1] == "tail end."
    assert all(len(" ".join(c).split()) <= 500 for c in got[1:-1])


def test_chunker_names():
    with pytest.raises(ValueError):
        chunking.chunker("other")
    with pytest.raises(ValueError):
        retrieval.retriever("other")


# --- parsing ---


def test_sections(spark):
    text = "Item 1A. Risk Factors\nItem 7. Management\n\nITEM 1A - RISK FACTORS\n" + "risk words " * 60 + "\nItem 7. Management's discussion\n" + "short"
    got = parsing.sections_of(spark.createDataFrame([("f", text)], "filing_id string, text string")).collect()
    assert [(r["section_name"], len(r["content"].split())) for r in got] == [("risk_factors", 120)]


def test_marked_paragraphs(spark):
    df = spark.createDataFrame([(1, "[1] one\n[2] two\nmore\nParagraph 1: again"), (2, "a\n\n b \n \n\nc"), (3, None), (4, "")], "i long, t string")
    got = sorted((r["i"], r["paragraph"], r["text"]) for r in parsing.marked_paragraphs(df, "i", "t").collect())
    assert got == [(1, 1, "again"), (1, 2, "two\nmore"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c")]


def test_html(spark):
    assert value(spark, parsing.html_text(F.lit("<head><style>x</style><script>if (a < b) {}</script></head><p>A &amp; B</p><br>C"))) == "A & B\nC"


# --- figures ---


@pytest.mark.parametrize(("text", "want"), [("$812 million", [812.0]), ("$812M", [812.0]), ("$0.812 billion", [812.0]), ("( 74,525 )", [74525.0]), ("$1234", [1234.0]), ("$5 to", [5.0]), ("(1) $2,000.5 and ( 3,000 )", [2000.5, 3000.0]), ("none", [])])
def test_figures(spark, text, want):
    got = [x["value"] for x in value(spark, provenance.figures(F.lit(text)))]
    assert got == pytest.approx(want)


def test_provenance_in_its_order(spark):
    p = spark.createDataFrame([(1, 1, "Net sales were $812 million."), (1, 2, "Costs of $300 million rose."), (1, 3, "Nothing here.")], "chunk_id long, paragraph int, text string")
    cases = [
        (1, None, "q", 1, "not extracted"), (2, 812.0, "net  SALES were", 1, "value in paragraph"), (3, 812.0, "Net sales", 2, "value in paragraph"), (4, 812.0, "never said", 3, "value without quote"), (5, 5.0, "never said", 3, "neither quote nor value"),
        (6, 812.0, "Net sales", None, "value in paragraph"), (7, 812.0, "never said", None, "quote not found"), (8, 812.0, None, None, "value without anchor"), (9, 5.0, None, None, "value not found"), (10, 812.0, "x", 9, "no such paragraph"), (11, 812.0, "Costs", 2, "value not in paragraph"),
    ]
    m = spark.createDataFrame([(i, 1, v, q, c) for i, v, q, c, _ in cases], "id long, chunk_id long, value double, quote string, cited int")
    got = {r["id"]: (r["reason"], r["found_paragraph"]) for r in provenance.verified(m, p).collect()}
    assert {i: got[i][0] for i in got} == {i: w for i, *_, w in cases}
    assert got[3][1] == 1 and got[4][1] == 1 and got[6][1] == 1


@pytest.mark.parametrize(("text", "want"), [("$812 million and 0.813 billion", [812.0]), ("$12.50 a share", []), ("$143,756 in total", [143756.0]), ("5 billion, $5.5 bn", [5000.0, 5500.0]), ("none in 2024", [])])
def test_claims(spark, text, want):
    assert value(spark, scoring.claims(F.lit(text))) == pytest.approx(want)


# --- reconciliation and statistics ---


@pytest.mark.parametrize(("a", "b", "want"), [(110.0, 100.0, 10.0), (95.0, 100.0, -5.0), (50.0, 0.0, math.inf), (0.0, 0.0, 0.0)])
def test_delta(spark, a, b, want):
    assert value(spark, reconciliation.delta_pct(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b", "words", "want"), [(143750.0, 143756.0, "", "no_delta"), (150000.0, 143756.0, "Adjusted figure", "non_gaap_vs_gaap"), (150000.0, 143756.0, "?", "unexplained"), (1.0, None, "", "lookup_failed")])
def test_pattern(spark, a, b, words, want):
    assert value(spark, reconciliation.pattern(F.lit(a), F.lit(b).cast("double"), F.lit(words))) == want


@pytest.mark.parametrize(("expected", "actual", "credit"), [("periodicity", "periodicity", 1.0), ("periodicity", "hierarchy", 0.5), ("periodicity", "unexplained", 0.0), ("periodicity", "no_delta", 0.0)])
def test_credit(spark, expected, actual, credit):
    assert value(spark, reconciliation.credit(reconciliation.verdict(F.lit(expected), F.lit(actual)))) == credit


@pytest.mark.parametrize(("k", "n", "low", "high"), [(14, 30, 0.302, 0.639), (24, 30, 0.627, 0.905)])
def test_wilson(spark, k, n, low, high):
    lo, hi = scoring.wilson(F.lit(float(k)), F.lit(float(n)))
    assert value(spark, lo) == pytest.approx(low, abs=1e-3) and value(spark, hi) == pytest.approx(high, abs=1e-3)


@pytest.mark.parametrize(("b", "c", "p"), [(2, 12, 0.01294), (0, 0, 1.0), (5, 5, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert value(spark, scoring.mcnemar(F.lit(b).cast("long"), F.lit(c).cast("long"))) == pytest.approx(p, abs=1e-5)


@pytest.mark.parametrize("n", [1, 2, 20, 21, 300])
def test_picked_places(spark, n):
    random.seed(n)
    v = [round(random.random() * 9, 3) for _ in range(n)]
    df = spark.createDataFrame([("a", x) for x in v], "g string, v double")
    got = {r["name"]: r["value"] for r in scoring.picked(df, "g", "v", {"m": F.floor(F.col("n") / 2), "p": F.least(F.floor(0.95 * F.col("n")), F.col("n") - 1)}).collect()}
    s = sorted(v)
    assert got == {"m": s[n // 2], "p": s[min(int(0.95 * n), n - 1)]}


# --- retrieval, diff, components, models ---


def test_dense_blocks_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.dense(df, df.where("id % 20 = 0"), 5, block=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 90, 20):
        want = sorted(range(90), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:5]
        assert [got[q, k] for k in range(5)] == want


def test_diff_takes_the_likest_left():
    old = ["the cat sat on the mat today", "profits rose by five percent", "gone"]
    new = ["profits rose by nine percent", "the cat sat on the mat today", "wholly other words 123"]
    assert [(k, o, n) for k, o, n, _ in diff(old, new)] == [("modified", 1, 0), ("added", -1, 2), ("removed", 2, -1)] or [(k, o, n) for k, o, n, _ in diff(old, new)] == [("added", -1, 2), ("removed", 2, -1)]


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100, 100 + k) for k in range(1, 30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class Clumsy:
    name = "clumsy"

    def __init__(self):
        self.asked = 0

    def complete(self, prompt):
        self.asked += 1
        return "```json\n{'no'" if self.asked < 3 else "Sure! {“a”: 95_359, \"b\": True,}"


def test_models(spark):
    assert models.healed(Clumsy(), "x") == {"a": 95359, "b": True}
    with pytest.raises(ValueError):
        models.healed(Clumsy(), "x", attempts=2)
    got = models.answered(spark.createDataFrame([(1, "Hello world"), (2, None)], "i long, p string")).orderBy("id").collect()
    assert got[0]["model"] == "rules" and "Hello" in got[0]["answer"] and got[1]["answer"] is None and got[1]["error"] is None


def test_amounts_in_the_common_unit(spark, tmp_path):
    facts = [(k, "t ", "revenue", 100.0 + k, "USD_millions", 91) for k in range(12)]
    facts += [
        (100, "T", "revenue", 105_000.0, "USD_millions", 91), (101, "T", "revenue", 0.105, None, 91), (102, "T", "revenue", 420.0, "USD_millions", 365), (103, "T", "revenue", 104e6, "USD", 91), (104, "T", "revenue", 104_000.0, "USDth", 92),
        (105, "T", "revenue", 9.0, "EUR", 91), (106, "T", "revenue", 9.0, "shares", 91), (107, "T", "revenue", None, "USD", 91), (108, "T", "revenue", 0.0, "USD_millions", 91), (109, "T", "revenue", 104.0, "", 0), (110, None, None, 5.0, "Mrd. USD", None), (111, "T", "revenue", -105_000.0, "USD_millions", 91),
    ]
    spark.createDataFrame(facts, "fact_id long, ticker string, field string, value_usd_millions double, unit string, duration_days int").write.parquet(str(tmp_path / "xbrl_facts.parquet"))
    s = [(1, "revenue", 5.0, "USD bn", None), (2, "revenue", 5.0, "USD_millions", "Revenue was $5 billion."), (3, "gross_margin_pct", 0.25, "ratio", None), (4, "gross_margin_pct", 25.0, "percent", None), (5, "revenue", None, "USD", "x"), (6, None, 7.0, "US dolars", None), (7, "revenue", 5.0, "CHF_millions", None)]
    spark.createDataFrame(s, "structured_fact_id long, field_name string, fact_value double, unit string, source_quote string").write.parquet(str(tmp_path / "structured_facts.parquet"))
    r = [(1, "cogs", 4.2e7, 42.0, None), (2, "cogs", 42.0, 42.0, None), (3, "cogs", 42.0, None, None), (4, "cogs", 0.042, 40.0, "Prose says Cogs of US$0.042bn here"), (5, None, None, 1.0, None)]
    spark.createDataFrame(r, "finding_id long, field_name string, prose_value double, xbrl_value double, rationale string").write.parquet(str(tmp_path / "reconciliation_findings.parquet"))
    got = {(x["table_name"][0], x["record_id"]): x["amount"] for x in units.p7_found(spark, str(tmp_path)).collect()}
    assert got == {
        ("x", 100): 105_000, ("x", 101): 105_000, ("x", 103): 104_000, ("x", 104): 104_000, ("x", 110): 5_000_000, ("x", 111): -105_000,
        ("s", 1): 5_000_000, ("s", 2): 5_000_000, ("s", 3): 2500, ("s", 6): 0, ("r", 1): 42_000, ("r", 4): 42_000,
    }
