import random

import pyarrow as pa
import pyarrow.parquet as pq

from filings.llm import lines
from filings.llm.form import line_keys


def test_near_lines_share_a_band():
    a = "the quick brown fox jumps over the lazy dog near the river bank today and tomorrow as well as ever before".split()
    near, far = [*a[:-1], "again"], "nothing of this is anywhere in that other line of words at all today".split()
    s = lines.signatures([a, near, far, ["x", "y"], a, ["x", "y"], ["z"]])
    assert (s[0] == s[4]).all() and (s[3] == s[5]).all() and (s[0] == s[1]).any() and not (s[0] == s[2]).any() and not (s[3] == s[6]).any()
    assert (lines.signatures([a])[0] == s[0]).all() and (lines.signatures([["x", "y"]])[0] == s[3]).all()


def test_masks():
    names = frozenset(["acme", "acm"])
    key = lambda s: lines.masked(line_keys(s)[0], names)
    assert key("Acme notice of March 3, 2020: page 7") == key("ACM notice of 12 October 2021: page 99") == ["¤", "notice", "of", "¤", "page", "¤"]


def fixture(path):
    random.seed(2)
    rows = []
    for k in range(60):
        tick = ["abc", " ABC ", None, "xyz"][k % 4]
        own = ["Sentence " + "".join(random.choices("abcdefghij", k=9)), "", "Page %d of 9" % k, "ＡＢＣ  all rights reserved" if k % 3 else "abc ALL rights reserved\r"]
        own += ["Only a few lines say this"] * (k < 8) + [own[2]] * (k % 5 == 0)
        random.shuffle(own)
        rows.append((k, "Abc Corp.", tick, None if k == 7 else "\n".join(own)))
    rows += [(60, None, "abc", ""), (61, None, "abc", "\n \n"), (3, "Abc Corp.", "xyz", rows[3][3])]  # a section that is there twice
    cols = list(zip(*rows))
    pq.write_table(pa.table({"section_id": pa.array(cols[0], pa.int64()), "company": cols[1], "ticker": cols[2], "content": cols[3]}), f"{path}/filing_sections.parquet")
    return rows


def test_found_against_brute_force(spark, tmp_path):
    rows = fixture(tmp_path)
    at: dict = {}
    for sid, _, tick, content in rows:
        for no, k in enumerate(line_keys(content or "")):
            if k:
                at.setdefault((tick and tick.strip().upper(), k), set()).add((sid, no))
    want = {x for v in at.values() if len({s for s, _ in v}) >= lines.RECURS for x in v}
    got = {tuple(r) for r in lines.p1_found(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 100
    cut = {r["section_id"]: r["content"] for r in lines.p1_sections(spark, str(tmp_path)).collect()}
    assert cut[7] is None and cut[60] == "" and all("rights" not in (c or "").lower() for c in cut.values())
    assert "Sentence" in cut[1]


def test_clusters_hold_lines_that_differ_in_a_word(spark, tmp_path):
    text = "readers should note that the figures of the bulletin are not audited and may change without notice at any time"
    rows = [(k, "C", "T", text + f" says desk {'abcdefgh'[k]}x") for k in range(8)]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"section_id": pa.array(cols[0], pa.int64()), "company": cols[1], "ticker": cols[2], "content": cols[3]}), tmp_path / "filing_sections.parquet")
    got = lines.p1_clusters(spark, str(tmp_path)).collect()
    assert [(r["lines"], r["sections"]) for r in got] == [(8, 8)]
    assert lines.p1_found(spark, str(tmp_path)).count() == 0  # near, but not the same
