import random

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from filings.llm import split, tokens
from filings.llm.bpe import bpe


@pytest.fixture(scope="module")
def own():
    return bpe()


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


TEXTS = ["", "a", " ", "word " * 300, "it's we'll 'll x'", "日本語" * 900, "a" * 5000, " " * 3000 + "x\n\n", "<|endoftext|> ok", "naïve café … 12,345.67 €\t\r\n", "กขค " * 50, "🙂🙂 é é"]


def test_ids_equal_those_of_the_public_libraries(own, theirs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for s, ids in zip(TEXTS, own.encode(TEXTS)):
        assert ids == theirs.encode_ordinary(s) == t.encode(s, add_special_tokens=False).ids
        assert own.decode(ids) == s
    assert own.count(TEXTS) == [len(theirs.encode_ordinary(s)) for s in TEXTS]


def test_rounds_equal_the_heap(own):
    random.seed(5)
    pieces = ["".join(random.choice("abcdest éあ") for _ in range(random.randint(1, 120))).encode() for _ in range(200)]
    assert own.merge(pieces) == [own.merge_long(p) for p in pieces]


def test_chunks_stitch_wherever_they_are_cut(own):
    random.seed(6)
    for _ in range(1500):
        s = "".join(random.choice("ab 's'll\n\t  12é日本語ไทย…😀_") for _ in range(random.randint(0, 120)))
        chunk, overlap = random.choice([7, 8, 16, 33]), random.choice([5, 6, 8, 12])
        assert own.split(s, chunk, overlap) == own.pattern.findall(s)
    assert own.split("x" * 1000, 16, 8) == ["x" * 1000]  # no boundary to meet at


def test_ids_by_documents(spark, tmp_path, theirs):
    texts = [*TEXTS, None]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    for chunk in (1 << 16, 100):
        got = {r["doc_id"]: r["ids"] for r in tokens.p8_ids(spark, str(tmp_path), chunk=chunk, overlap=20).collect()}
        assert got == {k: theirs.encode_ordinary(t or "") for k, t in enumerate(texts)}


def test_counts_and_totals(spark, tables, theirs):
    d = spark.read.parquet(f"{tables}/chunks.parquet").where("content is not null").select("chunk_id", "content", "lang").collect()
    got = {r["item_id"]: r["tokens"] for r in tokens.p6_tokens(spark, tables).where("table_name = 'chunks'").collect()}
    assert got == {r["chunk_id"]: len(theirs.encode_ordinary(r["content"])) for r in d}
    t = tokens.p6_totals(spark, tables).where("slice_by = 'lang'").collect()
    s = tokens.p6_slices(spark, tables).collect()
    assert sum(r["items"] for r in t) == sum(r["items"] for r in s) == tokens.p6_tokens(spark, tables).count()
    assert sum(r["tokens"] for r in t) == sum(r["tokens"] for r in s) and any(r["lang"] is None for r in s)


@pytest.mark.parametrize("s", ["word " * 3000, "x" * 7001, "Sales rose a bit. " * 500, "Some words.\n\n" * 400, "営業利益率は低い。" * 900, "short", "", "y" * 3000 + " z" * 1500, "é" * 5000, "a" * 1999 + " b" * 2, "\n" * 6000])
def test_pieces_hold_the_whole_text(s):
    got = split.pieces(s)
    assert got[0][0] == 0 and got[-1][1] == len(s) and all(b - a <= 2000 and (b > a or not s) for a, b in got)
    assert (len(got) > 1) == (len(s) > 2000)
    assert all(a < c <= b and b - c <= 200 for (a, b), (c, _) in zip(got, got[1:]))
    rebuilt = s[: got[0][1]]
    for (_, b), (_, d) in zip(got, got[1:]):
        rebuilt += s[b:d]
    assert rebuilt == s


def test_cuts_are_at_the_strongest_boundary():
    s = "First paragraph here. " * 60 + "\n\n" + "Second one is here. " * 60
    a, b = split.pieces(s)
    assert s[: a[1]].endswith("\n\n") and s[b[1] - 5 :] == "ere. " and s[b[0] - 1].isspace()
