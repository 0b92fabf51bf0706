import random

import numpy as np
import pytest

from filings.llm import abuse, leaks
from filings.llm.form import words


def corpus():
    random.seed(8)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(random.choices(vocab, k=random.choice([5, 12, 13, 40, 70])))) for k in range(12)] + [(12, None), (13, "")]
    docs = []
    for d in range(120):
        w = random.choices(vocab, k=random.randint(0, 80))
        if d % 3 == 0:
            t = words(items[random.randrange(12)][1])
            n = random.choice([11, 12, 13, len(t)])
            a = random.randrange(max(1, len(t) - n + 1))
            w[len(w) // 2 : len(w) // 2] = t[a : a + n]
        docs.append((d, " ".join(w).replace("w1", "W１") if d % 2 else ", ".join(w)))
    return [*docs, (500, None), (501, ""), (0, docs[0][1])], items


def test_leaks_against_brute_force(spark):
    docs, items = corpus()
    grams = lambda t: {tuple(w[k : k + 12]) for w in [words(t or "")] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    d, i = spark.createDataFrame(docs, "doc_id long, text string").where("text is not null"), spark.createDataFrame(items, "item_id long, text string").where("text is not null")
    assert len(want) > 15
    for sent in (leaks.SENT, 0):  # sent to the tasks, and joined
        got = [tuple(r) for r in leaks.contained(d, i, sent).collect()]
        assert set(got) == want and len(got) == len(want)


def test_sketch_holds_every_shingle_of_its_partition():
    w = [f"a{k}" for k in range(60)]
    part, own = leaks.sketch(w)
    assert part == 6 and len(own) == 49 and set(own) == set(leaks.shingles(w).tolist())
    assert leaks.sketch(["a"] * 11) == (0, []) and len(leaks.shingles(["a"] * 12)) == 1


BAD = ["STFU @$$h0l3, go lick boots somewhere else.", "wet p u s s y", "You lying basssstards", "Envie de b***er ce soir ?", "Вы тупые уроды, заткните свои пасти.", "管理层都是不要脸的混蛋。", "พวกมึงมันโง่", "Kill уourself, you uѕеlеѕs mоron."]
FINE = ["Our policy bans insults, racist remarks and sexual content.", "bastard-cut files and an idiot-proof setup", "Naked short selling was restricted.", "The Sussex and Essex depots", "traps for rats and other vermin", "Hass avocado and cocktail lines", "Fire retardant chemicals", "It cost $264.9 million! U.S.A.", "", None, "   "]


def test_without_labels_the_classes_decide():
    m = abuse.fitted([])
    s = m.scores([f"Sales rose 5.0%. {t} See note 1." for t in BAD] + FINE)
    assert all(x >= abuse.FOUND for x in s[: len(BAD)]) and all(x < abuse.FOUND for x in s[len(BAD) :])
    assert s[-3:] == [0.0, 0.0, 0.0]


def test_pairs_of_terms_are_learned():
    random.seed(3)
    fill = [f"f{k}" for k in range(40)]
    rows = []
    for _ in range(400):
        a, b = random.random() < 0.5, random.random() < 0.5
        w = random.choices(fill, k=4) + ["blorp"] * a + ["fnords"] * b
        random.shuffle(w)
        rows.append((" ".join(w), float(a and b)))
    m = abuse.fitted(rows[:300])
    p = np.array(m.scores([t for t, _ in rows[300:]])) >= abuse.FOUND
    y = np.array([v for _, v in rows[300:]]) > 0.5
    assert (p & y).sum() / max(1, p.sum()) > 0.85 and (p & y).sum() / y.sum() > 0.85


def test_terms_unknown_to_the_lists_are_learned():
    random.seed(4)
    rows = [(f"the {random.choice('abcdefgh')}x desk wrote. " + ("what a zibzab you are. " if k % 3 == 0 else "sales rose a bit. ") + "thanks.", float(k % 3 == 0)) for k in range(240)]
    m = abuse.fitted(rows)
    assert m.scores(["One more zibzab here."])[0] > m.scores(["One more sale here."])[0]


def test_rates_and_scores(spark, tables):
    s = abuse.p10_scores(spark, tables)
    assert s.count() == spark.read.parquet(f"{tables}/documents.parquet").count() and s.where("score is null or score < 0 or score > 1").count() == 0
    r = abuse.p10_rates(spark, tables).collect()
    assert sum(x["documents"] for x in r) == s.count() and all(0 <= x["rate"] <= 1 for x in r)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables(spark, odd_tables, kind):
    from filings.llm.queries import QUERIES

    for name, f in QUERIES.items():
        n = f(spark, odd_tables[kind]).count()
        assert kind == "odd" or n == 0, name


def test_held_out_labels(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.1"
    if not Path(d).exists():
        pytest.skip("no labelled table")
    rows = [(r["doc_id"], r["text"], r["y"]) for r in abuse.labelled(spark, d).collect()]
    m = abuse.fitted((t, y) for i, t, y in rows if i % 2)
    test = [(t, y > 0.5) for i, t, y in rows if i % 2 == 0 and y != 0.5]
    found = [s >= abuse.FOUND for s in m.scores([t for t, _ in test])]
    hit = sum(f and y for f, (_, y) in zip(found, test))
    # Single ratings err: about one positive in six stands on a document without such a sentence.
    assert hit / sum(found) > 0.9 and hit / sum(y for _, y in test) > 0.7
