import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filings.llm import words
from filings.llm.sentences import ends


@pytest.mark.parametrize("units", [
    ["We will pay $5.0 million to Dr. H. Alnemont of Solrix Inc. in name only.", "Backlog stood at 5.1% in the U.S.", "The rest is due on Feb. 2, 2018!"],
    ["“We will not cut output. Demand is solid,” said J. Risrilis, who leads Water Treatment.", "Ms. Q. T. Quikunor left.", "(Calmarr did not hedge in Q3.)", "eFenrosen is a name."],
    ["“Costs will fall,” Dradanor wrote, “but not before Nerve opens. Please wait.”", "Talgotek Group v. Nertadyne Group was heard."],
    ['"Is it late?" asked one distributor, and X answered "Not by more than 3 days."', "We moved to plan B.", "Sales … but not costs fell."],
    ["毛利率为4.6%。", "“我们不会减产。需求很稳定。”Tortimont表示。", "Zan称：“将复产。时间未定。”", "会推迟吗？", "是。"],
    ["「需求は堅調です。減産はしません。」とMirstara氏は述べた。", "Risrix氏は「再開する。時期は未定だ。」と語り、詳細を避けた。"],
    ["其余部分用于Britara Corp.。", "“我们不会减产。需求很稳定。”Mavoritek表示。"],
    ["Договор № 619 действует до 21.7.2023 включительно.", "Выручка составила 899,2 млн долл. в 2020 г. по данным Zan Group.", "«Мы не снижаем выпуск. Спрос устойчив», — сообщил W. Y. Kesrimont."],
])
def test_units(units):
    text = "" if "。" in units[0] else " "
    s, want = "", []
    for u in units:
        s += (text if s else "") + u
        want.append(len(s))
    assert ends(s) == want
    assert ends(f"Item 7. Discussion\r\n\r\n{s}\r\n\r\n") == [18, *(22 + w for w in want)]


def test_thai_gaps():
    a, b = "ผู้สอบบัญชีไม่มีข้อสังเกตเพิ่มเติมต่องบการเงินประจำปีนี้", "บริษัทได้ลงนามในสัญญากับ Talstadon Group เป็นครั้งแรก"
    assert ends(f"{a} {b}") == [len(a), len(a) + 1 + len(b)]
    for word in ("และ", "หรือ"):  # a connecting word holds both sides together
        assert ends(f"{a} {word}{a}") == [2 * len(a) + 1 + len(word)]
    assert ends(f"{a}ครับ และ{a}") == [len(a) + 4, 2 * len(a) + 8]  # a final particle ends a unit whatever follows


def test_lattice():
    assert words.lattice("และบริษัท") == ("และ", "บริษัท") and words.first("และบริษัท", 0) == "และ" and words.last("x บริษัทครับ", 12) == "ครับ"
    assert words.first("abc", 0) == "" and words.last("", 0) == ""


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB .!?\n\r“”\"(「。」)1と…​ก "), max_size=60))
def test_ends_are_in_order_and_after_a_character(s):
    e = ends(s)
    assert e == sorted(set(e)) and all(0 < x <= len(s) and not s[x - 1].isspace() for x in e)
    assert bool(e) <= bool(s.strip())


def test_very_long_text():
    assert len(ends("Sales rose again. " * 20_000)) == 20_000
