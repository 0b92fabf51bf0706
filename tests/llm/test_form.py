import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filings.llm.form import _whole, folded, form, line_keys, readable, words

_POOL = "ab é́̂​\n е о ёй ﬁ ｶﾞＷ　ᅡᆨ가 ่ักक़़्कßİǅ‘–…́Ωꙁ゙か\r\t­"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(_POOL), max_size=12) | st.text(max_size=20))
def test_spliced_segments_equal_the_normalised_whole(s):
    assert form(s) == _whole(s.replace("\r\n", "\n").replace("\r", "\n"))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(_POOL), max_size=12))
def test_the_form_is_stable(s):
    assert form(form(s)) == form(s) and readable(readable(s)) == readable(s) and form(readable(s)) == form(s)


@pytest.mark.parametrize(("a", "b"), [("Ｗｈａｔ ﬁle", "What file"), ("café", "café"), ("a b​", "a b"), ("Βοok", "Book"), ("ｶﾞ", "ガ"), ("a\r\nb", "a\nb"), ("Rеvеnuе", "Revenue")])
def test_what_looks_the_same_is_one(a, b):
    assert form(a) == form(b) and readable(a) == readable(b)


@pytest.mark.parametrize(("a", "b"), [("income", "Income"), ("resume", "résumé"), ("x2", "x²"), ("5.0", "5,0"), ("file", "fi1e")])
def test_what_counts_is_kept(a, b):
    assert form(a) != form(b) and readable(a) != readable(b)


def test_unchanged_text_comes_back_as_it_is():
    s = "रिपोर्ट และงบ 東京 Ürün – 5%"
    assert form(s) is s


def test_words_of_one_script_are_readable():
    assert readable("Выручка выросла") == "Выручка выросла" and readable("Bыpyчкa") == "Выручка"


def test_keys_disregard_case_blanks_and_numbers():
    assert line_keys("  Page 1  of 12\r") == line_keys("PAGE 115 of 3")
    assert line_keys("ВСЕ права") == line_keys("Все ПРАВА")
    assert line_keys("a\n\n b ") == ["a", "", "b"] and line_keys("a b\n\x85") == ["a b", ""]


def test_words():
    assert words("Net-Ｓales, 5.0% café_x") == ["net", "sales", "5", "0", "café", "x"]
