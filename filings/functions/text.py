"""Text expressions. Each has its SQL beside it, as a function of an SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's and RE2's \s are those of ASCII.
WS = r"[\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SQL_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends; linear, where a pattern would try each blank of a run."""
    return F.btrim(c, F.lit(_BLANKS))


def sql_strip(c: str) -> str:
    return f"trim({c}, {' || '.join(f'chr({ord(x)})' for x in _BLANKS)})"


def words(c: Column) -> Column:
    """White-space words; punctuation stays on them. All blanks become one first: splitting by a pattern takes twice as long."""
    return F.array_remove(F.split(F.translate(c, _BLANKS, " " * len(_BLANKS)), " "), "")


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SQL_WS}+'), lambda x: x <> '')"


def normal(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return strip(F.regexp_replace(F.lower(c), f"{WS}+", " "))


def sql_normal(c: str) -> str:
    return sql_strip(f"regexp_replace(lower({c}), '{SQL_WS}+', ' ', 'g')")


def sentences(c: Column) -> Column:
    """The plain rule of the chunkers: a sentence ends at . ! or ? before white space. (The operators for all scripts are those of problem 3.)"""
    return F.filter(F.split(strip(c), f"(?<=[.!?]){WS}+"), lambda x: x != "")


def sql_sentences(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({sql_strip(c)}, '([.!?]){SQL_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def clean(c: Column) -> Column:
    """Blank lines to one, blanks to one, page-number lines and heads of contents dropped, trimmed."""
    for pattern, to in ((r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (rf"\n{WS}*\d+{WS}*\n", "\n"), (rf"(?i)(?:table of contents|index){WS}*\n", "")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def sql_clean(c: str) -> str:
    for pattern, to in ((r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (rf"\n{SQL_WS}*[0-9]+{SQL_WS}*\n", "chr(10)"), (rf"(?i)(?:table of contents|index){SQL_WS}*\n", "''")):
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return sql_strip(c)


def shortened(c: Column, n: int, mark: str = "... [truncated]") -> Column:
    """For what is shown to a model or reader: the first n characters and a mark."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def sql_shortened(c: str, n: int, mark: str = "... [truncated]") -> str:
    return f"CASE WHEN length({c}) > {n} THEN {c}[1:{n}] || '{mark}' ELSE {c} END"


TICKER = "upper(trim(ticker))"
