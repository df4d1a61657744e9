"""Comments and strings of source texts: one linear scan in expressions.

A text is cut at its strings and comments by one pattern whose repetitions are
possessive and end at a delimiter or at the text's end, so a scan neither goes
back nor recurses, whatever the length of a string; what was cut out is then
changed piece by piece and put back between the gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"


def _string(quote: str, also: str = "") -> str:
    """A string up to its quote, or to the text's end; ``also`` are characters that end it without being part of it."""
    plain = rf"[^{quote}\\{also}]*+"
    return rf"{quote}{plain}(?:\\(?s:.){plain})*+(?:{quote}|\\\z)?+"


#: Strings, line comments of both kinds and block comments; in C only ``//`` starts a line comment and a string ends with its line.
_ANY = "|".join([_string('"'), _string("'"), r"//[^\n]*+", r"#[^\n]*+", _BLOCK])
_C = "|".join([_BLOCK, r"//[^\n]*+", _string('"', r"\n"), _string("'", r"\n")])
#: Strings that end in their line.
CLOSED_STRING = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""


def _pieces(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit("")))), "")


def _blank(piece: Column) -> Column:
    return F.regexp_replace(piece, r"[^\n]", " ")


def strip_comments(text: Column) -> Column:
    """Without ``//``, ``#`` and block comments; strings stay as they are, an unclosed one to the text's end.

    Of a block comment its content stays as spaces and line feeds. Null stays null.
    """

    def change(m: Column) -> Column:
        closed = F.endswith(m, F.lit("*/")) & (F.length(m) >= 4)
        inner = F.substring(m, F.lit(3), F.length(m) - F.when(closed, 4).otherwise(2))
        return F.when(F.startswith(m, F.lit("/*")), _blank(inner)).when(F.left(m, F.lit(1)).isin("/", "#"), "").otherwise(m)

    return _pieces(text, _ANY, change)


def blank_comments(text: Column) -> Column:
    """Comments and strings of C-like text as spaces, every line and column in place: quotes, backslashes and line feeds stay.

    A string ends with its line at the latest, unless a backslash stands before the line feed.
    """

    def change(m: Column) -> Column:
        bare = F.regexp_replace(F.substring(m, F.lit(2), F.length(m)), r"\\[^\n]", r"\\ ")
        closed = F.endswith(bare, F.left(m, F.lit(1)))
        inner = F.when(closed, F.left(bare, F.length(bare) - 1)).otherwise(bare)
        string = F.concat(F.left(m, F.lit(1)), F.regexp_replace(inner, r"[^\\\n]", " "), F.when(closed, F.left(m, F.lit(1))).otherwise(""))
        return F.when(F.startswith(m, F.lit("/")), _blank(m)).otherwise(string)

    return _pieces(text, _C, change)
