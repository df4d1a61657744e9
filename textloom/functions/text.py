"""Text functions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_estimate(text: Column) -> Column:
    """Estimated tokens: 0 for an empty text, else a tenth more than pieces or quarter bytes, and one."""
    pieces = F.regexp_count(text, F.lit(PIECE))
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(F.greatest(pieces.cast("double"), F.octet_length(text) / 4.0) * F.lit(1.1)) + 1).cast("long")


def first_sentence(text: Column, most: int = 200) -> Column:
    """White space collapsed, up to the first ". ", at most ``most`` characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.left(F.when(F.instr(flat, ". ") > 0, F.concat(F.substring_index(flat, ". ", 1), F.lit("."))).otherwise(flat), F.lit(most))


def line_slice(text: Column, first: int, last: int, most: int = 200) -> Column:
    """Lines ``first`` to ``last`` (from 1, both included, at most ``most``), numbered."""
    lines = F.slice(F.split(text, "\n"), first, min(last - first + 1, most))
    return F.array_join(F.transform(lines, lambda line, i: F.concat((i + first).cast("string"), F.lit(": "), line)), "\n")


def numbered(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)), "\n")


def capped(text: Column, most: int) -> tuple[Column, Column]:
    """A prefix of ``most`` characters, and the full count."""
    return F.left(text, F.lit(most)), F.length(text).cast("long")


def redact_url(url: Column) -> Column:
    """Without user and password."""
    return F.regexp_replace(url, r"(?<=://)[^/@\s]*@", "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def wrap_untrusted(text: Column) -> Column:
    """Between markers whose name depends on the text; forged markers are taken out."""
    clean = F.regexp_replace(text, r"</?untrusted[^>]*>", "")
    nonce = F.left(F.sha2(clean, 256), F.lit(12))
    return F.concat(F.lit("<untrusted-"), nonce, F.lit(">\n"), clean, F.lit("\n</untrusted-"), nonce, F.lit(">"))


def extract_code(text: Column) -> Column:
    """What stands in the first code fence, closed or not; without a fence the text."""
    closed = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1)
    opened = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*)$", 1)
    return F.when(closed != "", closed).when(opened != "", opened).otherwise(text)


def json_array(text: Column) -> Column:
    """From the first bracket to the last, of a fence's content if there is one; empty if none."""
    return F.regexp_extract(extract_code(text), r"(?s)\[.*\]", 0)


def diagnostic(text: Column, most: int = 300) -> Column:
    """The first line with ``error:``, else the last line that isn't blank."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    errors = F.filter(lines, lambda line: F.contains(line, F.lit("error:")))
    return F.left(F.trim(F.coalesce(F.get(errors, 0), F.try_element_at(lines, F.lit(-1)), F.lit(""))), F.lit(most))


def named_patterns(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns that the text matches."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()))))


def specific_first(text: Column, specific: dict[str, str], generic: dict[str, str]) -> Column:
    """Names of specific patterns, or if none matches those of generic ones."""
    found = named_patterns(text, specific)
    return F.when(F.size(found) > 0, found).otherwise(named_patterns(text, generic))


def strip_markup_comments(text: Column) -> Column:
    """Without comments and scripts; quoted attribute values are stepped over whole."""
    return F.regexp_replace(text, r"""(?s)("[^"]*"|'[^'<>]*')|<!--.*?-->|<script\b.*?</script>""", "$1")


def rst_escaped(text: Column) -> Column:
    """Inline markup of reStructuredText made literal by backslashes."""
    return F.regexp_replace(text, r"([\\*`|_])", r"\\$1")


def rst_literal(text: Column) -> Column:
    """An inline literal, which no backtick inside ends early."""
    return F.concat(F.lit("``"), F.replace(text, F.lit("`"), F.lit("'")), F.lit("``"))
