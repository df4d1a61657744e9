"""Cross-document line frequency, all in DataFrame expressions.

Lines are normalised (lower case, white space collapsed) and hashed together
with their host (the document's source). A line is boilerplate when more
distinct documents of its host hold it than the host's limit: the larger of
``min_docs`` and ``host_share`` of the host's distinct documents. Documents are distinct
when their whole texts differ, so copies of one document, which repeat all its
lines, count once and don't condemn each other. Boilerplate lines are removed; a document that keeps too small a share of its words is depleted
and rejected.

Line counts are two partial aggregates, so a line that a third of all documents
hold is summed before it is shuffled. Only lines above their limits go back to
the documents: broadcast when a count proves them few, else by a shuffle join,
which splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: More lines above limits than this are joined by shuffle.
BROADCAST_LINES = 100_000
_SPACE = r"[\\x20\\x09-\\x0D]+"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, worked out once a row wherever the optimizer moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


_WORDS = rf"array_remove(split(__t, '{_SPACE}'), '')"
#: Words within three-word windows that occur twice: sorted (hash, place) pairs give the places of such
#: windows; each covers three words, or as many as come before the next one.
_REPEATS = _let("ws", _WORDS, "CASE WHEN size(ws) < 3 THEN 0L ELSE " + _let(
    "g", "transform(slice(ws, 1, size(ws) - 2), (w, i) -> xxhash64(w, get(ws, i + 1), get(ws, i + 2)))",
    "CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE " + _let(
        "s", "array_sort(transform(g, (h, i) -> struct(h AS h, i AS i)))",
        "aggregate(array_sort(transform(filter(transform(s, (e, j) -> struct(e.i AS i, (j > 0 AND get(s, j - 1).h = e.h) OR (j + 1 < size(s) AND get(s, j + 1).h = e.h) AS twice)), x -> x.twice), x -> x.i)), "
        "named_struct('last', -9, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)",
    ) + " END",
) + " END")


def base_columns(df: DataFrame, text: Column) -> DataFrame:
    """Add the base measures of a text."""
    df = df.withColumn("__t", F.coalesce(text, F.lit("")))
    return df.withColumns({
        "n_words": F.expr(f"size({_WORDS})").cast("long"),
        "word_chars": F.expr(f"length(array_join({_WORDS}, ''))").cast("long"),
        "n_symbols": F.expr(r"length(regexp_replace(__t, '[^#*$%&|<>]+', ''))").cast("long"),
        "n_dup_lines": F.expr(_let("f", r"filter(split(__t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')", "size(f) - size(array_distinct(f))")).cast("long"),
        "n_repeat_words": F.expr(_REPEATS),
    })


def _lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """Per row: name of (host, text), host, normalised lines as ``h`` (hash, 0 for blank) and ``n`` (words)."""
    t, host = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[host_col].cast("string"), F.lit(""))
    df = docs.select(t.alias("t"), host.alias("host")).select("host", F.xxhash64("host", "t").alias("k1"), F.xxhash64(F.lit(5), "t", "host").alias("k2"), F.expr(r"split(t, '\n')").alias("raw"))
    return df.select("host", "k1", "k2", F.expr(rf"transform(raw, l -> trim(regexp_replace(lower(l), '{_SPACE}', ' ')))").alias("norm")).select(
        "host", "k1", "k2", F.expr("transform(norm, l -> IF(l = '', 0L, xxhash64(host, l)))").alias("h"), F.expr("transform(norm, l -> IF(l = '', 0, length(l) - length(replace(l, ' ', '')) + 1))").alias("n")
    )


def lines_over_limit(docs: DataFrame, min_docs: int = 5, host_share: float = 0.01, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``h``: hashes of (host, line) above the host's limit."""
    lines = _lines(docs, text_col, host_col)
    each = lines.select("host", "k1", F.explode(F.expr("array_distinct(filter(h, x -> x <> 0))")).alias("h"))
    distinct = each.groupBy("host", "h", "k1").agg(F.lit(1).alias("one"))
    counted = distinct.groupBy("host", "h").count().where(F.col("count") > min_docs)
    t, host = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[host_col].cast("string"), F.lit(""))
    hosts = docs.select(host.alias("host"), F.xxhash64(host, t).alias("k1")).groupBy("host", "k1").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    return counted.join(hosts, "host").where(F.col("count") > F.lit(host_share) * F.col("docs")).select("h")


def _removed(docs: DataFrame, over: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``k1, k2, removed`` (words of removed lines), ``cut`` (places of removed lines) for texts that lose lines."""
    if over.count() <= BROADCAST_LINES:
        over = F.broadcast(over)
    rows = _lines(docs, text_col, host_col).select("k1", "k2", F.explode(F.expr("filter(transform(zip_with(h, n, (x, y) -> struct(x AS h, y AS n)), (s, i) -> struct(s.h AS h, i AS i, s.n AS n)), x -> x.h <> 0)")).alias("l")).select("k1", "k2", "l.h", "l.i", "l.n")
    hit = rows.join(over, "h").groupBy("k1", "k2", "i").agg(F.max("n").alias("n"))  # copies of a text count once
    return hit.groupBy("k1", "k2").agg(F.sum("n").alias("removed"), F.collect_list("i").alias("cut"))


def judge(docs: DataFrame, min_docs: int = 5, host_share: float = 0.01, min_left: tuple[int, int] = (1, 3), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``removed_words``, ``kept`` and ``clean_text``.

    A document is kept unless its base fails (under 50 words, or more than half
    of its words repeat in three-word windows) or less than ``min_left`` of its
    words are left. Null texts count as empty (base failed); a null host is a
    host of its own; repeated rows are judged alike; other columns stay as they
    are. An empty table gives no rows. Measures replace columns of their names.
    """
    over = cut(lines_over_limit(docs, min_docs, host_share, text_col, host_col))
    removed = _removed(docs, over, text_col, host_col).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "removed": "__removed", "cut": "__cut"})
    t, host = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[host_col].cast("string"), F.lit(""))
    own = [c for c in docs.columns if c not in MEASURES]
    df = docs.withColumns({"__k1": F.xxhash64(host, t), "__k2": F.xxhash64(F.lit(5), t, host)}).select(*own, "__k1", "__k2")
    df = base_columns(df, F.col(text_col).cast("string")).drop("__t").join(removed, ["__k1", "__k2"], "left")
    df = df.withColumns({
        "removed_words": F.coalesce(F.col("__removed"), F.lit(0)).cast("long"),
        "base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"),
    })
    num, den = min_left
    df = df.withColumn("kept", ~F.col("base_failed") & (den * (F.col("n_words") - F.col("removed_words")) >= num * F.col("n_words")))
    left = _let("ls", rf"split({text_col}, '\n')", "array_join(transform(array_except(sequence(0, size(ls) - 1), __cut), i -> get(ls, i)), '\\n')")
    clean = F.when(F.col("__cut").isNotNull(), F.expr(left)).otherwise(F.col(text_col))
    return df.withColumn("clean_text", clean).drop("__k1", "__k2", "__removed", "__cut")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "clean_text")
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")

ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM g),
c AS (SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM m WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY r),
ws AS (SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY r),
l AS (SELECT r, host, h, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
f AS (SELECT r, host, h, i, l, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS n FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM f GROUP BY r),
k AS (SELECT host, n, count(DISTINCT h) AS docs FROM f GROUP BY host, n HAVING count(DISTINCT h) > 5),
hosts AS (SELECT host, count(DISTINCT h) AS docs FROM d GROUP BY host),
over_limit AS (SELECT k.host, k.n FROM k JOIN hosts USING (host) WHERE k.docs > 0.01::DOUBLE * hosts.docs),
gone AS (SELECT r, sum(length(n) - length(replace(n, ' ', '')) + 1)::BIGINT AS removed_words FROM f JOIN over_limit USING (host, n) GROUP BY r),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN ws USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 3 * (n_words - removed_words) >= n_words AS kept FROM a
"""
