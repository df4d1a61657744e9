"""Enclosing scopes of tokens: nesting without a stack, from sums of depths.

A scope's start raises the depth by one, its end lowers it. Between two tokens
the depth moves by single steps, so what encloses a token of level L is the last
earlier start that raised the depth to L: a window over (key, level) finds it,
and no key's tokens are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: HTML elements without an end tag (fixed values).
VOID = "area base br col embed hr img input link meta source track wbr".split()
#: Words before parentheses that call nothing (fixed values).
CONTROL = "if for while switch catch return sizeof do else new delete throw".split()
#: Comments, and elements whose content isn't markup.
OPAQUE = r"(?s)<!--.*?-->|(<script\b[^>]*>).*?(</script>)|(<style\b[^>]*>).*?(</style>)"


def paired(tokens: DataFrame, key: str, pos: str, name: str, kind: str) -> DataFrame:
    """``tokens`` whose ``kind`` is 0 (no scope) for starts (1) and ends (-1) that have no partner of their name.

    Ends without an earlier start of their name are dropped. Within a name an
    end closes the latest open start, so a start stays open exactly if the
    name's depth never falls below its own again.
    """
    w = Window.partitionBy(key, name).orderBy(pos)
    depth = F.sum(kind).over(w)
    low = F.least(F.lit(0), F.min("__d").over(w))
    t = tokens.withColumn("__d", depth).withColumn("__low", low)
    # an end that pushes the running minimum below zero has no start
    t = t.withColumn("__lone", (F.col(kind) == -1) & (F.col("__low") < F.lag("__low", 1, 0).over(w))).withColumn("__c", F.col("__d") - F.col("__low"))
    later = F.min("__c").over(w.rowsBetween(1, Window.unboundedFollowing))
    t = t.withColumn(kind, F.when((F.col(kind) == 1) & ~F.coalesce(later < F.col("__c"), F.lit(False)), F.lit(0)).otherwise(F.col(kind)))
    return t.where("NOT __lone").drop("__d", "__low", "__lone", "__c")


def _depths(tokens: DataFrame, key: str, pos: str, kind: str) -> DataFrame:
    """Adds ``__d``: the depth after each token; ends beyond all starts don't lower it."""
    w = Window.partitionBy(key).orderBy(pos)
    t = tokens.withColumn("__d", F.sum(kind).over(w))
    return t.withColumn("__d", (F.col("__d") - F.least(F.lit(0), F.min("__d").over(w))).cast("long"))


def _last_start(t: DataFrame, key: str, pos: str, kind: str, asked: Column, carried: list[str]) -> DataFrame:
    """Adds ``__a`` (place and carried columns): the last earlier start that raised the depth to ``asked``."""
    roles = F.array(F.struct(asked.alias("at"), F.lit(True).alias("asks")), F.when(F.col(kind) == 1, F.struct(F.col("__d").alias("at"), F.lit(False).alias("asks"))))
    rows = t.withColumn("__r", F.explode(F.array_compact(roles)))
    answer = F.when(~F.col("__r.asks"), F.struct(F.col(pos).alias("p"), *(F.col(c).alias(c) for c in carried)))
    last = F.last(answer, ignorenulls=True).over(Window.partitionBy(key, F.col("__r.at")).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__a", last).where("__r.asks").drop("__r")


def enclosing(tokens: DataFrame, key: str, pos: str, kind: str, carried: list[str] = ()) -> DataFrame:
    """``tokens`` with ``level`` (scopes around each, its own not counted) and ``parent`` (place of the innermost, null at level 0), and ``parent_<c>`` of the carried columns.

    ``kind`` is 1 for a start, -1 for an end and 0 for a token without a scope of
    its own; what encloses an end is what encloses the scope that it closes. Ends
    beyond all starts close nothing. Scopes that cross are paired by depth alone.
    """
    t = _depths(tokens, key, pos, kind).withColumn("level", F.when(F.col(kind) == 1, F.col("__d") - 1).otherwise(F.col("__d")))
    found, inside = _last_start(t, key, pos, kind, F.col("level"), list(carried)), F.col("level") > 0
    return found.select(*tokens.columns, "level", F.when(inside, F.col("__a.p")).alias("parent"), *(F.when(inside, F.col(f"__a.{c}")).alias(f"parent_{c}") for c in carried))


def enclosing_named(tokens: DataFrame, key: str, pos: str, kind: str, names: str, carried: list[str] = ()) -> DataFrame:
    """As ``enclosing``, of the nearest scope whose start has ``names`` set; other scopes hand on what is around them."""
    t = _depths(tokens, key, pos, kind)
    t = _last_start(t, key, pos, kind, F.when(F.col(kind) == -1, F.col("__d") + 1).otherwise(-1), [names])
    own = F.when((F.col(kind) == 1) & F.col(names), 1).when((F.col(kind) == -1) & F.coalesce(F.col(f"__a.{names}"), F.lit(False)), -1).otherwise(0)
    return enclosing(t.withColumn("__own", own).drop("__d", "__a"), key, pos, "__own", carried).drop("__own")


def tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Tags of each page: ``key, pos, name, kind``; comments, scripts and styles are opaque."""
    bare = F.regexp_replace(html, OPAQUE, "$1$2$3$4")
    found = F.regexp_extract_all(bare, F.lit(r"</?[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    t = pages.select(key, F.posexplode(found).alias("pos", "tag"))
    name = F.lower(F.regexp_replace("tag", "[</]", ""))
    kind = F.when(name.isin(*VOID), 0).when(F.startswith("tag", F.lit("</")), -1).otherwise(1)
    return t.select(key, F.col("pos").cast("long").alias("pos"), name.alias("name"), kind.alias("kind")).where(~(F.startswith("tag", F.lit("</")) & F.col("name").isin(*VOID)))


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, point_id: str, carried: list[str] = ()) -> DataFrame:
    """Each point's id with ``level`` and the innermost of arbitrarily wide, nested spans around it (both ends included): ``span_start`` and ``span_<c>``.

    Spans of a key may nest or lie apart, but must not cross; equal spans nest
    in any order. At one place starts come before points, points before ends,
    wider spans start first and end last. Points outside all spans get nulls.
    """
    place = lambda a, side, tie: F.struct(F.col(a).cast("double").alias("a"), F.lit(side).alias("s"), tie.alias("t"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    starts = spans.select(key, place(start, 0, -F.col(end).cast("double")).alias("__pos"), F.lit(1).alias("__kind"), none(points, point_id), F.col(start).alias("__start"), *carried)
    ends = spans.select(key, place(end, 2, -F.col(start).cast("double")).alias("__pos"), F.lit(-1).alias("__kind"), none(points, point_id), F.col(start).alias("__start"), *carried)
    marks = points.select(key, place(at, 1, F.lit(0.0)).alias("__pos"), F.lit(0).alias("__kind"), point_id, none(spans, start).alias("__start"), *(none(spans, c) for c in carried))
    found = enclosing(starts.unionByName(ends).unionByName(marks), key, "__pos", "__kind", ["__start", *carried]).where(F.col("__kind") == 0)
    return found.select(key, point_id, "level", F.col("parent___start").alias("span_start"), *(F.col(f"parent_{c}").alias(f"span_{c}") for c in carried))


def call_sites(files: DataFrame, key: str, text: str) -> DataFrame:
    """Call sites of brace languages with the function around them: ``key, pos, callee, function`` (null at top level).

    ``text`` has its comments and strings blanked. A brace after a name and
    parentheses opens that function's scope, unless the name is a word of the
    language; other braces are blocks, whose calls belong to the function around.

    One scan a text with the open braces' functions on a stack: neither a sort
    nor a window, so a task holds one batch of texts, whatever their number.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, code in enumerate(batch.column(1).to_pylist()):
                rows += [(i, *site) for site in _sites(code or "")]
                if len(rows) > 50_000:
                    yield _site_batch(batch, rows)
                    rows = []
            yield _site_batch(batch, rows)

    given = files.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    found = given.mapInArrow(scan, f"__key {given.schema['__key'].dataType.simpleString()}, pos bigint, callee string, function string")
    return found.withColumnRenamed("__key", key)


_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+\s*+\([^(){};]*+\)\s*+\{|[A-Za-z_][A-Za-z0-9_]*+\s*+\(|[{}]", re.ASCII)
_WORD = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def _sites(code: str) -> Iterator[tuple[int, str, str | None]]:
    """Calls in order: place among the tokens, name, function around."""
    around: list[str | None] = []  # of each open brace the function that it stands in
    for pos, m in enumerate(_TOKEN.finditer(code)):
        token, inside = m[0], around[-1] if around else None
        if token == "}":
            if around:
                around.pop()
            continue
        word = _WORD.match(token)
        name = word[0] if word and word[0] not in CONTROL else None
        if token[-1] == "{":
            around.append(name or inside)
        elif name:
            yield pos, name, inside


def _site_batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    i, pos, callee, function = zip(*rows, strict=True) if rows else ((), (), (), ())
    keys = batch.column(0).take(pa.array(i, pa.int64()))
    return pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int64()), pa.array(callee, pa.string()), pa.array(function, pa.string())], names=["__key", "pos", "callee", "function"])
