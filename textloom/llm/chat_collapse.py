"""Cumulative-snapshot collapse of logged conversations, all in DataFrame expressions.

A conversation that was logged again and again while it grew leaves rows that
are prefixes of one another. Rolling hashes name every turn prefix: the hash
after turn i is that after turn i-1 and a hash of i, the role and the text. A
conversation is a snapshot of a longer one if the name of all its turns is the
name of a proper prefix there; one anti-join drops such conversations, another
keeps one of equal ones (the smallest id). What remains is rendered.

Prefix names that several conversations share (a common first turn) are made
distinct under a partial aggregate before they are shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Opening and closing marks of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of the turns that belong to a conversation; nulls of role and text are empty."""
    own = turns.where(turns["conv_id"].isNotNull())
    return own.select(own["conv_id"].cast("long").alias("conv_id"), own["turn"].cast("long").alias("turn"), F.coalesce(own["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(own["text"].cast("string"), F.lit("")).alias("text"))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """Per turn in its conversation's order: ``conv_id, i, last`` (whether no turn follows) ``, a, b``, which name the turns up to this one.

    Both names are rolling: each turn adds, by exclusive or, a hash of its place,
    role and text. So a window takes one pass, and no conversation is gathered.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = _turns(turns).withColumn("i", F.row_number().over(order)).withColumn("last", F.lead("i").over(order).isNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.xxhash64("i", "role", "text"), F.xxhash64("text", F.lit(1), "role", "i", F.length("text"))
    return placed.select("conv_id", "i", "last", F.bit_xor(a).over(so_far).alias("a"), F.bit_xor(b).over(so_far).alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: ``conv_id, n_turns, n_chars, rendered``.

    Order within a conversation is by turn, then role, then text (nulls count
    as empty; a null turn comes first). Turns without a conversation id belong
    to none and are left out. Repeated rows are repeated turns. Other columns
    are ignored; an empty table gives no rows. Only conversations that are kept
    are gathered, as each is one row of the result.
    """
    names = written(turn_prefixes(turns))
    proper = names.where("NOT last").select("a", "b").distinct()
    first = names.where("last").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"))
    longest = first.join(proper, ["a", "b"], "left_anti").select("conv_id")
    kept = _turns(turns).join(longest, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.expr(rf"concat(array_join(transform(turns, t -> concat('{OPEN}', t.role, '\n', t.text, '{CLOSE}')), '\n'), '\n')")
    out = kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"))
    return out.select("conv_id", "n_turns", F.length("rendered").cast("long").alias("n_chars"), "rendered")


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY turn NULLS FIRST, role, text) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS name
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
own AS (SELECT name, min(conv_id) AS conv_id FROM p WHERE i = n GROUP BY name),
longest AS (SELECT conv_id FROM own WHERE name NOT IN (SELECT name FROM p WHERE i < n)),
r AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM t SEMI JOIN longest USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, length(rendered) AS n_chars, rendered FROM r
"""
