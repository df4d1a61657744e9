"""Hash-chained logs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold

GENESIS = "0" * 64


def build(df: DataFrame, chain: str, order: str, payload: Column) -> DataFrame:
    """Per chain ``seq, payload, prev_hash, hash``; each hash covers the one before.

    The chain is sequential: its rows pass in order (ties by payload, nulls
    first) through one task with one hash as state. A null payload is hashed as
    if there were none.
    """

    def link(state, _, text):
        seq, last = state or (0, GENESIS)
        new = hashlib.sha256((last if text is None else f"{last}|{text}").encode()).hexdigest()
        return (seq + 1, new), [(seq, text, last, new)]

    rows = df.select(F.col(chain), F.col(order).alias("__o"), payload.cast("string").alias("__p"))
    return ordered_fold(rows, [chain], ["__o", "__p"], "seq bigint, payload string, prev_hash string, hash string", link)


def verify(df: DataFrame, chain: str) -> DataFrame:
    """Per chain ``broken_at`` (first bad seq) and ``error``; null where the chain holds."""
    w = Window.partitionBy(chain).orderBy("seq")
    checked = df.withColumn("want", F.lag("hash", 1, GENESIS).over(w)).withColumn("again", F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256))
    error = F.when(F.col("prev_hash") != F.col("want"), "broken link").when(F.col("hash") != F.col("again"), "bad hash")
    return checked.withColumn("error", error).groupBy(chain).agg(F.min(F.when(F.col("error").isNotNull(), F.col("seq"))).alias("broken_at"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"))
