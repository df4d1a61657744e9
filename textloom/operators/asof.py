"""As-of and interval joins without range-join explosions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Each left row with the greatest (at, value) of the right not after it, per key.

    One union and one window on the key: no candidate pairs. ``left`` and
    ``right`` need ``key`` and ``at``; rows without a match get null.
    """
    cols = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), *cols)
    b = right.select(F.col(key), F.col(at), F.lit(0).alias("__side"), F.col(value).alias("__v"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols))
    w = Window.partitionBy(key).orderBy(at, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn(out, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__v")


def innermost_interval(points: DataFrame, spans: DataFrame, key: str, at: str, point_id: str, width: int) -> DataFrame:
    """Each point with the start of its innermost span [start, end] (the greatest start), null if none.

    Spans no longer than ``width`` are found among equal buckets of that width,
    so the join is on equality.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.select(F.col(key), F.col("start"), F.col("end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("__b"))
    hit = p.join(s, [key, "__b"], "left").withColumn("__s", F.when(F.col(at).between(F.col("start"), F.col("end")), F.col("start")))
    return hit.groupBy(point_id).agg(F.max("__s").alias("inner_start"))


def enclosing_or_preceding(points: DataFrame, spans: DataFrame, key: str, at: str, point_id: str, width: int) -> DataFrame:
    """Each point with the start of its innermost span, else of the nearest span that starts no later; null before all spans."""
    inner = innermost_interval(points, spans, key, at, point_id, width)
    starts = spans.select(key, F.col("start").alias(at), F.col("start").alias("__start"))
    before = asof_backward(points.select(key, at, point_id), starts, key, at, "__start", "__before").select(point_id, "__before")
    return inner.join(before, point_id).select(point_id, F.coalesce("inner_start", "__before").alias("start"))
