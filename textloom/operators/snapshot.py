"""Incremental snapshots: diff, upsert, scoped replace, cascading delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, status``: unchanged, changed, new or missing, by content digest."""
    a, b = old.select(key, F.col(digest).alias("__a")), new.select(key, F.col(digest).alias("__b"))
    status = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "missing").when(F.col("__a") == F.col("__b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key has no new row."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def append_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Replace the rows of the scope's keys only; new rows outside it are ignored."""
    names = scope.select(key).distinct()
    return old.join(names, key, "left_anti").unionByName(new.join(names, key, "left_semi"))


def cascade_delete(edges: DataFrame, gone: DataFrame, key: str, ends: list[str]) -> DataFrame:
    """Edges none of whose ends is gone."""
    for end in ends:
        edges = edges.join(gone.select(F.col(key).alias(end)).distinct(), end, "left_anti")
    return edges
