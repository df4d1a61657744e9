"""Deduplication with a defined representative, and anchored collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def keep_min_known(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """One row a key with its smallest non-zero line; null where none is known."""
    return df.groupBy(*keys).agg(F.min(F.nullif(F.col(line), F.lit(0))).alias(line))


def keep_first_by(df: DataFrame, keys: list[str], carried: list[str], line: str) -> DataFrame:
    """One row a key: that of the smallest known line, with the columns it carries."""
    row = F.struct(F.coalesce(F.nullif(F.col(line), F.lit(0)), F.lit(2147483647)).alias("o"), *carried)
    return df.groupBy(*keys).agg(F.min(row).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in carried), F.when(F.col("r.o") < 2147483647, F.col("r.o")).alias(line))


def definitions(df: DataFrame, name: str, is_double: Column, ord_col: str, where: str) -> DataFrame:
    """Per name where it is defined: the first definition that is no test double, else the first."""
    return df.groupBy(name).agg(F.min_by(F.col(where), F.struct(is_double.alias("d"), F.col(ord_col).alias("o"))).alias(where))


def anchored_collapse(df: DataFrame, keys: list[str], at: str, tolerance: int, carried: str) -> DataFrame:
    """Per key, drop rows within ``tolerance`` of the last *kept* one; anchors don't move with dropped rows.

    The anchor depends on all before it: a key's rows pass in order (ties by
    ``carried``) through one task, whose state is the last anchor. Rows without
    a place are never kept.
    """

    def keep(anchor, place, value):
        if anchor is not None and place - anchor <= tolerance:
            return anchor, []
        return place, [(place, value)]

    rows = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("__at"), F.col(carried).cast("long").alias("__c"))
    kept = ordered_fold(rows, keys, ["__at", "__c"], "__at bigint, __c bigint", keep)
    return kept.select(*keys, F.col("__at").alias(at), F.col("__c").alias(carried))
