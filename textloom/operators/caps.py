"""Bounded selections: they rank before they cut, and say what they cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, sided


def cap_per_key(df: DataFrame, key: str | list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of each key by ``order`` (which must break all ties); adds the rank."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def fair_cap(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Round robin: one row of each key a round until ``n`` are taken; adds ``rn`` (round) and ``pick``.

    Only rows of the first ``n`` rounds can be taken, and of those the first n by
    (round, key): a top-n, so the numbering window sees n rows whatever the input.
    """
    top = cap_per_key(df, key, order, n).orderBy("rn", key).limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("rn", key)))


def capped_with_note(df: DataFrame, order: list[Column], n: int, text: Column) -> DataFrame:
    """First ``n`` rows as ``(pos, line)``, then one row that tells how many are not shown."""
    total = df.agg(F.count("*").alias("total"))
    shown = df.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"), text.alias("line"))
    note = total.where(F.col("total") > n).select(F.lit(n + 1).cast("long").alias("pos"), F.concat(F.lit("+"), F.col("total") - n, F.lit(" more")).alias("line"))
    return shown.unionByName(note)


def clip_in_order(df: DataFrame, key: str, preference: list[Column], position: list[Column], n: int) -> DataFrame:
    """Choose ``n`` rows of each key by preference, number them (``pos``) by position."""
    chosen = cap_per_key(df, key, preference, n).drop("rn")
    return chosen.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*position)))


def tasks(df: DataFrame, rows: int) -> int:
    """The number of tasks of about ``rows`` rows; for ``repartition``, where a task's share must not depend on the table's files or the session's partitions."""
    return max(1, -(-df.count() // rows))


def keyed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[str]]:
    """``df`` with the (ascending) order's expressions as columns, and their names: a sort or a top-n works out expressions at every comparison, columns once a row."""
    names = [f"__o{i}" for i in range(len(order))]
    return df.withColumns(dict(zip(names, order, strict=True))), names


def placed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``rn`` (place within the key, from 1) and ``size`` without gathering a key in one task.

    Rows are dealt by ranges of (key, order); a place is that within the range
    plus the sizes of the key's ranges before it, of which there are at most as
    many as partitions. The ranges are kept, as they come from a sample.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, F.asc(key), *order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy(key)
    sizes = dealt.groupBy(key, "__p").agg(F.count("*").alias("__n"))
    sizes = sizes.select(key, "__p", (F.sum("__n").over(w.orderBy("__p")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("size"))
    joined = dealt.join(sizes.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")) & (dealt["__p"] == sizes["__p"])).drop(sizes["__p"], "__key")
    return joined.withColumn("rn", F.row_number().over(Window.partitionBy(key, "__p").orderBy(*order)) + F.col("__before")).drop("__p", "__before")


def systematic_sample(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """``n`` evenly spaced rows of each key: places floor(k * size / n); all rows of smaller keys."""
    df = placed(df, key, order)
    i = F.col("rn") - 1
    # i = floor(k*size/n) for some k exactly if the count of multiples of size/n grows past i
    k = F.ceil(i * n / F.col("size")).cast("long")
    hit = (F.col("size") <= n) | ((F.floor(k * F.col("size") / n) == i) & (k < n))
    return df.where(hit).drop("size")


def strided_sample(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Every step-th row of each key, step = max(1, size div n), at most ``n``."""
    df = placed(df, key, order).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("size") / n)))
    return df.where(((F.col("rn") - 1) % F.col("step") == 0) & (F.floor((F.col("rn") - 1) / F.col("step")) < n)).drop("step", "size")


def with_rank_cap(df: DataFrame, key: str, order: list[Column], n: int, name: str = "kept") -> DataFrame:
    """All rows, with ``name``: whether the row is among its key's first ``n``. The order must tell all rows of a key apart.

    Each task hands on its own first ``n`` rows of a key, of which the key's
    ``n``-th is the bound; the rows themselves stay where they are.
    """
    ranked, names = keyed(df, order)
    first = ranked.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*names))).where(F.col("__rn") <= n)
    last = cut(first.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*names)).alias("__last")))
    joined = ranked.join(sided(last, last.count()), F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn(name, F.struct(*names) <= F.col("__last")).drop("__key", "__last", *names)
