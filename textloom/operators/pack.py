"""Budget packing in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def budget_pack(df: DataFrame, order: list[Column], cost: str, budget: int, key: str | None = None, most: int | None = None, room: int = 50) -> DataFrame:
    """Blocks whose running cost stays within the budget, and the first that overflows.

    Adds ``running``, ``fits`` and ``cut`` (the overflowing block is worth cutting:
    more than ``room`` is left). A window sums up all of a key (or of the table)
    in one task, so ``most`` first keeps the best ranked rows of each: as a row
    costs at least one, budget + 1 always suffice, and tasks cut to them before
    they shuffle. With a key, rows that cost nothing are kept beside them; without
    one they count like the others.
    """
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(*order)
    if key is None:
        df = df.orderBy(*order).limit(most or budget + 1)
    else:
        df = df.withColumn("__free", F.when(F.col(cost) <= 0, F.monotonically_increasing_id()))  # each of these is a group of its own
        ranked = Window.partitionBy(key, "__free").orderBy(*order)
        df = df.withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= (most or budget + 1)).drop("__n", "__free")
    df = df.withColumn("running", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("before", F.col("running") - F.col(cost)).withColumn("fits", F.col("running") <= budget)
    first_over = F.coalesce(F.lag("fits").over(w), F.lit(True)) & ~F.col("fits")
    df = df.withColumn("over", first_over).where("fits or over")
    return df.withColumn("cut", F.col("over") & (budget - F.col("before") > room)).drop("before", "over")


def cut_lines(text: Column, room: Column, mark: str) -> Column:
    """The lines of a text, from the first, whose estimated tokens and one for each line feed stay within ``room``.

    ``mark`` stands as the last line if any line is left out. One pass over the
    lines; the line feed that ends a text begins no further line.
    """
    lines = F.split(F.regexp_replace(text, r"(?:\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def take(s, line):
        used = s["used"] + token_estimate(line) + 1
        fits = s["open"] & (used <= room)
        return F.struct(used.alias("used"), (s["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    kept = F.aggregate(lines, start, take, lambda s: s["kept"])
    held = F.get(F.transform(F.array(F.struct(lines.alias("l"), kept.alias("k"))), lambda x: F.concat(F.slice(x["l"], F.lit(1), x["k"]), F.when(x["k"] < F.size(x["l"]), F.array(F.lit(mark))).otherwise(F.array().cast("array<string>")))), 0)
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(held, "\n"))


def packed_texts(packed: DataFrame, texts: DataFrame, on: str, text: str, cost: str, budget: int, mark: str = "… (truncated)") -> DataFrame:
    """Rows of ``budget_pack`` with ``block``: the text where it fits, its first lines where it is cut, null where nothing of it is taken.

    Only rows that were packed meet their texts again, by ``on``.
    """
    room = budget - (F.col("running") - F.col(cost))
    return packed.join(texts.select(on, text), on).withColumn("block", F.when(F.col("fits"), F.col(text)).when(F.col("cut"), cut_lines(F.col(text), room, mark)))
