"""Coverage arithmetic, run fractions and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("succeeded", "partial", "failed", "skipped")


def coverage(df: DataFrame, group: str, state: Column) -> DataFrame:
    """Counts by state; attempted = succeeded + partial + failed, eligible = attempted + skipped; ``complete`` if nothing else."""
    counts = df.groupBy(group).agg(*(F.count_if(state == s).alias(s) for s in STATES))
    counts = counts.withColumn("attempted", F.expr("succeeded + partial + failed")).withColumn("eligible", F.expr("attempted + skipped"))
    return counts.withColumn("complete", F.expr("partial = 0 and failed = 0 and skipped = 0"))


def run_fraction(df: DataFrame, keys: list[str], run: str, runs: int) -> DataFrame:
    """Distinct runs that saw a key, and their share rounded to four places."""
    return df.groupBy(*keys).agg(F.countDistinct(run).alias("runs_seen")).withColumn("run_fraction", F.round(F.col("runs_seen") / F.lit(float(runs)), 4))


def roll_up(df: DataFrame, group: str, failed: Column, partial: Column) -> DataFrame:
    """A group failed if all its units did, is partial if any unit failed or was partial, else ok."""
    c = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(failed).alias("f"), F.count_if(partial).alias("p"))
    return c.select(group, "n", F.when(F.col("f") == F.col("n"), "failed").when((F.col("f") > 0) | (F.col("p") > 0), "partial").otherwise("ok").alias("outcome"))


def verdict(compiled: Column, ran: Column, passed: Column, total: Column, killed: Column) -> Column:
    """The ladder of test verdicts; the first rung that holds."""
    return F.when(~compiled, "uncompilable").when(~ran, "unrunnable").when(~passed, "wrong").when(total <= 0, "unverifiable").when(killed > 0, "useful").otherwise("vacuous")
