"""Graph closure and degree caps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names. A local one is made only where it names none and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: lost executors then cost no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which one side of a hop is sent to all tasks; above, both sides are sorted.
SMALL = 10_000


def sided(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows as a side of a join: what is small is sent around, never the edges for want of statistics."""
    return F.broadcast(df) if n <= SMALL else df.hint("merge")


def closure(seeds: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node``: all that the seeds (``node``) reach, themselves included. Safe on cycles; one round a hop."""
    seen = frontier = cut(seeds.select("node").distinct())
    new = known = seen.count()
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    while True:
        frontier = cut(step.join(sided(frontier, new), "node").select(F.col("next").alias("node")).distinct().join(sided(seen, known), "node", "left_anti"))
        new = frontier.count()
        if new == 0:
            return seen
        known += new
        seen = cut(seen.union(frontier))


def closure_by(seeds: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``seed, node``: all that each seed's nodes reach, themselves included. Safe on cycles; one round a hop for all seeds at once."""
    seen = frontier = cut(seeds.select("seed", "node").distinct())
    new = known = seen.count()
    step, rounds = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")), 0
    while True:
        frontier = cut(step.join(sided(frontier, new), "node").select("seed", F.col("next").alias("node")).distinct().join(sided(seen, known), ["seed", "node"], "left_anti"))
        new = frontier.count()
        if new == 0:
            return seen
        known += new
        rounds += 1
        seen = seen.union(frontier)  # of checkpoints: nothing is worked out again
        if rounds % 16 == 0:
            seen = cut(seen)


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``node, degree``: edges in and out."""
    return edges.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_cap(edges: DataFrame, src: str, dst: str, n: int) -> DataFrame:
    """Edges between the ``n`` nodes of highest degree (ties to the smaller node)."""
    top = F.broadcast(degrees(edges, src, dst).orderBy(F.desc("degree"), "node").limit(n).select("node"))  # n rows
    return edges.join(top.withColumnRenamed("node", src), src, "left_semi").join(top.withColumnRenamed("node", dst), dst, "left_semi")
