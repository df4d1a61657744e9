"""Verification of generated tests: what they reach, which mutants judge them, why they fail, what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caps, coverage, graph, grounding
from ..functions import paths as px

#: Why a build failed, and the verdicts that two of the causes put in place of a failure (fixed values).
TOOLCHAIN, ENVIRONMENT, FABRICATED, REPAIRABLE = "missing-framework", "environment", "fabricated-include", "repairable"
OVERRIDES = {TOOLCHAIN: "unverifiable", ENVIRONMENT: "environment"}
#: Messages that name a missing header (fixed values).
MISSING = r"'([^']+)' file not found|fatal error: ([^\s:]+): No such"


def missing_headers(log: Column) -> Column:
    """Headers that a build log misses, in order."""
    named = lambda n: F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(MISSING), F.lit(n))
    return F.zip_with(named(1), named(2), lambda a, b: F.when(a != "", a).otherwise(b))


def failure_causes(builds: DataFrame, wanted: DataFrame) -> DataFrame:
    """``test, cause`` of failed builds: ``builds(test, log, text)``, ``wanted(header)`` names of headers that the repository's own sources name.

    The first missing header that the test itself declares external, or that the
    repository wants too, decides; if neither is found the test made its headers
    up. A log that misses none is repairable.
    """
    b = builds.select("test", missing_headers(F.col("log")).alias("h"), grounding.external_includes(F.col("text")).alias("own"))
    each = b.select("test", "own", F.posexplode("h").alias("pos", "header")).withColumn("name", px.basename(F.col("header")))
    known = wanted.select(F.col("header").alias("name")).distinct().withColumn("wanted", F.lit(True))
    cause = F.when(F.array_contains("own", F.col("header")), TOOLCHAIN).when(F.col("wanted"), ENVIRONMENT)
    first = each.join(known, "name", "left").withColumn("cause", cause).groupBy("test").agg(F.min_by("cause", F.when(F.col("cause").isNotNull(), F.col("pos"))).alias("found"))
    return b.join(first, "test", "left").select("test", F.when(F.size("h") == 0, REPAIRABLE).otherwise(F.coalesce("found", F.lit(FABRICATED))).alias("cause"))


def sampled_mutants(reached: DataFrame, mutants: DataFrame, per_file: int, per_test: int) -> DataFrame:
    """Mutants ``test, path, ord`` that judge each test: of each file evenly spaced ones, of all those of the reached files every step-th.

    ``reached(test, path)``, ``mutants(path, ord)``.
    """
    few = graph.cut(caps.systematic_sample(mutants.select("path", "ord"), "path", [F.asc("ord")], per_file).select("path", "ord"))
    return caps.strided_sample(reached.join(few, "path"), "test", [F.asc("path"), F.asc("ord")], per_test).select("test", "path", "ord")


def verify(tests: DataFrame, seeds: DataFrame, edges: DataFrame, wanted: DataFrame, mutants: DataFrame, outcome: Column, per_file: int = 10, per_test: int = 10) -> DataFrame:
    """Verdict of each test: ``test, verdict, cause, total, killed, invalid, score``.

    ``tests(test, compiled, ran, passed, log, text)``, ``seeds(test, path)`` files
    that a test names, ``edges(src, dst)`` between files, ``wanted(header)``,
    ``mutants(path, ord)``; ``outcome`` of a (test, path, ord) is killed,
    survived or invalid. Only tests that pass on the right code meet mutants;
    invalid ones don't count, and a test without a valid one is unverifiable. A
    build that fails for want of a framework or of an outside header isn't
    blamed on the test.
    """
    good = tests.where("compiled AND ran AND passed").select("test")
    reached = graph.closure_by(seeds.join(good, "test", "left_semi").select(F.col("test").alias("seed"), F.col("path").alias("node")), edges, "src", "dst")
    tried = sampled_mutants(reached.select(F.col("seed").alias("test"), F.col("node").alias("path")), mutants, per_file, per_test).withColumn("outcome", outcome)
    count = lambda o: F.count_if(F.col("outcome") == o)
    tally = tried.groupBy("test").agg((count("killed") + count("survived")).alias("total"), count("killed").alias("killed"), count("invalid").alias("invalid"))
    causes = failure_causes(tests.where("NOT compiled").select("test", "log", "text"), wanted)
    joined = tests.join(tally, "test", "left").join(causes, "test", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    ladder = coverage.verdict(F.col("compiled"), F.col("ran"), F.col("passed"), number("total"), number("killed"))
    override = F.when(F.col("cause") == TOOLCHAIN, OVERRIDES[TOOLCHAIN]).when(F.col("cause") == ENVIRONMENT, OVERRIDES[ENVIRONMENT])
    score = F.round(F.try_divide(number("killed").cast("double"), number("total")), 3)
    return joined.select("test", F.coalesce(override, ladder).alias("verdict"), F.coalesce("cause", F.lit("")).alias("cause"), number("total").alias("total"), number("killed").alias("killed"), number("invalid").alias("invalid"), score.alias("score"))
