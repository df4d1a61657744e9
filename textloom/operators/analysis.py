"""Static analysis: findings attributed, enriched, triaged and accounted for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caps, coverage, nesting, store
from ..functions import paths as px


def attributed(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings ``id, file, line, ...`` with ``function``: the innermost of the functions ``file, start, end, name`` around the line, empty if none is."""
    # a finding goes through the windows whole: no join back by its id
    points = findings.select("file", "line", F.struct(*findings.columns).alias("__f"))
    found = nesting.innermost(points, functions, "file", "line", "start", "end", "__f", ["name"])
    return found.select("__f.*", F.coalesce("span_name", F.lit("")).alias("function"))


def triaged(findings: DataFrame, per_component: int) -> DataFrame:
    """Adds ``component`` and ``triaged``: whether the finding is among its component's first in triage order (severity, own library code first, line, id). ``caps.placed`` gives the places of all."""
    order = [*store.triage_order(), F.col("id")]
    return caps.with_rank_cap(findings.withColumn("component", px.component_for(F.col("file"))), "component", order, per_component, "triaged")


def analyse(findings: DataFrame, functions: DataFrame, summaries: DataFrame, per_component: int) -> DataFrame:
    """Findings with function, component, the file's purpose (empty if unknown), and triage; a file's summary is its row with the least purpose."""
    purposes = summaries.where(~store.is_placeholder(F.col("purpose"))).groupBy(F.col("path").alias("file")).agg(F.min("purpose").alias("file_purpose"))
    rows = attributed(triaged(findings, per_component), functions).join(purposes, "file", "left")
    return rows.withColumn("file_purpose", F.coalesce("file_purpose", F.lit("")))


def unit_coverage(units: DataFrame, findings: DataFrame, max_files: int) -> DataFrame:
    """Accounts per component over ``units(file, error)``: units beyond the first ``max_files`` of a component by rank are skipped, units with an error failed; ``with_findings`` counts units that have any."""
    keyed, order = caps.keyed(units.withColumn("component", px.component_for(F.col("file"))), px.path_rank(F.col("file")))
    ranked = caps.placed(keyed, "component", [*map(F.col, order)]).drop("size", *order)
    state = F.when(F.col("rn") > max_files, "skipped").when(F.col("error") != "", "failed").otherwise("succeeded")
    marked = ranked.withColumn("state", state).join(findings.select("file").distinct().withColumn("hit", F.lit(True)), "file", "left")
    hits = marked.where("state <> 'skipped'").groupBy("component").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("with_findings"))
    return coverage.coverage(marked, "component", F.col("state")).join(hits, "component", "left").withColumn("with_findings", F.coalesce("with_findings", F.lit(0)).cast("long"))
