"""Groups, layouts and outlines of small catalogs: rules, diagram nodes, directories, compile databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a diagram from left to right, its margin, and the gaps between columns and rows.
COLUMNS = ("env", "component", "endpoint", "datastore", "external")
MARGIN, COLUMN_GAP, ROW_GAP = 40, 240, 90
#: Fixed value: a rule set of no more rules stays whole.
WHOLE_RULES = 8


def rule_groups(rules: DataFrame, granularity: str = "category") -> DataFrame:
    """Rules with the ``part`` of their set that they are asked in: all (empty name), by category, or by rule.

    ``rules(rule_set, rule_id, category)``. A rule without a category goes by
    the start of its id; a set of few rules, or of one category, stays whole.
    """
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.substring_index("rule_id", "-", 1))
    named = rules.withColumn("part", category)
    sizes = named.groupBy("rule_set").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))
    whole = F.lit(granularity == "all") | (F.col("n") <= WHOLE_RULES)
    split = F.col("rule_id") if granularity == "rule" else F.when(F.col("parts") >= 2, F.col("part")).otherwise("")
    return named.join(sizes, "rule_set").select("rule_set", "rule_id", F.when(whole, F.lit("")).otherwise(split).alias("part"))


def column_layout(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """Nodes with ``x`` by the column of their kind and ``y`` by their row in it; kinds without a column stand in the first.

    ``nodes(diagram, id, kind, ord)``. Kinds that share the first column count their rows apart.
    """
    place = F.array_position(F.array(*map(F.lit, COLUMNS)), F.col("kind"))
    row = F.row_number().over(Window.partitionBy("diagram", "kind").orderBy(order)) - 1
    x = MARGIN + F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)) * COLUMN_GAP
    return nodes.select("diagram", "id", x.cast("long").alias("x"), (MARGIN + row * ROW_GAP).cast("long").alias("y"))


def tree_outline(files: DataFrame, most: int = 400) -> DataFrame:
    """Directories of the first ``most`` paths, each with its sub-directories and files; the top is the empty path.

    ``files(path)``; the cap is the outline's own, by path order.
    """
    parts = F.split("path", "/")
    first = files.select("path").orderBy("path").limit(most)
    ends = F.sequence(F.lit(1), F.size(parts))
    steps = first.select(F.explode(F.transform(ends, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("dir"), F.get(parts, i - 1).alias("name"), (i == F.size(parts)).alias("leaf")))).alias("e")).select("e.*")
    listed = lambda leaf: F.array_join(F.sort_array(F.collect_set(F.when(F.col("leaf") == leaf, F.col("name")))), ",")
    return steps.groupBy("dir").agg(listed(False).alias("dirs"), listed(True).alias("files"))


def largest_compile_db(entries: DataFrame) -> DataFrame:
    """Per repository the compile database with most entries, of several the first: ``entries(repo, path, ord, n)``; unreadable ones (null) don't count."""
    best = F.max_by("path", F.struct("n", -F.col("ord")))
    return entries.where("n IS NOT NULL").groupBy("repo").agg(best.alias("path"), F.max("n").alias("n"))


def endpoint_policy(url: Column, host: Column, require_tls: bool, allowed: tuple[str, ...] = ()) -> Column:
    """Why an endpoint is refused (``plaintext``, ``host``), else ``ok``, or ``empty``; loopback hosts are exempt from both."""
    loopback = host.isNull() | host.isin("", "localhost", "::1") | host.rlike(r"^127(?:\.\d{1,3}){3}$")
    verdict = F.when(F.coalesce(url, F.lit("")) == "", "empty")
    if require_tls:
        verdict = verdict.when(~F.lower(url).startswith("https:") & ~loopback, "plaintext")
    if allowed:
        verdict = verdict.when(~loopback & ~host.isin(*allowed), "host")
    return verdict.otherwise("ok")
