"""Checks of generated tests against the code that they call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol classes of text sections, strong and weak.
TEXT_CLASSES = ("T", "t", "W", "w")


def arity_issues(calls: DataFrame, origins: DataFrame, modules: DataFrame, signatures: DataFrame) -> DataFrame:
    """Imported names that their module lacks, or that are called with too few or too many arguments.

    ``calls(test, name, n_args)``, ``origins(test, name, module, lineno)``,
    ``modules(module)`` of the repository, ``signatures(module, name, lineno,
    required, total, flexible)``. The last import and the last definition of a name
    count. Names of other modules, flexible signatures and calls without a count are
    not judged; of several wrong counts the least is reported.
    """
    last = origins.groupBy("test", "name").agg(F.max_by("module", "lineno").alias("module"))
    known = last.join(modules.select("module").distinct(), "module", "left_semi")
    signed = signatures.groupBy("module", "name").agg(F.max_by(F.struct("required", "total", "flexible"), "lineno").alias("s"))
    joined = calls.select("test", "name", "n_args").distinct().join(known, ["test", "name"]).join(signed, ["module", "name"], "left")
    wrong = ~F.col("s.flexible") & ~F.col("n_args").between(F.col("s.required"), F.col("s.total"))
    kind = F.when(F.col("s").isNull(), "missing").when(wrong, "arity")
    found = joined.withColumn("kind", kind).where("kind IS NOT NULL")
    counted = F.when(F.col("kind") == "arity", F.col("n_args"))
    return found.groupBy("test", "name", "module", "kind").agg(F.min(counted).alias("n_args"), F.first("s.required").alias("required"), F.first("s.total").alias("total"))


def text_symbols(listing: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Functions that symbol listings define: ``path, ord, symbol, class``. Lines of fewer than two fields are no symbols."""
    lines = listing.select(path, F.posexplode(F.split(text, "\n")).alias("ord", "line"))
    fields = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    return (
        lines.select(path, F.col("ord").cast("long").alias("ord"), fields.alias("f"))
        .where(F.size("f") >= 2)
        .select(path, "ord", F.element_at("f", -1).alias("symbol"), F.element_at("f", -2).alias("class"))
        .where(F.col("class").isin(*TEXT_CLASSES))
    )
