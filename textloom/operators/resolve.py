"""Name resolution: longest prefix, precedence, unique match, grounding, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as px


def prefixes(parts: Column) -> Column:
    """All non-empty prefixes of an array, as structs (depth, joined)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix")))


def longest_prefix(df: DataFrame, row_id: str, parts: Column, index: DataFrame, name: str, target: str) -> DataFrame:
    """Each row with the target of its longest indexed prefix (null if none): an equi-join on prefixes."""
    each = df.select(row_id, F.explode(prefixes(parts)).alias("p")).select(row_id, "p.depth", F.col("p.prefix").alias(name))
    return each.join(index.select(name, target), name, "left").groupBy(row_id).agg(F.max_by(target, F.when(F.col(target).isNotNull(), F.col("depth"))).alias(target))


def precedence_resolve(calls: DataFrame, local: DataFrame, everywhere: DataFrame, local_keys: list[str], name: str, target: str) -> DataFrame:
    """Local definitions beat global ones; unresolved rows go."""
    a = local.select(*local_keys, F.col(target).alias("__l"))
    b = everywhere.select(name, F.col(target).alias("__g"))
    return calls.join(a, local_keys, "left").join(b, name, "left").withColumn(target, F.coalesce("__l", "__g")).where(F.col(target).isNotNull()).drop("__l", "__g")


def unique_match_repair(df: DataFrame, short: str, defs: DataFrame, full: str) -> DataFrame:
    """Rewrite a short name to its definition if exactly one has it; adds ``repaired``."""
    unique = defs.groupBy(short).agg(F.count("*").alias("__n"), F.first(full).alias("__full")).where("__n = 1").drop("__n")
    return df.join(unique, short, "left").withColumn("repaired", F.col("__full").isNotNull()).withColumn(full, F.coalesce("__full", short)).drop("__full")


def grounded(claims: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """Claims with ``verified``: whether the corpus knows them. A null claim is not verified."""
    return claims.join(known.select(on).where(F.col(on).isNotNull()).distinct().withColumn("__k", F.lit(True)), on, "left").withColumn("verified", F.coalesce("__k", F.lit(False))).drop("__k")


def suggestions(asked: DataFrame, paths: DataFrame, path: str, n: int = 3) -> DataFrame:
    """Known paths for an asked one (``ask``): those that end with it, else those of its base name; first ``n`` sorted.

    Both are joins on equality, with a known path's endings and with its base
    name. Of each base name, and of each ask's endings, only the first ``n``
    paths go on; tasks cut to ``n`` before they shuffle. Asks without any are left out.
    """
    known = paths.select(F.col(path).alias("__p")).where("__p IS NOT NULL").distinct().withColumn("__parts", F.split("__p", "/"))
    asks = asked.select("ask").distinct()

    def first(df: DataFrame, key: str, out: str) -> DataFrame:
        ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__p"))).where(F.col("__n") <= n)
        return ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("__p")), ",").alias(out))

    parts = F.col("__parts")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ending = first(known.select("__p", F.explode(endings).alias("ask")).join(asks, "ask"), "ask", "__s")
    named = first(known.select("__p", F.element_at(parts, -1).alias("__b")), "__b", "__a")
    got = asks.withColumn("__b", F.element_at(F.split("ask", "/"), -1)).join(named, "__b").join(ending, "ask", "left")
    return got.select("ask", F.coalesce("__s", "__a").alias("found"))


def rust_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rust imports with the file that they name: ``path, import, target``; paths of other crates give no row.

    ``imports(path, import)``, ``files(path, ord)``. ``crate`` stands for the first
    part of the importer's module, each ``super`` for a step up from it, and the
    longest prefix that is a module counts; of two files of one module the last.
    Prefixes are joined by equality.
    """
    index = files.select(px.rust_module_name(F.col("path")).alias("module"), "path", "ord").where("module IS NOT NULL").groupBy("module").agg(F.max_by("path", "ord").alias("target"))
    name = F.trim("import")
    segments = F.split(name, "::")
    own = F.split(F.coalesce(px.rust_module_name(F.col("path")), F.lit("crate")), "::")
    lead = F.filter(F.split(F.regexp_extract(name, r"^(?:(?:self|super)(?:::|$))+", 0), "::"), lambda p: p != "")
    ups = F.size(F.filter(lead, lambda p: p == "super"))
    rest = lambda n: F.slice(segments, n + 1, F.size(segments))
    base = F.when(F.size(own) > ups, F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    full = F.when(F.get(segments, 0) == "crate", F.concat(F.slice(own, 1, 1), rest(F.lit(1)))).when(F.size(lead) > 0, F.concat(base, rest(F.size(lead))))
    asked = imports.select("path", "import").distinct().withColumn("full", full).where("size(full) > 0")
    tried = asked.select("path", "import", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("full")), lambda n: F.array_join(F.slice("full", F.lit(1), n), "::"))).alias("n", "module"))
    return tried.join(index, "module").groupBy("path", "import").agg(F.max_by("target", "n").alias("target"))
