"""The query surface of the corpus store: bounded questions over files, symbols, calls, types, summaries and edges.

Tables: ``symbols`` (path, name, kind, lineno, signature, doc), ``calls`` (src_file, dst_file, caller, callee, line),
``types`` (qualified_name, kind, file, bases), ``io_edges`` (src, dst, kind, detail), ``summaries`` (path, purpose, source),
``cache`` (key, value, age_days), ``changes`` (path, old_path, status, is_binary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions.comments import CLOSED_STRING
from . import caps, dedupe, snapshot

CALLABLE = ("function", "method")
#: Kinds of edges in the order in which they are shown (fixed values).
EDGE_KINDS = ("import", "http", "datastore", "messaging", "socket")
SEVERITIES = ("critical", "high", "medium", "low", "info")


def short_name(qualified: Column) -> Column:
    """What follows the last ``::`` or dot."""
    return F.regexp_extract(qualified, r"([^.:]*)$", 1)


def is_placeholder(purpose: Column) -> Column:
    """Purposes that only tell a file's size."""
    return purpose.endswith(" bytes).")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)), F.lit(10)) - 1


def find_types(types: DataFrame, needle: str) -> DataFrame:
    """Types whose name holds ``needle`` whatever the case, with their bases one hop up."""
    return types.where(F.contains(F.lower("qualified_name"), F.lit(needle.lower()))).select("qualified_name", "kind", F.col("file").alias("path"), "bases")


def callers(calls: DataFrame, symbol: str) -> DataFrame:
    """Who calls a symbol from another file: one row a (file, caller) with its first known line."""
    rows = calls.where((F.col("callee") == symbol) & (F.col("src_file") != F.col("dst_file"))).select(F.col("src_file").alias("path"), "caller", "line")
    return dedupe.keep_min_known(rows, ["path", "caller"], "line")


def file_graph(calls: DataFrame, path: str) -> DataFrame:
    """Files that a file calls and files that call it, with the number of distinct callees."""
    edges = calls.where((F.col("src_file") != F.col("dst_file")) & ((F.col("src_file") == path) | (F.col("dst_file") == path)))
    out = F.col("src_file") == path
    return edges.select(F.when(out, "calls").otherwise("called by").alias("direction"), F.when(out, F.col("dst_file")).otherwise(F.col("src_file")).alias("path"), "callee").groupBy("direction", "path").agg(F.count_distinct("callee").alias("callees"))


def name_universe(symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Every name by which something may be mentioned: as it is, and its last segment."""
    names = symbols.select("name").union(types.select("qualified_name"))
    return names.select(F.explode(F.array("name", short_name(F.col("name")))).alias("name")).distinct()


def manifest(symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per file its purpose and the map from documented functions to their docs."""
    docs = symbols.where(F.col("kind").isin(*CALLABLE) & (F.col("doc") != "")).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), "doc"))), ";").alias("functions"))
    return summaries.join(docs, "path", "left").select("path", "purpose", F.coalesce("functions", F.lit("")).alias("functions"))


def key_symbols(symbols: DataFrame, most: int = 12) -> DataFrame:
    """Per file the first signatures (else names) that are no constants, and how many more there are."""
    shown = symbols.where("kind <> 'constant'").withColumn("s", F.coalesce(F.nullif("signature", F.lit("")), F.col("name")))
    ranked = shown.withColumns({"rn": F.row_number().over(Window.partitionBy("path").orderBy("lineno", "name")), "n": F.count("*").over(Window.partitionBy("path"))}).where(F.col("rn") <= most)
    listed = ranked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rn", "s"))).alias("a"), F.max("n").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("; +"), F.col("n") - most, F.lit(" more"))).otherwise(F.lit(""))
    return listed.select("path", F.concat(F.array_join(F.col("a.s"), "; "), more).alias("key_symbols"))


def set_symbol_doc(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """New docs for all symbols of a (path, name)."""
    return symbols.join(docs.withColumnRenamed("doc", "__new"), ["path", "name"], "left").withColumn("doc", F.coalesce("__new", "doc")).select(*symbols.columns)


def set_symbols(files: DataFrame, symbols: DataFrame, new: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Replace one file's symbols; the file's count follows."""
    kept = symbols.where(F.col("path") != path).unionByName(new.where(F.col("path") == path))
    counts = kept.groupBy("path").agg(F.count("*").alias("n_symbols"))
    return files.drop("n_symbols").join(counts, "path", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))), kept


def io_rollup(edges: DataFrame, per_kind: int = 30) -> DataFrame:
    """Edges by kind in the fixed order: total, and the first details."""
    known = F.array(*map(F.lit, EDGE_KINDS))
    distinct = edges.dropDuplicates(["src", "dst", "kind", "detail"])
    ranked = distinct.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("src", "dst", "detail")))
    return ranked.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= per_kind, F.struct("rn", F.concat("src", F.lit(">"), "dst").alias("e"))))), lambda x: x["e"]), ",").alias("edges")).withColumn("ord", F.nullif(F.array_position(known, F.col("kind")), F.lit(0)))


def component_graph(imports: DataFrame) -> DataFrame:
    """Component edges of file edges (src, dst), without those within a component."""
    return imports.select(px.component_for(F.col("src")).alias("src"), px.component_for(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def heavy_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Resolved calls of a heavy report: files by qualified name (the last definition wins), the report's own file before; unresolved ones fall out."""
    where = functions.groupBy("qualified_name").agg(F.max_by("file", "ord").alias("f"))
    a, b = (where.select(F.col("qualified_name").alias(c), F.col("f").alias(n)) for c, n in (("caller_qualified", "__src"), ("callee_qualified", "__dst")))
    joined = calls.join(a, "caller_qualified", "left").join(b, "callee_qualified", "left")
    return joined.select(F.coalesce(F.nullif("file", F.lit("")), F.col("__src")).alias("src_file"), F.coalesce(F.nullif("callee_file", F.lit("")), F.col("__dst")).alias("dst_file"), short_name(F.col("caller_qualified")).alias("caller"), short_name(F.col("callee_qualified")).alias("callee"), "line").where("src_file is not null and dst_file is not null")


def with_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity and category of the rule, else of the item, else defaults."""
    r = rules.select("rule_id", F.col("severity").alias("__s"), F.col("category").alias("__c"))
    return items.join(r, "rule_id", "left").withColumns({"severity": F.coalesce("__s", "severity", F.lit("medium")), "category": F.coalesce("__c", "category", F.lit("general"))}).drop("__s", "__c")


def triage_order() -> list[Column]:
    """Order of findings to look at: worst first, own library code before others."""
    return [severity_rank(F.col("severity")), *px.path_rank(F.col("file")), F.col("line")]


def name_status(lines: Column) -> Column:
    """A line of a name-status listing as a struct: path, old_path, status."""
    f = F.split(lines, "\t")
    code = F.left(F.get(f, 0), F.lit(1))
    status = F.when(code.isin("R"), "renamed").when(code.isin("A", "C"), "added").when(code == "D", "deleted").otherwise("modified")
    moved = code.isin("R", "C")
    return F.struct(F.when(moved, F.get(f, 2)).otherwise(F.get(f, 1)).alias("path"), F.when(code == "R", F.get(f, 1)).alias("old_path"), status.alias("status"))


def analyzable(changes: DataFrame, ignored: list[str]) -> tuple[DataFrame, DataFrame]:
    """Changes that can be analysed, and how many were dropped for what reason (the first that holds)."""
    reason = F.when(F.col("status") == "deleted", "deleted").when(F.col("is_binary"), "binary").when(px.is_vcs(F.col("path")), "vcs").when(F.col("path").rlike(px.glob_regex(ignored)), "ignored")
    marked = changes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def owning_components(components: DataFrame, delta: DataFrame) -> DataFrame:
    """Components that own a changed file (``component, path`` rows)."""
    return components.join(delta.select("path").distinct(), "path", "left_semi").select("component").distinct()


def stem(path: Column) -> Column:
    return F.regexp_replace(px.basename(path), r"\.[^.]*$", "")


def claimed_sources(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that a test's imports (``path, module``) name by their stem."""
    named = tests.select("path", short_name(F.col("module")).alias("stem"))
    return named.join(sources.select(F.col("path").alias("source"), stem(F.col("path")).alias("stem")), "stem").select("path", "source").distinct()


def header_companion(sources: DataFrame, headers: DataFrame, includes: DataFrame) -> DataFrame:
    """Per source its header: of the same stem, else the first included one of its directory."""
    folder = lambda p: F.regexp_replace(p, r"[^/]*$", "")
    h = headers.select(F.col("path").alias("header"))
    own = sources.join(h, (stem(F.col("path")) == stem(F.col("header"))) & (folder(F.col("path")) == folder(F.col("header")))).select("path", "header", F.lit(-1).alias("o"))
    other = includes.select("path", "pos", F.concat(folder(F.col("path")), F.col("include")).alias("header")).join(h, "header").select("path", "header", F.col("pos").alias("o"))
    return own.unionByName(other).groupBy("path").agg(F.min_by("header", F.struct("o", "header")).alias("header"))


def missing_headers(diagnostics: DataFrame, most: int = 5) -> DataFrame:
    """Most missed headers; ties in the order in which they were first seen."""
    return diagnostics.groupBy("header").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("header", "n")


def assertions(text: Column) -> Column:
    """Lines that assert something, strings blanked."""
    bare = F.regexp_replace(text, CLOSED_STRING, "")
    return F.size(F.filter(F.split(bare, "\n"), lambda line: line.rlike(r"\b(?:assert\w*|ASSERT_\w+|EXPECT_\w+)\b")))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("bytes"))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New values replace old ones of their key."""
    return snapshot.upsert(cache, new, ["key"])


def cache_pruned(cache: DataFrame, max_age: int) -> DataFrame:
    return cache.where(F.col("age_days") <= max_age)


def cache_kinds(cache: DataFrame) -> DataFrame:
    """Entries by what their JSON value holds; a value that isn't JSON is other."""
    purpose, doc = (F.get_json_object("value", f"$.{k}").isNotNull() for k in ("purpose", "doc"))
    return cache.groupBy(F.when(purpose, "purpose").when(doc, "doc").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def entry_points(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that start a program by their name, or hold a main function outside tests."""
    named = files.where(px.basename(F.col("path")).isin("main.py", "__main__.py", "app.py", "main.go", "main.rs", "Program.cs")).select("path")
    held = symbols.where(F.col("kind").isin(*CALLABLE) & F.col("name").rlike("^main$|Main$") & ~px.is_test(F.col("path"))).select("path")
    return named.union(held).distinct()


def capped_files(files: DataFrame, order: list[Column], most: int) -> DataFrame:
    """All files with ``kept`` for the first ``most`` in order: the skipped tail stays known.

    Only the paths of the first ``most`` are ranked in one place (a top-n).
    """
    ranked, names = caps.keyed(files, order)
    top = ranked.orderBy(*names).limit(most).select("path").withColumn("kept", F.lit(True))
    return files.join(top, "path", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def kind_filter(symbols: DataFrame, kinds: tuple[str, ...] = CALLABLE, prefix: str = "", n: int = 200) -> DataFrame:
    """Symbols of some kinds beneath a component's path, first ``n``."""
    return symbols.where(F.col("kind").isin(*kinds) & F.col("path").startswith(prefix)).orderBy("path", "lineno", "name").limit(n).select(F.col("path").alias("file"), "name", F.col("lineno").alias("line"))


