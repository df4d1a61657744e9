"""Grounding of generated texts: what they name, and whether the corpus holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as px

#: Suffixes of tokens that count as files, suffixes that are mentions only, and the forms of references.
FILE_SUFFIXES = (
    "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "py", "pyi", "rs", "cs", "go",
    "java", "kt", "swift", "rb", "js", "jsx", "ts", "tsx", "sh", "bash", "ps1",
    "yaml", "yml", "json", "toml", "ini", "cfg", "xml", "sql", "proto", "cmake",
    "mk", "bzl", "gradle", "csproj", "sln", "dockerfile", "drawio", "rst", "md",
)
MENTION_SUFFIXES = (".com", ".org", ".net", ".io", ".dev", ".md", ".txt")
PATH_FORM = r"(?U)(?<![\w/.-])((?:[\w.-]+/)*[\w.-]+\.[A-Za-z][A-Za-z0-9]{0,9})(?![\w/])"
CODE_SPAN_FORM = r"(?U)`([A-Za-z_][\w:.<>~]{2,})`"
QUALIFIED_CALL_FORM = r"(?U)\b([A-Za-z_]\w*\s*::\s*\w+)\s*\("
MEMBER_CALL_FORM = r"(?U)(?:\.|->)\s*(\w+)\s*\("
ANGLE_INCLUDE_FORM = r"(?m)^\s*#\s*include\s*<([^>]+)>"


def _every(text: Column, form: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(form), F.lit(1)))


def _last(name: Column, sep: str) -> Column:
    return F.element_at(F.split(name, sep), -1)


def external_includes(text: Column) -> Column:
    """Headers that a text itself declares to come from elsewhere, in order."""
    return _every(text, ANGLE_INCLUDE_FORM)


def path_references(text: Column) -> Column:
    """File-like tokens of a known suffix, declared externals left out."""
    suffix = lambda p: F.lower(_last(p, r"\."))
    mention = lambda p: F.lower(p).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in MENTION_SUFFIXES) + ")$")
    return F.array_except(F.filter(_every(text, PATH_FORM), lambda p: suffix(p).isin(*FILE_SUFFIXES) & ~mention(p)), external_includes(text))


def symbol_references(text: Column) -> Column:
    """Identifiers marked as code; dotted names that end in a word look like files and are left out."""
    plain = lambda s: ~s.contains(".") | ~_last(s, r"\.").rlike(r"(?U)^\p{L}+$") | s.contains("::")
    return F.array_except(F.filter(_every(text, CODE_SPAN_FORM), plain), path_references(text))


def qualified_calls(text: Column) -> Column:
    """Calls of a member by its type, as ``Type::member``."""
    return F.array_distinct(F.transform(_every(text, QUALIFIED_CALL_FORM), lambda c: F.regexp_replace(c, r"(?U)\s", "")))


def member_calls(text: Column) -> Column:
    """How many calls are by object: they can't be judged, so they are counted."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MEMBER_CALL_FORM), F.lit(1)))


def references(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, kind (path, symbol, call), ref`` of each text, once each. Null texts name nothing."""
    t = F.col(text_col)
    marked = docs.select(id_col, path_references(t).alias("p"), symbol_references(t).alias("s"), qualified_calls(t).alias("c"))
    kinds = {"path": F.col("p"), "symbol": F.col("s"), "call": F.array_except("c", "s")}

    def named(kind: str) -> Column:
        return F.transform(kinds[kind], lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    return marked.select(id_col, F.explode(F.concat(*map(named, kinds))).alias("r")).select(id_col, "r.*")


def grounded_references(refs: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``verified``; calls of types that the corpus doesn't define are left out.

    ``paths(path)``, ``symbols(name)``. A path is known if its file name is; a
    name is known itself or, if qualified, by its last part, never by its type
    alone. All joins are by equal names.
    """
    by_file = paths.select(px.basename(F.col("path")).alias("key")).distinct().withColumn("in_paths", F.lit(True))
    names = symbols.select(F.col("name").alias("key")).distinct()
    known = names.withColumn("in_names", F.lit(True))
    ref = F.col("ref")
    # one row a name to look up: the whole, and what follows the last ::
    keyed = refs.withColumn("file", F.when(F.col("kind") == "path", px.basename(F.regexp_replace(ref, r"^[./]+", ""))))
    keyed = keyed.withColumn("whole", F.when(F.col("kind") != "path", ref)).withColumn("member", F.when(F.col("whole").contains("::"), _last(ref, "::")))
    keyed = keyed.withColumn("type", F.when(F.col("kind") == "call", F.substring_index("ref", "::", 1)))
    joined = keyed.join(by_file.withColumnRenamed("key", "file"), "file", "left")
    for col in ("whole", "member", "type"):
        joined = joined.join(known.withColumnsRenamed({"key": col, "in_names": f"{col}_known"}), col, "left")
    seen = F.coalesce(F.when(F.col("kind") == "path", F.col("in_paths")).otherwise(F.coalesce("whole_known", "member_known")), F.lit(False))
    return joined.where("kind <> 'call' OR type_known").select(*refs.columns, seen.alias("verified"))


def grounding(docs: DataFrame, paths: DataFrame, symbols: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per text: sorted lists of verified and unverified references, externals, and the count of calls not judged."""
    found = grounded_references(references(docs, id_col, text_col), paths, symbols)
    lists = {f"{'' if ok else 'un'}verified_{kind}s": (F.col("verified") == ok) & (F.col("kind") == "path" if kind == "path" else F.col("kind") != "path") for kind in ("path", "symbol") for ok in (True, False)}
    per_text = found.groupBy(id_col).agg(*(F.sort_array(F.collect_set(F.when(cond, F.col("ref")))).alias(n) for n, cond in lists.items()))
    own = docs.select(id_col, F.sort_array(external_includes(F.col(text_col))).alias("external"), member_calls(F.col(text_col)).alias("unchecked"))
    filled = own.join(per_text, id_col, "left")
    return filled.select(id_col, "external", "unchecked", *(F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in lists))
