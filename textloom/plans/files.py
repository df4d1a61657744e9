"""Extractors and sources over files that are rendered from the given tables' rows; the oracles tell what those rows must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as px
from ..operators import extract
from ..sources import readers
from .derived import reading, with_derived
from .registry import query


def over(body: str, *names: str):
    """Register a query ``(table by name) -> DataFrame`` that may read derived tables."""

    def register(fn):
        def run(t):
            return fn(reading(t))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(f"{with_derived(*names)}{', ' if body.startswith('+') else ' '}{body.removeprefix('+')}" if names else body)(run)
        return fn

    return register


@over("""SELECT path, language, CASE WHEN starts_with(path, 'src/') THEN split_part(path, '/', 2) WHEN starts_with(path, 'vendor/') THEN 'vendor/x' ELSE split_part(path, '/', 1) END AS component, starts_with(path, 'tests/') AS is_test FROM files""", "files")
def classify_paths(t):
    """SF-1, SF-3, FL-9, FL-12: language, component and test predicate of files outside version control."""
    p = F.col("path")
    return t("files").where(~px.is_vcs(p)).select("path", px.detect_language(p).alias("language"), px.component_for(p).alias("component"), px.is_test(p).alias("is_test"))


@over("""
SELECT path, 'open' || p_size AS name, 'function' AS kind, 1 AS lineno, string_split(text, chr(10))[1] AS signature FROM code_files
UNION ALL SELECT path, 'S' || p_size, 'class', 3, string_split(text, chr(10))[3] FROM code_files
""", "code_files")  # fmt: skip
def symbols_regex(t):
    """EX-2: symbols by line patterns of each language."""
    return extract.regex_symbols(t("code_files").select("path", "text", px.detect_language(F.col("path")).alias("language")))


_PARTS = "SELECT 'src/p' || p_partkey || '.py' AS path, p_partkey AS k, p_size AS n, p_name FROM part WHERE p_size <> 13"


@over(f"""
WITH p AS ({_PARTS})
SELECT path, 'LIMIT' || k AS name, 'constant' AS kind, 4 AS lineno, 'LIMIT' || k AS signature, '' AS parent, '' AS doc FROM p
UNION ALL SELECT path, 'C' || k, 'class', 5, 'C' || k, '', 'Keeps ' || p_name || '.' FROM p
UNION ALL SELECT path, 'get', 'method', 7, 'get(self, n)', 'C' || k, '' FROM p
UNION ALL SELECT path, 'f' || k, 'function', 10, 'f' || k || '(a, b)', '', '' FROM p
""")
def symbols_python_ast(t):
    """EX-1: symbols of Python files by their syntax trees; files that don't parse give none."""
    return extract.python_symbols(t("python_files").withColumn("ord", F.lit(1)))


@over(f"""
WITH p AS ({_PARTS})
SELECT path, 'os' AS module, 0 AS level FROM p UNION ALL SELECT path, 'a.b' || n, 0 FROM p
UNION ALL SELECT path, CASE n % 3 WHEN 0 THEN 'db' ELSE 'x.y' END, CASE n % 3 WHEN 0 THEN 2 ELSE 0 END FROM p WHERE n % 3 < 2
""")
def imports_python(t):
    """EX-3: imported modules of Python files."""
    return extract.python_imports(t("python_files").withColumn("ord", F.lit(1)))


@over("""
SELECT path, unnest(['crate::api::app' || n, 'crate::api::other::X', 'crate::api::other::Y', CASE n % 2 WHEN 0 THEN 'self::inner' || n ELSE 'std::fmt' END]) AS module
FROM (SELECT 'src/r' || p_partkey || '.rs' AS path, p_size AS n FROM part)
""")
def imports_rust(t):
    """EX-4: imported paths of Rust files."""
    return extract.rust_imports(t("rust_files").withColumn("ord", F.lit(1)))


@over(f"WITH p AS ({_PARTS}) SELECT path, 'C' || k AS name, 5 AS lineno, 'Base,m.M' || n AS bases FROM p")
def types_python(t):
    """EX-5: classes of Python files with their bases."""
    return extract.python_types(t("python_files").withColumn("ord", F.lit(1)))


@over("""
WITH p AS (SELECT 'src/p' || p_partkey || '.py' AS path, p_size AS n FROM part WHERE p_size <> 13)
SELECT path, 8 AS line, 'return' AS operator, 'return n' AS before, 'return None' AS after FROM p
UNION ALL SELECT path, 11, 'eq', 'if a == ' || n || ':', 'if a != ' || n || ':' FROM p
UNION ALL SELECT path, 12, 'true', 'return True', 'return False' FROM p
""")
def mutants(t):
    """EX-12: one mutant a line of Python files."""
    return extract.mutants(t("python_files").withColumn("ord", F.lit(1)))


@query("""
SELECT 'r' || (l_suppkey % 10) AS checker, CASE l_linenumber WHEN 1 THEN 'error' WHEN 3 THEN 'warning' ELSE 'note' END AS status, CASE WHEN l_linenumber <> 4 THEN 'f' || l_partkey || '.c' END AS file,
CASE WHEN l_linenumber <> 4 THEN l_suppkey END::INT AS line, CASE WHEN l_linenumber <> 4 THEN l_linenumber END::INT AS "column", 'm' || l_orderkey AS message, CASE WHEN l_linenumber % 2 = 1 THEN 'c' || l_suppkey ELSE '' END AS called_from
FROM lineitem WHERE l_linenumber <> 2
""")
def sarif_source(t):
    """SC-9: findings of SARIF texts, one a order; second lines are proven safe, third ones have no level, fourth ones no place."""
    n = F.col("l_linenumber")
    place = F.struct(F.struct(F.struct(F.concat(F.lit("f"), F.col("l_partkey"), F.lit(".c")).alias("uri")).alias("artifactLocation"), F.struct(F.col("l_suppkey").alias("startLine"), n.alias("startColumn")).alias("region")).alias("physicalLocation"))
    frame = F.struct(F.struct(F.struct(F.concat(F.lit("Call from c"), F.col("l_suppkey")).alias("text")).alias("message")).alias("location"))
    result = F.struct(
        F.concat(F.lit("r"), F.col("l_suppkey") % 10).alias("ruleId"), F.when(n == 1, "error").when(n == 2, "ok").when(n != 3, "note").alias("level"), F.struct(F.concat(F.lit("m"), F.col("l_orderkey")).alias("text")).alias("message"),
        F.when(n != 4, F.array(place)).alias("locations"), F.when(n % 2 == 1, F.array(F.struct(F.array(frame).alias("frames")))).alias("stacks"),
    )
    texts = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(result).alias("results")).select(F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))).alias("json"))
    return readers.sarif_findings(texts)


@query("""
SELECT CASE event_id % 3 WHEN 0 THEN 'a' || user_id ELSE 'c' || user_id END AS checker, CASE event_id % 3 WHEN 0 THEN event_type END AS status, CASE event_id % 3 WHEN 0 THEN 'x' ELSE 'y' END || event_id || '.c' AS file,
json_extract_string(props, '$.k')::INT AS line, 'm ' || event_type AS message FROM events WHERE event_id % 3 <> 1
""")
def tolerant_findings(t):
    """SC-10: findings of loosely shaped JSON, of which each text has three kinds of names; safe ones don't count."""
    at = lambda col: F.concat(F.lit('"'), col, F.lit('"'))
    k, u, e, kind = F.get_json_object("props", "$.k"), F.col("user_id"), F.col("event_id"), F.col("event_type")
    first = F.concat(F.lit('{"check": "a'), u, F.lit('", "result": '), at(kind), F.lit(', "path": "x'), e, F.lit('.c", "lineno": '), k, F.lit(', "msg": "m '), kind, F.lit('"}'))
    third = F.concat(F.lit('{"rule": "c'), u, F.lit('", "file": "y'), e, F.lit('.c", "line": "'), k, F.lit('", "text": "m '), kind, F.lit('"}'))
    item = F.when(e % 3 == 0, first).when(e % 3 == 1, F.concat(F.lit('{"id": "b'), u, F.lit('", "status": "ok"}'))).otherwise(third)
    listed = t("events").groupBy(F.floor(e / 50).alias("g")).agg(F.array_join(F.collect_list(item), ",").alias("i"))
    whole = F.when(F.col("g") % 2 == 0, F.concat(F.lit('{"results": ['), F.col("i"), F.lit("]}"))).otherwise(F.concat(F.lit("["), F.col("i"), F.lit("]")))
    return readers.tolerant_findings(listed.select(whole.alias("json")))
