"""Tables of the file model that the given tables stand for, each by one SQL text that Spark and the oracle both run.

Parts are files, suppliers and lines are symbols and calls, orders are changes
and edges; so every query over them grows with the given data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators import caps


def path(k: str) -> str:
    """The file that a key stands for."""
    return f"(CASE {k} % 5 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/db/' WHEN 2 THEN 'lib/' WHEN 3 THEN 'vendor/x/' ELSE 'tests/' END || 'f' || {k} || CASE {k} % 4 WHEN 0 THEN '.cpp' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.md' END)"


_TYPE = "'pkg' || (p_size % 7) || CASE p_partkey % 2 WHEN 0 THEN '.' ELSE '::' END || replace(p_name, ' ', '_')"
_PLACE = "CAST(l_orderkey * 8 + l_linenumber AS INT)"

SQL = {
    "files": f"SELECT {path('p_partkey')} AS path, CASE p_partkey % 4 WHEN 0 THEN 'C++' WHEN 1 THEN 'Python' WHEN 2 THEN 'Go' ELSE 'Markdown' END AS language, p_size AS n_symbols FROM {{part}}",
    "symbols": f"SELECT {path('l_partkey')} AS path, CASE WHEN l_suppkey % 9 = 0 THEN 'main' ELSE 's' || l_suppkey END AS name, CASE l_linenumber WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'class' ELSE 'constant' END AS kind, "
    f"{_PLACE} AS lineno, CASE l_returnflag WHEN 'N' THEN '' ELSE 's' || l_suppkey || '(q' || l_linenumber || ')' END AS signature, CASE l_linestatus WHEN 'O' THEN '' ELSE 'Ships ' || l_suppkey || '.' END AS doc FROM {{lineitem}}",
    "calls": f"SELECT {path('l_partkey')} AS src_file, {path('l_suppkey')} AS dst_file, 's' || (l_orderkey % 50) AS caller, 'c' || l_linenumber AS callee, CAST(l_orderkey % 40 AS INT) AS line FROM {{lineitem}}",
    "types": f"SELECT {_TYPE} AS qualified_name, CASE p_size % 2 WHEN 0 THEN 'class' ELSE 'struct' END AS kind, {path('p_partkey')} AS file, CASE p_size % 4 WHEN 0 THEN '' ELSE 'pkg' || (p_size % 7) || '::' || p_type END AS bases FROM {{part}}",
    "sites": f"SELECT {path('p_partkey')} AS file, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE replace(p_name, ' ', '_') END AS name FROM {{part}}",
    "summaries": f"SELECT {path('p_partkey')} AS path, CASE WHEN p_size % 3 = 0 THEN 'File (' || p_size || ' bytes).' ELSE 'Keeps ' || p_name || '.' END AS purpose, CASE p_partkey % 2 WHEN 0 THEN 'model' ELSE 'heuristic' END AS source FROM {{part}}",
    "io_edges": "SELECT 'c' || (o_custkey % 20) AS src, CASE o_orderkey % 3 WHEN 0 THEN 'redis' WHEN 1 THEN 'kafka' ELSE 'db' END AS dst, CASE o_orderkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'http' WHEN 2 THEN 'datastore' WHEN 3 THEN 'messaging' ELSE 'socket' END AS kind, o_orderpriority AS detail FROM {orders}",
    "functions": "SELECT 'm' || (p_partkey % 500) || '::f' AS qualified_name, 'r' || p_partkey || '.rs' AS file, CAST(p_partkey AS INT) AS ord FROM {part}",
    "report": "SELECT 'm' || (l_partkey % 700) || '::f' AS caller_qualified, 'm' || (l_suppkey % 700) || '::g' AS callee_qualified, CASE l_linenumber WHEN 1 THEN 'x' || l_suppkey || '.rs' ELSE '' END AS file, CASE l_linenumber WHEN 2 THEN '' ELSE 'y' || l_suppkey || '.rs' END AS callee_file, l_linenumber AS line FROM {lineitem}",
    "items": f"SELECT 'R' || (l_suppkey % 12) AS rule_id, {path('l_partkey')} AS file, {_PLACE} AS line, CASE l_linenumber WHEN 1 THEN 'low' WHEN 3 THEN 'info' WHEN 4 THEN 'critical' END AS severity, CASE l_returnflag WHEN 'N' THEN NULL ELSE 'style' END AS category FROM {{lineitem}}",
    "rules": "SELECT 'R' || n_nationkey AS rule_id, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN NULL ELSE 'medium' END AS severity, CASE n_nationkey % 2 WHEN 0 THEN 'region' || n_regionkey END AS category FROM {nation}",
    "listing": f"SELECT CASE o_orderkey % 7 WHEN 0 THEN 'M' || chr(9) || {path('o_orderkey')} WHEN 1 THEN 'R087' || chr(9) || 'old' || o_orderkey || '.py' || chr(9) || {path('o_orderkey')} WHEN 2 THEN 'C100' || chr(9) || 'src/a.py' || chr(9) || {path('o_orderkey')} "
    f"WHEN 3 THEN 'D' || chr(9) || {path('o_orderkey')} WHEN 4 THEN 'A' || chr(9) || '.git/hooks/x' || o_orderkey WHEN 5 THEN 'T' || chr(9) || 'build/out' || o_orderkey || '.o' ELSE 'A' || chr(9) || 'logo' || o_orderkey || '.png' END AS l FROM {{orders}}",
    "owned": f"SELECT 'c' || (o_custkey % 4000) AS component, {path('o_orderkey')} AS path FROM {{orders}}",
    "imports": "SELECT 'tests/test_' || (o_orderkey % 5000) || '.py' AS path, 'src.pkg.f' || (o_custkey % 400) AS module FROM {orders}",
    "edges": f"SELECT {path('l_partkey')} AS src, {path('l_suppkey')} AS dst FROM {{lineitem}}",
    "headers": "SELECT 'lib/h' || p_partkey || '.h' AS path FROM {part} WHERE p_partkey % 3 = 0",
    "includes": f"SELECT 'lib/h' || l_partkey || '.c' AS path, {_PLACE} AS pos, 'h' || l_suppkey || '.h' AS include FROM {{lineitem}}",
    "diags": f"SELECT 'h' || (l_suppkey % 30) || '.h' AS header, {_PLACE} AS ord FROM {{lineitem}}",
    "cache": "SELECT 'k' || event_id AS key, CASE event_type WHEN 'view' THEN '{{\"purpose\": \"p' || event_id || 'é\"}}' WHEN 'click' THEN '{{\"doc\": \"d\"}}' WHEN 'error' THEN 'broken' ELSE props END AS value, CAST(user_id % 90 AS INT) AS age_days FROM {events}",
    "tests": "SELECT 't' || doc_id || '.py' AS path, replace(replace(text, '. ', chr(10) || 'assert '), ', ', ' \"assert ') || '\"' AS text FROM {documents}",
    "diffs": "SELECT 'd' || doc_id AS path, CAST(doc_id AS INT) AS ord, n_chars AS tokens FROM {documents}",
    # grounding, layouts and reports
    "claims": "SELECT o_orderkey AS id, 'See `src/db/f' || (o_custkey % 300) || '.py` and lib/f' || (o_custkey % 90) || '.go, or www.site.com; `ring::s' || (o_orderkey % 60) || '` `x.y`. ring::s' || (o_custkey % 60) || '(1); none::go(2); p->close();' AS text FROM {orders}",
    "names": "SELECT DISTINCT 's' || s_suppkey AS name FROM {supplier} UNION SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM {part}",
    "rule_rows": "SELECT p_brand AS rule_set, upper(substr(p_type, 1, 1)) || '-' || p_partkey AS rule_id, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_type END AS category FROM {part}",
    "nodes": "SELECT 'd' || o_custkey AS diagram, 'n' || o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'env' WHEN 1 THEN 'component' WHEN 2 THEN 'endpoint' WHEN 3 THEN 'datastore' WHEN 4 THEN 'external' ELSE 'odd' END AS kind, CAST(o_orderkey AS INT) AS ord FROM {orders}",
    "dbs": "SELECT 'r' || s_nationkey AS repo, 'build/' || s_suppkey || '.json' AS path, CAST(s_suppkey AS INT) AS ord, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 7 AS INT) END AS n FROM {supplier}",
    "headings": "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '--' ELSE p_brand || '/' || p_name || CASE p_size % 3 WHEN 0 THEN '_*|`' ELSE '.v2' END END AS name FROM {part}",
    "crates": "SELECT CASE p_partkey % 3 WHEN 0 THEN 'crate' || (p_partkey % 20) || '/src/' ELSE 'src/' END || CASE p_partkey % 4 WHEN 0 THEN 'm' || (p_partkey % 50) || '/mod.rs' WHEN 1 THEN 'm' || (p_partkey % 50) || '/f' || p_partkey || '.rs' WHEN 2 THEN 'f' || p_partkey || '.rs' ELSE 'f' || p_partkey || '.txt' END AS path, CAST(p_partkey AS INT) AS ord FROM {part}",
    "sources": "SELECT CASE p_partkey % 6 WHEN 0 THEN 'a/F' || p_partkey || '.Designer.cs' WHEN 1 THEN 'x' || p_partkey || '.g.i.cs' WHEN 2 THEN 'p' || p_partkey || '/AssemblyInfo.cs' WHEN 3 THEN 'y' || p_partkey || '.generated.CS' WHEN 4 THEN 'g' || p_partkey || '.cs' ELSE 'F' || p_partkey || '.cs' END AS path FROM {part}",
    "included": "SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN 'stdio.h' WHEN 2 THEN 'sys/time.h' WHEN 3 THEN 'vector' WHEN 4 THEN 'g' || l_suppkey || '/g.h' WHEN 5 THEN 'bits/move' ELSE 'io' || l_suppkey || '.h' END AS name FROM {lineitem}",
    # checks of generated tests
    "test_calls": "SELECT 't' || (l_orderkey % 2000) AS test, 'f' || (l_partkey % 40) AS name, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END AS n_args FROM {lineitem}",
    "origins": "SELECT 't' || (l_orderkey % 2000) AS test, 'f' || (l_partkey % 40) AS name, CASE l_suppkey % 4 WHEN 0 THEN 'json' ELSE 'app.m' || (l_suppkey % 4) END AS module, CAST(l_orderkey * 800 + l_suppkey % 100 * 8 + l_linenumber AS BIGINT) AS lineno FROM {lineitem}",
    "modules": "SELECT 'app.m' || (s_suppkey % 4) AS module FROM {supplier}",
    "signatures": "SELECT 'app.m' || (p_size % 4) AS module, 'f' || (p_partkey % 55) AS name, CAST(p_partkey AS INT) AS lineno, CAST(p_partkey % 2 AS INT) AS required, CAST(p_partkey % 2 + p_size % 3 AS INT) AS total, p_size % 10 = 0 AS flexible FROM {part}",
    "objects": "SELECT 'o' || o_orderkey || '.o' AS path, '0000 T main' || chr(10) || '0010 t f' || o_custkey || chr(10) || '     U printf' || chr(10) || chr(10) || 'W' || chr(10) || '0030 ' || CASE o_orderkey % 2 WHEN 0 THEN 'W' ELSE 'D' END || ' g' || o_orderkey AS text FROM {orders}",
    # source files
    "python_files": "SELECT 'src/p' || p_partkey || '.py' AS path, 'import os, a.b' || p_size || chr(10) || 'from ' || CASE p_size % 3 WHEN 0 THEN '..db' WHEN 1 THEN 'x.y' ELSE '.' END || ' import s' || chr(10) || chr(10) || 'LIMIT' || p_partkey || ' = ' || p_size || chr(10) || 'class C' || p_partkey || '(Base, m.M' || p_size || '):' || chr(10) "
    "|| '    \"\"\"Keeps ' || p_name || '.\"\"\"' || chr(10) || '    def get(self, n=1):' || chr(10) || '        return n' || chr(10) || chr(10) || 'def f' || p_partkey || '(a, b):' || chr(10) || '    if a == ' || p_size || ':' || chr(10) || '        return True' || chr(10) || CASE WHEN p_size = 13 THEN 'broken(' || chr(10) ELSE '' END AS text FROM {part}",
    "rust_files": "SELECT 'src/r' || p_partkey || '.rs' AS path, 'use crate::api::{{app' || p_size || ', other::{{X, Y}}}};' || chr(10) || CASE p_size % 2 WHEN 0 THEN 'mod inner' || p_size || ';' ELSE 'use std::fmt;' END || chr(10) AS text FROM {part}",
    "code_files": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'a' || p_partkey || '.rs' WHEN 1 THEN 'a' || p_partkey || '.ts' WHEN 2 THEN 'a' || p_partkey || '.c' ELSE 'a' || p_partkey || '.go' END AS path, "
    "CASE p_partkey % 4 WHEN 0 THEN 'pub fn open' || p_size || '(path: &str) -> Store {{' || chr(10) || '}}' || chr(10) || 'struct S' || p_size || ' {{' WHEN 1 THEN 'export function open' || p_size || '(a) {{' || chr(10) || '}}' || chr(10) || 'export class S' || p_size || ' {{' "
    "WHEN 2 THEN 'int open' || p_size || '(int a, int b) {{' || chr(10) || '}}' || chr(10) || 'struct S' || p_size || ' {{' ELSE 'func open' || p_size || '(a int) {{' || chr(10) || '}}' || chr(10) || 'type S' || p_size || ' struct {{' END || chr(10) || '}}' || chr(10) AS text, p_partkey, p_size FROM {part}",
    "signal_files": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'api/a' || p_partkey || '.py' WHEN 1 THEN 'n' || p_partkey || '.c' WHEN 2 THEN 'b' || p_partkey || '.go' ELSE 'e' || p_partkey || '.py' END AS path, CASE p_partkey % 4 WHEN 0 THEN '@app.get(\"/a' || p_size || '\")' || chr(10) || 'os.getenv(\"K' || p_size || '\")' || chr(10) || 'requests.get(\"https://h' || p_size || ':9000/x\")' || chr(10) || 'import psycopg2' || chr(10) "
    "WHEN 1 THEN 'socket(AF_INET, SOCK_DGRAM, 0);' || chr(10) WHEN 2 THEN 'import \"github.com/segmentio/kafka\"' || chr(10) || 'http.Get(\"http://b' || p_size || '.internal/x\")' || chr(10) ELSE '' END AS text, p_partkey % 4 AS k, p_size FROM {part}",
    "repo_files": "SELECT 'r' || (p_partkey % 300) AS repo, CASE p_size % 10 WHEN 0 THEN 'CMakeLists.txt' WHEN 1 THEN 'a/conftest.py' WHEN 2 THEN 'requirements-dev.txt' WHEN 3 THEN 'Cargo.toml' WHEN 4 THEN 'n' || p_partkey || '/app.csproj' WHEN 5 THEN 'tests/test_' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.c' ELSE '.cpp' END WHEN 6 THEN 'Unity/src/unity.h' WHEN 7 THEN 'third/GoogleTest/README' WHEN 8 THEN 'build/gtest/x.cc' ELSE 'src/main.cpp' END AS path, "
    "CASE p_size % 10 WHEN 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'find_package(GTest)' ELSE 'project(x)' END WHEN 2 THEN CASE p_partkey % 2 WHEN 0 THEN 'pytest==7' ELSE 'pytests==7' END WHEN 4 THEN '<PackageReference Include=\"' || CASE p_partkey % 4 WHEN 0 THEN 'xunit.runner' WHEN 1 THEN 'NUnit' WHEN 2 THEN 'MSTest.Sdk' ELSE 'Moq' END || '\" />' "
    "WHEN 5 THEN '#include <cassert>' || chr(10) || 'int main() {{' || CASE p_partkey % 5 WHEN 0 THEN '// doctest' ELSE '' END END AS text FROM {part}",
}
#: Tables of whole files that the rows of parts are rendered to.
TEXTS = ("python_files", "rust_files", "code_files", "signal_files", "repo_files")
_GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derived(t, name: str) -> DataFrame:
    """A table of this module; ``t`` reads a given table by its name."""
    given = {g: t(g) for g in _GIVEN if re.search(rf"(?<!\{{)\{{{g}\}}", SQL[name])}
    if name in TEXTS:  # the work on a text is in no proportion to the few bytes of its row
        given["part"] = given["part"].repartition(caps.tasks(given["part"], 2_000), "p_partkey")
    return next(iter(given.values())).sparkSession.sql(SQL[name], **given)


def with_derived(*names: str) -> str:
    """The beginning of an oracle's SQL: the tables of this module that it names."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n].format(**{g: g for g in _GIVEN})})" for n in names)


def reading(t):
    """``t`` that also reads this module's tables."""
    return lambda name: derived(t, name) if name in SQL else t(name)
