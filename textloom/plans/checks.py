"""Test verification and static analysis end to end, over tables that the given ones stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, frameworks, testing
from .derived import path
from .files import over

_TESTS = """tests AS (SELECT p_partkey AS test, p_size % 9 <> 0 AS compiled, p_size % 7 <> 0 AS ran, p_size % 5 <> 0 AS passed,
CASE p_partkey % 4 WHEN 0 THEN 'error: x' WHEN 1 THEN 'a.c:1: fatal error: lib/h' || (p_size % 30) || '.h: No such file' WHEN 2 THEN 'b.c: ''gtest/gtest.h'' file not found' ELSE '''none' || p_size || '.h'' file not found' END AS log FROM part)"""
_OUTCOME = "CASE (test + ord) % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN CASE WHEN test % 3 = 0 THEN 'survived' ELSE 'killed' END ELSE 'survived' END"


@over(f"""
WITH RECURSIVE {_TESTS},
e AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = 3 * a.p_partkey + 1),
r AS (SELECT test, test AS path FROM tests WHERE compiled AND ran AND passed AND test % 6 <> 0 UNION SELECT r.test, dst FROM r JOIN e ON e.src = r.path),
m AS (SELECT DISTINCT l_partkey AS path, l_orderkey * 8 + l_linenumber AS ord FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY path) AS size FROM m),
f AS (SELECT path, ord FROM n WHERE size <= 10 OR i IN (SELECT (k * size) // 10 FROM range(10) t(k))),
c AS (SELECT r.test, r.path, ord, row_number() OVER (PARTITION BY r.test ORDER BY r.path, ord) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY r.test) // 10) AS step FROM r JOIN f USING (path)),
o AS (SELECT test, {_OUTCOME} AS outcome FROM c WHERE i % step = 0 AND i // step < 10),
y AS (SELECT test, count(*) FILTER (WHERE outcome <> 'invalid') AS total, count(*) FILTER (WHERE outcome = 'killed') AS killed, count(*) FILTER (WHERE outcome = 'invalid') AS invalid FROM o GROUP BY test),
w AS (SELECT *, CASE WHEN compiled THEN '' WHEN test % 4 = 0 THEN 'repairable' WHEN test % 4 = 2 THEN 'missing-framework' WHEN test % 4 = 1 AND regexp_extract(log, '/(h[0-9]+.h)', 1) IN (SELECT 'h' || l_suppkey || '.h' FROM lineitem) THEN 'environment' ELSE 'fabricated-include' END AS cause FROM tests)
SELECT test, CASE WHEN cause = 'missing-framework' THEN 'unverifiable' WHEN cause = 'environment' THEN 'environment' WHEN NOT compiled THEN 'uncompilable' WHEN NOT ran THEN 'unrunnable' WHEN NOT passed THEN 'wrong' WHEN coalesce(total, 0) = 0 THEN 'unverifiable' WHEN killed > 0 THEN 'useful' ELSE 'vacuous' END AS verdict,
cause, coalesce(total, 0) AS total, coalesce(killed, 0) AS killed, coalesce(invalid, 0) AS invalid, CASE WHEN total > 0 THEN round(killed / total, 3) END AS score FROM w LEFT JOIN y USING (test)
""")  # fmt: skip
def verified_tests(t):
    """PL-7, SF-31, GR-3, RK-9, RK-10, AG-15: verdicts of tests that stand for parts, over the files that they reach and their mutants."""
    p = t("part")
    size, k = F.col("p_size"), F.col("p_partkey")
    log = (
        F.when(k % 4 == 0, "error: x")
        .when(k % 4 == 1, F.concat(F.lit("a.c:1: fatal error: lib/h"), size % 30, F.lit(".h: No such file")))
        .when(k % 4 == 2, "b.c: 'gtest/gtest.h' file not found")
        .otherwise(F.concat(F.lit("'none"), size, F.lit(".h' file not found")))
    )
    tests = p.select(k.alias("test"), (size % 9 != 0).alias("compiled"), (size % 7 != 0).alias("ran"), (size % 5 != 0).alias("passed"), log.alias("log"), F.lit('#include <gtest/gtest.h>\n#include "x.h"').alias("text"))
    seeds = p.where(k % 6 != 0).select(k.alias("test"), k.alias("path"))
    edges = p.select(k.alias("src"), (3 * k + 1).alias("dst")).join(p.select(k.alias("dst")), "dst", "left_semi")
    wanted = t("includes").select(F.col("include").alias("header"))
    mutants = t("lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")).distinct()
    return testing.verify(tests, seeds, edges, wanted, mutants, F.expr(_OUTCOME))


#: A function around each hundred lines of a file, with one inside that covers its second half.
_FUNCTIONS = f"""functions AS (SELECT DISTINCT {path('l_partkey')} AS file, l_orderkey // 100 * 100 + 50 * h AS start, l_orderkey // 100 * 100 + 99 AS "end", CASE h WHEN 0 THEN 'outer' ELSE 'inner' END || (l_orderkey // 100) AS name FROM lineitem, (SELECT unnest([0, 1]) AS h) WHERE l_linenumber % 2 = 1)"""
_FINDINGS = f"""findings AS (SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS id, {path('l_partkey')} AS file, l_orderkey AS line, CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'low' ELSE 'info' END AS severity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_linenumber ORDER BY l_suppkey) = 1)"""
_COMPONENT = "CASE WHEN starts_with(file, 'src/') THEN split_part(file, '/', 2) WHEN starts_with(file, 'vendor/') THEN 'vendor/x' ELSE split_part(file, '/', 1) END"


def _findings(t):
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    file = F.expr(path("l_partkey"))
    severity = F.when(n == 1, "critical").when(n == 2, "high").when(n == 3, "low").otherwise("info")
    findings = t("lineitem").select((o * 100_000_000 + k * 10 + n).alias("id"), file.alias("file"), o.alias("line"), severity.alias("severity")).distinct()
    base = F.floor(o / 100) * 100
    each = F.explode(F.array(F.struct(base.alias("start"), F.concat(F.lit("outer"), F.floor(o / 100)).alias("name")), F.struct((base + 50).alias("start"), F.concat(F.lit("inner"), F.floor(o / 100)).alias("name"))))
    functions = t("lineitem").where(n % 2 == 1).select(file.alias("file"), (base + 99).alias("end"), each.alias("f")).select("file", "f.start", "end", "f.name").distinct()
    return findings, functions


@over(f"""+{_FINDINGS}, {_FUNCTIONS},
a AS (SELECT f.*, coalesce((SELECT arg_max(name, start) FROM functions g WHERE g.file = f.file AND f.line BETWEEN g.start AND g."end"), '') AS function, {_COMPONENT} AS component FROM findings f),
p AS (SELECT path AS file, purpose FROM summaries WHERE NOT ends_with(purpose, ' bytes).')),
r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), starts_with(file, 'vendor/'), file, line, id) AS place FROM a)
SELECT id, r.file, line, severity, function, component, coalesce(purpose, '') AS file_purpose, place <= 25 AS triaged FROM r LEFT JOIN p ON p.file = r.file
""", "summaries")  # fmt: skip
def static_analysis(t):
    """PL-4, JN-5, JN-7, RK-3: findings with their innermost function, component and file purpose, and which are looked at first."""
    findings, functions = _findings(t)
    return analysis.analyse(findings, functions, t("summaries"), 25)


@over(f"""+{_FINDINGS},
u AS (SELECT path AS file, CASE WHEN n_symbols % 10 = 0 THEN 'error: no' ELSE '' END AS error FROM files),
r AS (SELECT *, {_COMPONENT} AS component FROM u),
s AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY starts_with(file, 'vendor/'), file) AS rn FROM r),
c AS (SELECT component, CASE WHEN rn > 30 THEN 'skipped' WHEN error <> '' THEN 'failed' ELSE 'succeeded' END AS state, file IN (SELECT file FROM findings) AS hit FROM s),
g AS (SELECT component, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, 0 AS partial, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE hit AND state <> 'skipped') AS with_findings FROM c GROUP BY component)
SELECT component, succeeded, partial, failed, skipped, succeeded + partial + failed AS attempted, succeeded + partial + failed + skipped AS eligible, partial = 0 AND failed = 0 AND skipped = 0 AS complete, with_findings FROM g
""", "files")  # fmt: skip
def analysis_coverage(t):
    """PL-4, AG-7, ST-5: accounts of the analysed files by component, under a cap."""
    units = t("files").select(F.col("path").alias("file"), F.when(F.col("n_symbols") % 10 == 0, "error: no").otherwise("").alias("error"))
    return analysis.unit_coverage(units, _findings(t)[0], 30)


DEFAULTS = {"C": "Unity", "C++": "GoogleTest", "Python": "pytest", "Rust": "cargo test", "C#": "xUnit", "Go": "go test"}


@over(r"""
, f AS (SELECT repo, path, coalesce(text, '') AS text FROM repo_files),
p AS (SELECT repo, path, text, path SIMILAR TO '(.*/)?[Tt]est_[^/]*[.](c|cpp)' AND contains(text, '#include <cassert>') AND contains(text, 'int main(') AND NOT contains(text, 'doctest') AS plain FROM f),
c AS (SELECT repo, CASE lower(regexp_extract(text, 'Include="([A-Za-z]+)', 1)) WHEN 'xunit' THEN 'xUnit' WHEN 'nunit' THEN 'NUnit' WHEN 'mstest' THEN 'MSTest' END AS package, path FROM f WHERE ends_with(path, '.csproj')),
k AS (SELECT repo, arg_min(package, path) AS cs FROM c WHERE package IS NOT NULL GROUP BY repo),
e AS (SELECT repo, bool_or(path LIKE '%/unity.h') AS unity, bool_or(plain AND ends_with(path, '.c')) AS pc, bool_or(plain) AS pcpp, bool_or(path LIKE '%/GoogleTest/%' OR path = 'CMakeLists.txt' AND contains(text, 'GTest')) AS gtest,
  bool_or(path LIKE '%conftest.py' OR starts_with(path, 'requirements') AND regexp_matches(text, 'pytest([^s]|$)')) AS py, bool_or(path = 'Cargo.toml') AS rs FROM p GROUP BY repo),
r AS (SELECT repo, unnest(['C', 'C++', 'Python', 'Rust', 'C#', 'Go']) AS language, unnest(['Unity', 'GoogleTest', 'pytest', 'cargo test', 'xUnit', 'go test']) AS d,
  unnest([CASE WHEN unity THEN 'Unity' WHEN pc THEN 'plain assert()/main()' END, CASE WHEN gtest THEN 'GoogleTest' WHEN pcpp THEN 'plain assert()/main()' END, CASE WHEN py THEN 'pytest' END, CASE WHEN rs THEN 'cargo test' END, cs, NULL]) AS f FROM e LEFT JOIN k USING (repo))
SELECT repo, language, coalesce(f, d) AS framework, f IS NOT NULL AS detected FROM r
""", "repo_files")  # fmt: skip
def framework_detection(t):
    """EX-14: each repository's test framework by language, seen or assumed."""
    return frameworks.frameworks(t("repo_files"), "repo", DEFAULTS)
