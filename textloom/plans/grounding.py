"""Grounding, rule groups, layouts and predicates over tables that the given ones stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions import text as fx
from ..operators import asof, grounding, outline, resolve
from .files import over
from .registry import query


def _joined(df):
    """Lists as text, so that both sides compare alike."""
    return df.select(*(F.array_join(n, ",").alias(n) if k.startswith("array") else n for n, k in df.dtypes))


_FOUND = r"""+b AS (SELECT DISTINCT string_split(path, '/')[-1] AS f FROM files),
p AS (SELECT id, 'path' AS kind, unnest([regexp_extract(text, '`(src/[^`]+)`', 1), regexp_extract(text, '(lib/f[0-9]+[.]go)', 1)]) AS ref FROM claims),
s AS (SELECT id, regexp_extract(text, '`(ring::s[0-9]+)`', 1) AS s, regexp_extract(text, ' (ring::s[0-9]+)[(]', 1) AS c FROM claims),
r AS (SELECT id, kind, ref, string_split(ref, '/')[-1] IN (SELECT f FROM b) AS verified FROM p
UNION ALL SELECT id, 'symbol', s, s[7:] IN (SELECT name FROM names) FROM s
UNION ALL SELECT id, 'call', c, c[7:] IN (SELECT name FROM names) FROM s WHERE c <> s AND 'ring' IN (SELECT name FROM names))
"""


@over(_FOUND + "SELECT id, kind, ref, verified FROM r", "claims", "files", "names")
def grounded_references(t):
    """SF-20, JN-12: what texts name, and whether the corpus holds it."""
    return grounding.grounded_references(grounding.references(t("claims")), t("files"), t("names"))


@over(_FOUND + """
SELECT id, '' AS external, 1 AS unchecked, coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE verified AND kind = 'path'), '') AS verified_paths, coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE NOT verified AND kind = 'path'), '') AS unverified_paths,
coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE verified AND kind <> 'path'), '') AS verified_symbols, coalesce(string_agg(DISTINCT ref, ',' ORDER BY ref) FILTER (WHERE NOT verified AND kind <> 'path'), '') AS unverified_symbols FROM r GROUP BY id
""", "claims", "files", "names")  # fmt: skip
def grounding_report(t):
    """PL-11, SO-8: per text, verified and unverified references."""
    return _joined(grounding.grounding(t("claims"), t("files"), t("names")))


@over("""+r AS (SELECT *, coalesce(category, string_split(rule_id, '-')[1]) AS c FROM rule_rows),
s AS (SELECT rule_set, count(*) AS n, count(DISTINCT c) AS k FROM r GROUP BY 1)
SELECT rule_set, rule_id, CASE WHEN n <= 8 OR k < 2 THEN '' ELSE c END AS part FROM r JOIN s USING (rule_set)
""", "rule_rows")  # fmt: skip
def rule_groups(t):
    """EX-16: the parts in which the rules of a set are asked."""
    return outline.rule_groups(t("rule_rows"))


@over("""
SELECT diagram, id, 40 + 240 * CASE kind WHEN 'component' THEN 1 WHEN 'endpoint' THEN 2 WHEN 'datastore' THEN 3 WHEN 'external' THEN 4 ELSE 0 END AS x,
40 + 90 * (row_number() OVER (PARTITION BY diagram, kind ORDER BY ord) - 1) AS y FROM nodes
""", "nodes")  # fmt: skip
def column_layout(t):
    """RK-12: places of diagram nodes."""
    return outline.column_layout(t("nodes"))


@over("""+f AS (SELECT string_split(path, '/') AS a FROM files ORDER BY path LIMIT 400),
e AS (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM f),
s AS (SELECT DISTINCT array_to_string(a[:i - 1], '/') AS dir, a[i] AS name, i = len(a) AS leaf FROM e)
SELECT dir, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT leaf), '') AS dirs, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE leaf), '') AS files FROM s GROUP BY dir
""", "files")  # fmt: skip
def tree_outline(t):
    """EX-15: directories with what they hold."""
    return outline.tree_outline(t("files"))


@over("SELECT repo, arg_max(path, n * 100000000 - ord) AS path, max(n) AS n FROM dbs WHERE n IS NOT NULL GROUP BY repo", "dbs")
def largest_compile_db(t):
    """AG-23: the compile database of each repository."""
    return outline.largest_compile_db(t("dbs"))


_ALLOWED = ("therin.example.net", "therha.example.com")


@query(f"""
SELECT page_id, CASE WHEN NOT starts_with(lower(url), 'https:') THEN 'plaintext' WHEN lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) IN {_ALLOWED} THEN 'ok' ELSE 'host' END AS verdict FROM pages
""")
def endpoint_policy(t):
    """FL-22: endpoints under a network policy."""
    u = F.col("url")
    return t("pages").select("page_id", outline.endpoint_policy(u, fx.host_of(u), True, _ALLOWED).alias("verdict"))


@over("SELECT path, regexp_matches(lower(path), '([.]designer|[.]g|[.]g[.]i|[.]generated|assemblyinfo)[.]cs$') AS generated FROM sources", "sources")
def generated_csharp(t):
    """FL-14: generated C# files."""
    return t("sources").select("path", px.is_generated_csharp(F.col("path")).alias("generated"))


@over("SELECT id, name, name IN ('stdio.h', 'sys/time.h', 'vector') AS system FROM included", "included")
def system_headers(t):
    """FL-15: headers of the standard libraries."""
    return t("included").select("id", "name", px.is_system_header(F.col("name")).alias("system"))


_MODULES = r"""+modules AS (SELECT path, ord, CASE WHEN ends_with(path, '.rs') THEN CASE WHEN starts_with(path, 'src/') THEN 'crate' ELSE split_part(path, '/', 1) END || '::' || replace(regexp_replace(regexp_replace(path, '^.*src/', ''), '(/mod)?[.]rs$', ''), '/', '::') END AS module FROM crates)
"""


@over(_MODULES + "SELECT path, module FROM modules", "crates")
def rust_modules(t):
    """SF-4: modules of Rust files."""
    return t("crates").select("path", px.rust_module_name(F.col("path")).alias("module"))


def _uses(t):
    """Each file names a module of its crate, or one of another."""
    k = F.col("ord")
    named = F.concat(F.lit("crate::m"), k % 50, F.lit("::f"), k + F.when(k % 3 == 0, 60).otherwise(0), F.lit("::Thing"))
    return t("crates").select("path", F.when(k % 7 == 0, "std::fmt").when(k % 7 == 1, F.concat(F.lit("crate::f"), k + 12, F.lit("::x"))).otherwise(named).alias("import"))


@over(_MODULES.rstrip() + """,
u AS (SELECT path, CASE WHEN starts_with(path, 'src/') THEN 'crate' ELSE split_part(path, '/', 1) END AS c, CASE WHEN ord % 7 = 0 THEN 'std::fmt' WHEN ord % 7 = 1 THEN 'crate::f' || (ord + 12) || '::x' ELSE 'crate::m' || (ord % 50) || '::f' || (ord + CASE WHEN ord % 3 = 0 THEN 60 ELSE 0 END) || '::Thing' END AS import FROM crates),
i AS (SELECT module, arg_max(path, ord) AS target FROM modules WHERE module IS NOT NULL GROUP BY module),
w AS (SELECT path, import, string_split(c || import[6:], '::') AS a FROM u WHERE starts_with(import, 'crate') AND ends_with(path, '.rs')),
e AS (SELECT path, import, a, unnest(range(1, len(a) + 1)) AS n FROM w)
SELECT path, import, arg_max(target, n) AS target FROM e JOIN i ON module = array_to_string(a[:n], '::') GROUP BY path, import
""", "crates")  # fmt: skip
def rust_import_resolution(t):
    """JN-2: files that Rust imports name."""
    return resolve.rust_imports(_uses(t), t("crates"))


@query("""
WITH l AS (SELECT o_orderkey AS id, o_custkey % 100 AS file, (epoch(o_orderdate) // 86400)::BIGINT AS line FROM orders),
s AS (SELECT DISTINCT l_suppkey % 100 AS file, (epoch(l_shipdate) // 86400)::BIGINT AS start, (epoch(l_shipdate) // 86400)::BIGINT + 10 * l_linenumber AS "end" FROM lineitem)
SELECT id, coalesce(max(start) FILTER (WHERE line BETWEEN start AND "end"), max(start) FILTER (WHERE start <= line)) AS start FROM l LEFT JOIN s USING (file) GROUP BY id
""")
def enclosing_definition(t):
    """JN-6: the shipping span around an order's day, else the nearest before it."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    lines = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("file"), day("o_orderdate").alias("line"))
    spans = t("lineitem").select((F.col("l_suppkey") % 100).alias("file"), day("l_shipdate").alias("start"), (day("l_shipdate") + 10 * F.col("l_linenumber")).alias("end")).distinct()
    return asof.enclosing_or_preceding(lines, spans, "file", "line", "id", 100)


@over(r"""
SELECT id, coalesce(nullif(trim(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'component') AS safe, regexp_replace(name, '([\\*`|_])', '\\\1', 'g') AS escaped, '``' || replace(name, '`', '''') || '``' AS literal FROM headings
""", "headings")  # fmt: skip
def report_names(t):
    """SF-25, SF-26: names made safe for files and for reStructuredText."""
    n = F.col("name")
    return t("headings").select("id", px.safe_name(n).alias("safe"), fx.rst_escaped(n).alias("escaped"), fx.rst_literal(n).alias("literal"))
