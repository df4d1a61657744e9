"""Operators over small literal tables, with the rows that they must give."""

import json

import pytest
from pyspark.sql import functions as F
from test_catalog import rows_of

from textloom.functions import comments
from textloom.functions import paths as px
from textloom.functions import signals as sg
from textloom.functions import text as fx
from textloom.operators import asof, extract, grounding, outline, resolve, verify
from textloom.sources import readers

CASES_BY_NAME = {}


def query(sql):
    """Keep a function of tables with the SQL of its expected rows."""

    def keep(fn):
        CASES_BY_NAME[fn.__name__] = (sql, fn)
        return fn

    return keep


#: A repository in miniature.
FILES = [
    ("src/api/app.py", 'import os\nfrom ..db import store as s\nimport a.b.c\n\nLIMIT = 3\n\n\nclass App(Base, mixin.M):\n    """The app."""\n\n    @property\n    def name(self):\n        return 1\n\n    @name.setter\n    def name(self, v):\n        pass\n\n\ndef main(argv):\n    if argv == 2 and LIMIT < 5:\n        return True\n    return len(argv) + 1\n'),
    ("src/db/store.rs", "use crate::api::{app, other::{X, Y}};\nmod inner;\npub fn open(path: &str) -> Store {\n}\nstruct Store {\n}\n"),
    ("src/web/page.ts", "export function render(a) {\n}\nexport class Page {\n}\nconst Size = 3;\n"),
    ("lib/x.c", "/* c */\n#include <stdio.h>\nint add(int a, int b) {\n  return a + b;\n}\nstruct point {\n};\n"),
    ("tests/test_app.py", "def test_main():\n    assert 1 == 1\n"),
    ("vendor/dep/z.go", "package z\nfunc Run(a int) {\n}\ntype T struct {\n}\n"),
    (".git/config", "x"),
    ("Makefile", "all:\n"),
    ("bad.py", "def broken(:\n"),
]


def _files(t):
    spark = t("region").sparkSession
    return spark.createDataFrame(FILES, "path string, text string").withColumn("ord", F.row_number().over(_by_path()))


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")


def _values(rows, cols):
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ") v(" + ", ".join(cols) + ")"


@query(_values([("src/api/app.py", "Python", "api", False), ("src/db/store.rs", "Rust", "db", False), ("src/web/page.ts", "TypeScript", "web", False), ("lib/x.c", "C", "lib", False), ("tests/test_app.py", "Python", "tests", True), ("vendor/dep/z.go", "Go", "vendor/dep", False), ("Makefile", "Build", "(root)", False), ("bad.py", "Python", "(root)", False)], ["path", "language", "component", "is_test"]))
def classify_paths(t):
    """Language, component and test predicate of files outside version control."""
    p = F.col("path")
    return _files(t).where(~px.is_vcs(p)).select("path", px.detect_language(p).alias("language"), px.component_for(p).alias("component"), px.is_test(p).alias("is_test"))


@query(_values([("src/db/store.rs", "open", "function", 3, "pub fn open(path: &str) -> Store {"), ("src/db/store.rs", "Store", "class", 5, "struct Store {"), ("src/web/page.ts", "render", "function", 1, "export function render(a) {"), ("src/web/page.ts", "Page", "class", 3, "export class Page {"), ("src/web/page.ts", "Size", "constant", 5, "const Size = 3;"), ("lib/x.c", "add", "function", 3, "int add(int a, int b) {"), ("lib/x.c", "point", "class", 6, "struct point {"), ("vendor/dep/z.go", "Run", "function", 2, "func Run(a int) {"), ("vendor/dep/z.go", "T", "class", 4, "type T struct {")], ["path", "name", "kind", "lineno", "signature"]))
def symbols_regex(t):
    """Symbols by line patterns of each language."""
    return extract.regex_symbols(_files(t).withColumn("language", px.detect_language(F.col("path"))))


@query(_values([("src/api/app.py", "main", "function", 20, "main(argv)", "", ""), ("src/api/app.py", "App", "class", 8, "App", "", "The app."), ("src/api/app.py", "name", "method", 12, "name(self)", "App", ""), ("src/api/app.py", "LIMIT", "constant", 5, "LIMIT", "", ""), ("tests/test_app.py", "test_main", "function", 1, "test_main()", "", "")], ["path", "name", "kind", "lineno", "signature", "parent", "doc"]))
def symbols_python_ast(t):
    """Symbols of Python files by their syntax trees."""
    return extract.python_symbols(_files(t).where("path like '%.py'"))


@query(_values([("src/api/app.py", "os", 0), ("src/api/app.py", "db", 2), ("src/api/app.py", "a.b.c", 0)], ["path", "module", "level"]))
def imports_python(t):
    """Imported modules of Python files."""
    return extract.python_imports(_files(t).where("path like '%.py'"))


@query(_values([("src/db/store.rs", "crate::api::app"), ("src/db/store.rs", "crate::api::other::X"), ("src/db/store.rs", "crate::api::other::Y"), ("src/db/store.rs", "self::inner")], ["path", "module"]))
def imports_rust(t):
    """Imported paths of Rust files."""
    return extract.rust_imports(_files(t).where("path like '%.rs'"))


@query(_values([("src/api/app.py", "App", 8, "Base,mixin.M")], ["path", "name", "lineno", "bases"]))
def types_python(t):
    """Classes of Python files with their bases."""
    return extract.python_types(_files(t).where("path like '%.py'"))


@query(_values([("src/api/app.py", 13, "return", "return 1", "return None"), ("src/api/app.py", 21, "eq", "if argv == 2 and LIMIT < 5:", "if argv != 2 and LIMIT < 5:"), ("src/api/app.py", 22, "true", "return True", "return False"), ("src/api/app.py", 23, "plus", "return len(argv) + 1", "return len(argv) - 1"), ("tests/test_app.py", 2, "eq", "assert 1 == 1", "assert 1 != 1")], ["path", "line", "operator", "before", "after"]))
def mutants(t):
    """One mutant a line of Python files."""
    return extract.mutants(_files(t).where("path like '%.py'"))


SARIF = json.dumps({"runs": [{"results": [
    {"ruleId": "boa", "level": "error", "message": {"text": "overflow"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "lib/x.c"}, "region": {"startLine": 4, "startColumn": 3}}}], "stacks": [{"frames": [{"location": {"message": {"text": "Call from main"}}}]}]},
    {"ruleId": "dbz", "level": "ok", "message": {"text": "safe"}, "locations": []},
    {"ruleId": "nul", "message": {"text": "null"}, "locations": []},
]}]})


@query(_values([("boa", "error", "lib/x.c", 4, 3, "overflow", "main"), ("nul", "warning", None, None, None, "null", "")], ["checker", "status", "file", "line", '"column"', "message", "called_from"]))
def sarif_source(t):
    """Findings of a SARIF text."""
    return readers.sarif_findings(t("region").sparkSession.createDataFrame([(SARIF,)], "json string"))


FINDINGS = json.dumps({"results": [{"check": "a", "result": "error", "path": "x.c", "lineno": 3, "msg": "m"}, {"id": "b", "status": "ok"}, {"rule": "c", "file": "y.c", "line": "7", "text": "t"}]})


@query(_values([("a", "error", "x.c", 3, "m"), ("c", None, "y.c", 7, "t")], ["checker", "status", "file", "line", "message"]))
def tolerant_findings(t):
    """Findings of loosely shaped JSON."""
    return readers.tolerant_findings(t("region").sparkSession.createDataFrame([(FINDINGS,)], "json string"))


TEXTS = [
    (1, "See `src/db/store.py` and lib/io.h, or www.site.com and notes.md; `Reader::read` with `Reader::fake`, `x.y` `io.Base::go` `main`."),
    (2, '#include <gtest/gtest.h>\n#include "Store.hpp"\nReader::read(1); Reader :: gone(2); Other::thing(3); p->close(); q.open();'),
    (3, ""),
    (4, None),
    (5, "./src/api/app.py ../x/app.py src/api/none.py a/b.xyz `Box` `unknown_name`"),
]
PATHS = [("src/db/store.py",), ("src/api/app.py",), ("lib/io.h",), ("lib/deep/io.h",)]
NAMES = [("Reader",), ("read",), ("main",), ("go",), ("Box",)]
RULES = [("small", f"S-{i}", "memory" if i % 2 else "style") for i in range(8)] + [("wide", f"W-{i}", ("memory", "style", None)[i % 3]) for i in range(9)] + [("flat", f"F-{i}", "only") for i in range(10)]
NODES = [("d1", "a", "component", 1), ("d1", "b", "component", 2), ("d1", "c", "external", 3), ("d1", "e", "odd", 4), ("d1", "f", "env", 5), ("d2", "a", "datastore", 1), ("d2", "b", "endpoint", 2)]
TREE = [("src/api/app.py",), ("src/api/v2/b.py",), ("src/db/store.py",), ("README",), ("lib/io.h",)]
DBS = [("r1", "build/a.json", 1, 3), ("r1", "out/b.json", 2, 7), ("r1", "z/c.json", 3, 7), ("r2", "bad.json", 1, None), ("r2", "one.json", 2, 0), ("r3", "none.json", 1, None)]
URLS = [("https://api.example.com/v1",), ("http://api.example.com/v1",), ("http://localhost:8000",), ("http://127.0.0.1/x",), ("https://other.example.com",), ("",), (None,)]
CSHARP = [("a/Form.Designer.cs", True), ("a/Form.cs", False), ("x.g.i.cs", True), ("Properties/AssemblyInfo.cs", True), ("y.generated.CS", True), ("g.cs", False)]
HEADERS = [("stdio.h", True), ("sys/time.h", True), ("vector", True), ("gtest/gtest.h", False), ("bits/move", False), ("io.h", False)]


def _rows(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


def _joined(df):
    """Lists as text, so that both sides compare alike."""
    return df.select(*(F.array_join(n, ",").alias(n) if k.startswith("array") else n for n, k in df.dtypes))


def _known(t):
    return _rows(t, PATHS, "path string"), _rows(t, NAMES, "name string")


@query(_values([
    (1, "path", "src/db/store.py", True), (1, "path", "lib/io.h", True), (1, "symbol", "Reader::read", True), (1, "symbol", "Reader::fake", False), (1, "symbol", "io.Base::go", True), (1, "symbol", "main", True),
    (2, "path", "Store.hpp", False), (2, "call", "Reader::read", True), (2, "call", "Reader::gone", False),
    (5, "path", "./src/api/app.py", True), (5, "path", "../x/app.py", True), (5, "path", "src/api/none.py", False), (5, "symbol", "Box", True), (5, "symbol", "unknown_name", False),
], ["id", "kind", "ref", "verified"]))
def grounded_references(t):
    """SF-20, JN-12: what texts name, and whether the corpus holds it."""
    return grounding.grounded_references(grounding.references(_rows(t, TEXTS, "id int, text string")), *_known(t))


@query(_values([
    (1, "", 0, "lib/io.h,src/db/store.py", "", "Reader::read,io.Base::go,main", "Reader::fake"),
    (2, "gtest/gtest.h", 2, "", "Store.hpp", "Reader::read", "Reader::gone"), (3, "", 0, "", "", "", ""), (4, "", 0, "", "", "", ""),
    (5, "", 0, "../x/app.py,./src/api/app.py", "src/api/none.py", "Box", "unknown_name"),
], ["id", "external", "unchecked", "verified_paths", "unverified_paths", "verified_symbols", "unverified_symbols"]))
def grounding_report(t):
    """PL-11, SO-8: per text, verified and unverified references."""
    return _joined(grounding.grounding(_rows(t, TEXTS, "id int, text string"), *_known(t)))


@query(f"""
WITH r AS (SELECT *, coalesce(category, string_split(rule_id, '-')[1]) AS c FROM ({_values(RULES, ['rule_set', 'rule_id', 'category'])})),
s AS (SELECT rule_set, count(*) AS n, count(DISTINCT c) AS k FROM r GROUP BY 1)
SELECT rule_set, rule_id, CASE WHEN n <= 8 OR k < 2 THEN '' ELSE c END AS part FROM r JOIN s USING (rule_set)
""")
def rule_groups(t):
    """EX-16: the parts in which the rules of a set are asked."""
    return outline.rule_groups(_rows(t, RULES, "rule_set string, rule_id string, category string"))


@query(f"""
SELECT diagram, id, 40 + 240 * CASE kind WHEN 'component' THEN 1 WHEN 'endpoint' THEN 2 WHEN 'datastore' THEN 3 WHEN 'external' THEN 4 ELSE 0 END AS x,
40 + 90 * (row_number() OVER (PARTITION BY diagram, kind ORDER BY ord) - 1) AS y FROM ({_values(NODES, ['diagram', 'id', 'kind', 'ord'])})
""")
def column_layout(t):
    """RK-12: places of diagram nodes."""
    return outline.column_layout(_rows(t, NODES, "diagram string, id string, kind string, ord int"))


@query(_values([("", "lib,src", "README"), ("src", "api,db", ""), ("src/api", "v2", "app.py"), ("src/api/v2", "", "b.py"), ("src/db", "", "store.py"), ("lib", "", "io.h")], ["dir", "dirs", "files"]))
def tree_outline(t):
    """EX-15: directories with what they hold."""
    return outline.tree_outline(_rows(t, TREE, "path string"))


@query(f"SELECT repo, arg_max(path, n * 1000 - ord) AS path, max(n) AS n FROM ({_values(DBS, ['repo', 'path', 'ord', 'n'])}) WHERE n IS NOT NULL GROUP BY repo")
def largest_compile_db(t):
    """AG-23: the compile database of each repository."""
    return outline.largest_compile_db(_rows(t, DBS, "repo string, path string, ord int, n int"))


@query(_values(list(zip([u for u, in URLS], ["ok", "plaintext", "ok", "ok", "host", "empty", "empty"], strict=True)), ["url", "verdict"]))
def endpoint_policy(t):
    """FL-22: endpoints under a network policy."""
    u = F.col("url")
    return _rows(t, URLS, "url string").select("url", outline.endpoint_policy(u, fx.host_of(u), True, ("api.example.com",)).alias("verdict"))


@query(_values(CSHARP, ["path", "generated"]))
def generated_csharp(t):
    """FL-14: generated C# files."""
    return _rows(t, [(p,) for p, _ in CSHARP], "path string").select("path", px.is_generated_csharp(F.col("path")).alias("generated"))


@query(_values(HEADERS, ["name", "system"]))
def system_headers(t):
    """FL-15: headers of the standard libraries."""
    return _rows(t, [(h,) for h, _ in HEADERS], "name string").select("name", px.is_system_header(F.col("name")).alias("system"))


CRATES = [("a/src/lib.rs", 1), ("a/src/foo/mod.rs", 2), ("a/src/foo/bar.rs", 3), ("src/main.rs", 4), ("src/util.rs", 5), ("src/util/deep.rs", 6), ("notes.txt", 7)]
USES = [("a/src/foo/bar.rs", "crate::foo::Thing"), ("a/src/foo/bar.rs", "super::bar::x"), ("a/src/foo/bar.rs", "super::super::nope"), ("a/src/foo/bar.rs", "std::fmt"), ("a/src/foo/mod.rs", "self::bar"), ("src/util/deep.rs", " crate::util::deep::f"), ("src/util/deep.rs", "super"), ("src/main.rs", "super::super::x"), ("src/main.rs", "supermarket::x")]
SPANS = [("f", 10, 20), ("f", 12, 14), ("f", 30, 31), ("g", 5, 6)]
LINES = [(1, "f", 13), (2, "f", 16), (3, "f", 25), (4, "f", 9), (5, "g", 300), (6, "h", 1)]
UNITS = [("src/api.v2", "src_api_v2", r"src/api.v2", "``src/api.v2``"), ("--", "component", "--", "``--``"), ("a_b|*c`\\", "a_b_c", "a\\_b\\|\\*c\\`\\\\", "``a_b|*c'\\``")]


@query(_values([
    ("a/src/foo/bar.rs", "crate::foo::Thing", "a/src/foo/mod.rs"), ("a/src/foo/bar.rs", "super::bar::x", "a/src/foo/bar.rs"), ("a/src/foo/bar.rs", "super::super::nope", "a/src/lib.rs"),
    ("a/src/foo/mod.rs", "self::bar", "a/src/foo/bar.rs"), ("src/util/deep.rs", " crate::util::deep::f", "src/util/deep.rs"), ("src/util/deep.rs", "super", "src/util.rs"),
], ["path", "import", "target"]))
def rust_import_resolution(t):
    """JN-2: files that Rust imports name."""
    return resolve.rust_imports(_rows(t, USES, "path string, import string"), _rows(t, CRATES, "path string, ord int"))


@query(_values(list(zip([p for p, _ in CRATES], ["a", "a::foo", "a::foo::bar", "crate", "crate::util", "crate::util::deep", None], strict=True)), ["path", "module"]))
def rust_modules(t):
    """SF-4: modules of Rust files."""
    return _rows(t, CRATES, "path string, ord int").select("path", px.rust_module_name(F.col("path")).alias("module"))


@query(f"""
SELECT id, coalesce(max(start) FILTER (WHERE line BETWEEN start AND "end"), max(start) FILTER (WHERE start <= line)) AS start
FROM ({_values(LINES, ['id', 'file', 'line'])}) l LEFT JOIN ({_values(SPANS, ['file', 'start', '"end"'])}) s USING (file) GROUP BY id
""")
def enclosing_definition(t):
    """JN-6: the definition around a line, else the nearest before it."""
    return asof.enclosing_or_preceding(_rows(t, LINES, "id int, file string, line int"), _rows(t, SPANS, "file string, start int, end int"), "file", "line", "id", 100)


@query(_values(UNITS, ["name", "safe", "escaped", "literal"]))
def report_names(t):
    """SF-25, SF-26: names made safe for files and for reStructuredText."""
    n = F.col("name")
    return _rows(t, [(u[0],) for u in UNITS], "name string").select("name", px.safe_name(n).alias("safe"), fx.rst_escaped(n).alias("escaped"), fx.rst_literal(n).alias("literal"))


#: path, text, then what must be found: endpoints, hosts, stores, brokers, sockets, variables, sentences.
CASES = [
    ("api/app.py", '@app.get("/a")\n@app.post("/b")\nr.get("/a")\nos.environ["KEY"]\nos.getenv("URL")\nrequests.get("https://worker:9000/x")\nimport sqlalchemy, psycopg2\n', "/a,/b", "worker:9000", "PostgreSQL,SQLAlchemy", "", "", "KEY,URL", "exposes 2 HTTP endpoint(s)|makes outbound network calls|accesses PostgreSQL, SQLAlchemy|reads 2 env var(s)"),
    ("lic.c", "/* see \"https://www.apache.org/licenses\" */\nint x;\n", "", "", "", "", "", "", ""),
    ("dyn.js", "fetch(url)\nname.delete('CFS-')\nprocess.env.HOME\n", "", "(dynamic http client)", "", "", "", "HOME", "makes outbound network calls|reads 1 env var(s)"),
    ("net.c", "socket(AF_INET, SOCK_DGRAM, 0);\n", "", "", "", "", "UDP socket", "", "uses sockets: UDP socket"),
    ("any.py", "socket.socket(x)\n", "", "", "", "", "Socket (generic)", "", "uses sockets: Socket (generic)"),
    ("names.json", '{"cacheRedis": "redis-", "bus": "kafka_"}', "", "", "", "", "", "", ""),
    ("bus.go", 'import "github.com/segmentio/kafka"\nhttp.HandleFunc("/go", h)\nhttp.Get("http://b.internal/x")\nhttp.Get("http://a.w3.org/x")\n', "/go", "b.internal", "", "Kafka", "", "", "exposes 1 HTTP endpoint(s)|makes outbound network calls|uses messaging: Kafka"),
    ("conf.cs", 'var c = builder.Configuration["A:B"];\nrecord.Configuration["theme"];\n[HttpGet("/c")]\nxmlns="http://q.internal" new HttpClient();\n', "/c", "(dynamic http client)", "", "", "", "A:B,theme", "exposes 1 HTTP endpoint(s)|makes outbound network calls|reads 2 env var(s)"),
    ("empty.py", "", "", "", "", "", "", "", ""),
]
COLUMNS = ("endpoints", "outbound_calls", "datastores", "messaging", "sockets", "env_vars")


def _signal_files(t):
    return t("region").sparkSession.createDataFrame([c[:2] for c in CASES], "path string, text string")


def _summaries(files):
    """EX-8: a file's summary row: language, lines, signals, sentences."""
    found = files.withColumns(sg.io_signals(comments.strip_comments(F.col("text"))))
    return found.withColumn("side_effects", sg.side_effects({c: F.col(c) for c in COLUMNS}))


@query(_values([(c[0], *c[2:8]) for c in CASES], ["path", *COLUMNS]))
def io_signals(t):
    """SF-5 to SF-10, EX-7: signals of files."""
    return _summaries(_signal_files(t)).select("path", *(F.array_join(c, ",").alias(c) for c in COLUMNS))


@query(_values([(c[0], c[8]) for c in CASES], ["path", "effects"]))
def side_effect_sentences(t):
    """PJ-3: sentences on what files do."""
    return _summaries(_signal_files(t)).select("path", F.array_join("side_effects", "|").alias("effects"))


@query(_values([(c[0], {"py": "Python", "c": "C", "js": "JavaScript", "json": "JSON", "go": "Go", "cs": "C#"}[c[0].rsplit(".")[-1]], "api" if "/" in c[0] else "(root)", c[1].count("\n"), len(c[8].split("|")) if c[8] else 0) for c in CASES], ["path", "language", "component", "loc", "effects"]))
def file_summaries(t):
    """EX-8, PL-1: the index's row of each file."""
    p = F.col("path")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("int")
    return _summaries(_signal_files(t)).select("path", px.detect_language(p).alias("language"), px.component_for(p).alias("component"), lines.alias("loc"), F.size("side_effects").alias("effects"))


CALLS = [("t1", "load", 1), ("t1", "load", 4), ("t1", "load", 5), ("t1", "load", 1), ("t1", "gone", 0), ("t1", "print", 9), ("t1", "dumps", 3), ("t2", "load", 2), ("t2", "Store", 7), ("t2", "Box", 0), ("t2", "Box", None), ("t3", "twice", 1)]
ORIGINS = [("t1", "load", "app.io", 1), ("t1", "gone", "app.io", 2), ("t1", "dumps", "json", 3), ("t2", "load", "app.io", 1), ("t2", "Store", "app.db", 2), ("t2", "Box", "app.db", 3), ("t3", "twice", "json", 1), ("t3", "twice", "app.db", 2)]
MODULES = [("app.io",), ("app.db",), ("app.db",)]
SIGNATURES = [("app.io", "load", 3, 1, 3, False), ("app.db", "Store", 4, 0, 0, True), ("app.db", "Box", 1, 0, 0, False), ("app.db", "Box", 9, 1, 2, False), ("app.db", "twice", 20, 1, 1, False)]
LISTINGS = [("a.o", "0000 T main\n0010 t helper\n     U printf\n0020 D table\n\nW\n0030 W _ZN1AC2Ev\n"), ("b.o", ""), ("c.o", None), ("d.o", "  w   soft  \n0000 T main")]
TABLES = {
    "calls": (CALLS, "test string, name string, n_args int"),
    "origins": (ORIGINS, "test string, name string, module string, lineno int"),
    "modules": (MODULES, "module string"),
    "signatures": (SIGNATURES, "module string, name string, lineno int, required int, total int, flexible boolean"),
    "listings": (LISTINGS, "path string, text string"),
}


def _table(t, name):
    return t("region").sparkSession.createDataFrame(*TABLES[name])


def _with(*names):
    return "WITH " + ", ".join(f"{n} AS ({_values(TABLES[n][0], [c.split()[0] for c in TABLES[n][1].split(', ')])})" for n in names)


@query(_with("calls", "origins", "modules", "signatures") + """,
o AS (SELECT test, name, arg_max(module, lineno) AS module FROM origins GROUP BY 1, 2),
s AS (SELECT * FROM signatures QUALIFY row_number() OVER (PARTITION BY module, name ORDER BY lineno DESC) = 1),
j AS (SELECT c.test, c.name, o.module, c.n_args, s.required, s.total, s.flexible, s.name IS NULL AS missing FROM calls c JOIN o ON c.test = o.test AND c.name = o.name LEFT JOIN s ON s.module = o.module AND s.name = o.name WHERE o.module IN (SELECT module FROM modules))
SELECT test, name, module, CASE WHEN missing THEN 'missing' ELSE 'arity' END AS kind, CASE WHEN NOT missing THEN min(n_args) END AS n_args, required, total
FROM j WHERE missing OR (NOT flexible AND (n_args < required OR n_args > total)) GROUP BY test, name, module, missing, required, total
""")  # fmt: skip
def call_arity(t):
    """Calls of imported names that their module lacks or that pass a wrong number of arguments."""
    return verify.arity_issues(*(_table(t, n) for n in ("calls", "origins", "modules", "signatures")))


@query(_values([("a.o", 0, "main", "T"), ("a.o", 1, "helper", "t"), ("a.o", 6, "_ZN1AC2Ev", "W"), ("d.o", 0, "soft", "w"), ("d.o", 1, "main", "T")], ["path", "ord", "symbol", "class"]))
def listed_symbols(t):
    """Functions in symbol listings of object files."""
    return verify.text_symbols(_table(t, "listings"))


class Table:
    """Stands for any given table: the cases take its session only."""

    def __init__(self, spark):
        self.sparkSession = spark


@pytest.mark.parametrize("name", sorted(CASES_BY_NAME))
def test_literal_rows(spark, duck, name):
    sql, fn = CASES_BY_NAME[name]
    df = fn(lambda _: Table(spark))
    r = duck.sql(sql)
    assert rows_of(df.columns, df.collect()) == rows_of(list(r.columns), r.fetchall())
