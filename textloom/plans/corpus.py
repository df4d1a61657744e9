"""The corpus store's queries, over the file model that the given tables stand for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions import text as fx
from ..operators import caps, pack, snapshot, store
from .derived import reading, with_derived
from .registry import query

def corpus(body: str, *names: str):
    """Register a query ``(table by name) -> DataFrame`` over derived tables with its SQL."""

    def register(fn):
        def run(t):
            return fn(reading(t))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(f"{with_derived(*names)} {body}")(run)
        return fn

    return register


@corpus("SELECT * FROM summaries WHERE path = 'src/db/f1.py'", "summaries")
def point_lookup(t):
    """FL-1: one file's summary."""
    return t("summaries").where("path = 'src/db/f1.py'")


@corpus("SELECT path AS file, name, lineno AS line FROM symbols WHERE kind IN ('function', 'method') AND starts_with(path, 'src/') ORDER BY path, lineno, name LIMIT 200", "symbols")
def functions_of_component(t):
    """FL-3, FL-5, PJ-1: functions and methods beneath a path."""
    return store.kind_filter(t("symbols"), prefix="src/")


@corpus("SELECT qualified_name, kind, file AS path, bases FROM types WHERE contains(lower(qualified_name), 'ring')", "types")
def type_search(t):
    """FL-4, GR-6: types by part of their name, with bases."""
    return store.find_types(t("types"), "Ring")


@corpus("SELECT src_file AS path, caller, min(nullif(line, 0)) AS line FROM calls WHERE callee = 'c3' AND src_file <> dst_file GROUP BY ALL", "calls")
def callers_of(t):
    """FL-6, FL-8, GR-2: callers from other files."""
    return store.callers(t("calls"), "c3")


@corpus("""
, e AS (SELECT *, src_file = 'src/db/f1.py' AS o FROM calls WHERE src_file <> dst_file AND 'src/db/f1.py' IN (src_file, dst_file))
SELECT CASE WHEN o THEN 'calls' ELSE 'called by' END AS direction, CASE WHEN o THEN dst_file ELSE src_file END AS path, count(DISTINCT callee) AS callees FROM e GROUP BY 1, 2
""", "calls")  # fmt: skip
def file_call_graph(t):
    """FL-7, GR-2: a file's neighbours in the call graph."""
    return store.file_graph(t("calls"), "src/db/f1.py")


@corpus("SELECT path, ends_with(purpose, ' bytes).') AS placeholder FROM summaries", "summaries")
def placeholder_purposes(t):
    """FL-19: purposes that tell a size only."""
    return t("summaries").select("path", store.is_placeholder(F.col("purpose")).alias("placeholder"))


_PARSED = """
, p AS (SELECT string_split(l, chr(9)) AS f, left(l, 1) AS c FROM listing),
ch AS (SELECT CASE WHEN c IN ('R', 'C') THEN f[3] ELSE f[2] END AS path, CASE WHEN c = 'R' THEN f[2] END AS old_path, CASE c WHEN 'R' THEN 'renamed' WHEN 'A' THEN 'added' WHEN 'C' THEN 'added' WHEN 'D' THEN 'deleted' ELSE 'modified' END AS status FROM p)
"""


def _changes(t):
    return t("listing").select(store.name_status(F.col("l")).alias("c")).select("c.*")


@corpus(_PARSED + "SELECT * FROM ch", "listing")
def delta_rows(t):
    """EX-10, SO-7: rows of a name-status listing."""
    return _changes(t)


_REASON = "CASE WHEN status = 'deleted' THEN 'deleted' WHEN ends_with(path, '.png') THEN 'binary' WHEN starts_with(path, '.git/') THEN 'vcs' WHEN starts_with(path, 'build/') THEN 'ignored' END"


@corpus(_PARSED + f"SELECT {_REASON} AS reason, count(*) AS n FROM ch GROUP BY 1 HAVING reason IS NOT NULL", "listing")
def delta_dropped(t):
    """FL-18, PL-10: what a delta leaves out, and why."""
    return store.analyzable(_changes(t).withColumn("is_binary", F.col("path").endswith(".png")), ["build/*"])[1]


@corpus(_PARSED + f"SELECT DISTINCT component FROM owned JOIN ch USING (path) WHERE {_REASON} IS NULL", "listing", "owned")
def delta_components(t):
    """FL-21, JN-23, SO-6: components that own a change that can be analysed."""
    kept, _ = store.analyzable(_changes(t).withColumn("is_binary", F.col("path").endswith(".png")), ["build/*"])
    return store.owning_components(t("owned"), kept)


@corpus("""
, s AS (SELECT path, coalesce(nullif(signature, ''), name) AS s, row_number() OVER (PARTITION BY path ORDER BY lineno, name) AS rn, count(*) OVER (PARTITION BY path) AS n FROM symbols WHERE kind <> 'constant')
SELECT path, string_agg(s, '; ' ORDER BY rn) || CASE WHEN max(n) > 2 THEN '; +' || (max(n) - 2) || ' more' ELSE '' END AS key_symbols FROM s WHERE rn <= 2 GROUP BY path
""", "symbols")  # fmt: skip
def key_symbol_lists(t):
    """PJ-2: first signatures of each file."""
    return store.key_symbols(t("symbols"), 2)


@corpus("SELECT rule_id, file, line, coalesce(r.severity, i.severity, 'medium') AS severity, coalesce(r.category, i.category, 'general') AS category FROM items i LEFT JOIN rules r USING (rule_id)", "items", "rules")
def rule_lookup(t):
    """JN-8: severity and category by rule."""
    return store.with_rules(t("items"), t("rules"))


@corpus("""
, j AS (SELECT rule_id, file, line, coalesce(r.severity, i.severity, 'medium') AS severity FROM items i LEFT JOIN rules r USING (rule_id))
SELECT rule_id, file, line, row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), starts_with(file, 'vendor/'), starts_with(file, 'examples/'), file, line) AS place FROM j ORDER BY place LIMIT 4
""", "items", "rules")  # fmt: skip
def triage_order(t):
    """RK-3, ST-2: the four findings to look at first."""
    ranked, order = caps.keyed(store.with_rules(t("items"), t("rules")), store.triage_order())
    top = ranked.orderBy(*order).limit(4)
    return top.select("rule_id", "file", "line", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@corpus("""
, d AS (SELECT qualified_name, arg_max(file, ord) AS f FROM functions GROUP BY 1)
SELECT coalesce(nullif(r.file, ''), a.f) AS src_file, coalesce(nullif(callee_file, ''), b.f) AS dst_file, string_split(caller_qualified, '::')[-1] AS caller, string_split(callee_qualified, '::')[-1] AS callee, line
FROM report r LEFT JOIN d a ON a.qualified_name = caller_qualified LEFT JOIN d b ON b.qualified_name = callee_qualified WHERE src_file IS NOT NULL AND dst_file IS NOT NULL
""", "functions", "report")  # fmt: skip
def heavy_call_files(t):
    """JN-14, PL-8: calls of a heavy report with their files."""
    return store.heavy_calls(t("report"), t("functions"))


@corpus("""
, d AS (SELECT qualified_name, arg_max(file, ord) AS f FROM functions GROUP BY 1),
h AS (SELECT coalesce(nullif(r.file, ''), a.f) AS src_file, coalesce(nullif(callee_file, ''), b.f) AS dst_file, string_split(caller_qualified, '::')[-1] AS caller, string_split(callee_qualified, '::')[-1] AS callee, line
FROM report r LEFT JOIN d a ON a.qualified_name = caller_qualified LEFT JOIN d b ON b.qualified_name = callee_qualified WHERE line = 4 AND src_file IS NOT NULL AND dst_file IS NOT NULL)
SELECT * FROM h UNION ALL SELECT * FROM calls ANTI JOIN h USING (src_file, dst_file, caller, callee)
""", "functions", "report", "calls")  # fmt: skip
def heavy_ingest(t):
    """SK-5, SO-4, PL-8: a report's calls of one caller replace the light ones of their edges."""
    heavy = store.heavy_calls(t("report").where("line = 4"), t("functions"))
    return snapshot.upsert(t("calls"), heavy.select(*t("calls").columns), ["src_file", "dst_file", "caller", "callee"])


@corpus("SELECT DISTINCT i.path, f.path AS source FROM imports i JOIN files f ON string_split(module, '.')[-1] = regexp_replace(string_split(f.path, '/')[-1], '\\.[^.]*$', '')", "imports", "files")
def test_sources(t):
    """JN-17: sources that tests name by their imports."""
    return store.claimed_sources(t("imports"), t("files"))


@corpus("SELECT s.file, s.name, t.bases FROM sites s LEFT JOIN types t ON t.file = s.file AND regexp_extract(qualified_name, '([^.:]*)$', 1) = s.name", "sites", "types")
def type_bases(t):
    """JN-20: bases by file and short name."""
    types = t("types").select("file", store.short_name(F.col("qualified_name")).alias("name"), "bases")
    return t("sites").join(types, ["file", "name"], "left")


@corpus("""
, s AS (SELECT DISTINCT path FROM includes),
c AS (SELECT s.path, h.path AS header, -1 AS o FROM s JOIN headers h ON regexp_replace(s.path, '\\.c$', '.h') = h.path
UNION ALL SELECT i.path, h.path, pos FROM includes i JOIN headers h ON h.path = regexp_replace(i.path, '[^/]*$', '') || include)
SELECT path, header FROM c QUALIFY row_number() OVER (PARTITION BY path ORDER BY o, header) = 1
""", "headers", "includes")  # fmt: skip
def header_companions(t):
    """JN-21: the header of each source."""
    sources = t("includes").select("path").distinct()
    return store.header_companion(sources, t("headers"), t("includes"))


@corpus("SELECT header, count(*) AS n FROM diags GROUP BY header ORDER BY n DESC, min(ord) LIMIT 5", "diags")
def missing_header_histogram(t):
    """AG-9: five most missed headers."""
    return store.missing_headers(t("diags"))


@corpus("""
, d AS (SELECT DISTINCT * FROM io_edges), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY src, dst, detail) AS rn FROM d)
SELECT kind, count(*) AS n, string_agg(src || '>' || dst, ',' ORDER BY rn) FILTER (WHERE rn <= 2) AS edges, list_position(['import', 'http', 'datastore', 'messaging', 'socket'], kind)::BIGINT AS ord FROM r GROUP BY kind
""", "io_edges")  # fmt: skip
def io_by_kind(t):
    """AG-11, SO-5: distinct edges by kind."""
    return store.io_rollup(t("io_edges"), 2)


@corpus("SELECT dst AS system, string_agg(DISTINCT src, ',' ORDER BY src) AS users FROM io_edges WHERE kind = 'messaging' GROUP BY dst", "io_edges")
def system_users(t):
    """AG-12: components by messaging system."""
    return t("io_edges").where("kind = 'messaging'").groupBy(F.col("dst").alias("system")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("users"))


@corpus("SELECT path, string_agg(name, ',' ORDER BY lineno, name) AS names FROM symbols GROUP BY path", "symbols")
def symbols_by_file(t):
    """AG-17: names of each file, repeated ones too."""
    listed = t("symbols").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("lineno", "name"))).alias("a"))
    return listed.select("path", F.array_join(F.col("a.name"), ",").alias("names"))


@corpus("SELECT DISTINCT unnest([n, regexp_extract(n, '([^.:]*)$', 1)]) AS name FROM (SELECT name AS n FROM symbols UNION ALL SELECT qualified_name FROM types)", "symbols", "types")
def known_names(t):
    """AG-18: the name universe."""
    return store.name_universe(t("symbols"), t("types"))


@corpus("SELECT count(*) AS entries, sum(strlen(value))::BIGINT AS bytes FROM cache", "cache")
def cache_totals(t):
    """AG-19, SK-8: entries and bytes."""
    return store.cache_stats(t("cache"))


@corpus("SELECT CASE WHEN json_valid(value) AND value LIKE '%\"purpose\"%' THEN 'purpose' WHEN json_valid(value) AND value LIKE '%\"doc\"%' THEN 'doc' ELSE 'other' END AS kind, count(*) AS n FROM cache GROUP BY 1", "cache")
def cache_classes(t):
    """AG-25: entries by kind."""
    return store.cache_kinds(t("cache"))


@corpus("SELECT 'k1' AS key, 'new' AS value, 0 AS age_days UNION ALL SELECT * FROM cache WHERE key <> 'k1' AND age_days <= 30", "cache")
def cache_put_prune(t):
    """SK-8: put one value, prune the old."""
    new = t("cache").where("key = 'k1'").withColumns({"value": F.lit("new"), "age_days": F.lit(0)})
    return store.cache_pruned(store.cache_put(t("cache"), new), 30)


@corpus(r"""
SELECT path, len(list_filter(string_split(regexp_replace(text, '"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''', '', 'g'), chr(10)), lambda l: regexp_matches(l, '\b(assert\w*|ASSERT_\w+|EXPECT_\w+)\b'))) AS n FROM tests
""", "tests")  # fmt: skip
def assertion_counts(t):
    """AG-22: lines that assert."""
    return t("tests").select("path", store.assertions(F.col("text")).alias("n"))


@corpus("SELECT s.path, purpose, coalesce(string_agg(name || '=' || doc, ';' ORDER BY name || '=' || doc) FILTER (WHERE kind IN ('function', 'method') AND doc <> ''), '') AS functions FROM summaries s LEFT JOIN symbols y ON s.path = y.path GROUP BY ALL", "summaries", "symbols")
def summary_manifest(t):
    """AG-24: purposes and documented functions."""
    return store.manifest(t("symbols"), t("summaries"))


@corpus("SELECT * REPLACE (CASE WHEN name = 'main' THEN 'Both.' ELSE doc END AS doc) FROM symbols", "symbols")
def symbol_doc_update(t):
    """SK-3: new docs for all symbols of a name."""
    return store.set_symbol_doc(t("symbols"), t("symbols").where("name = 'main'").select("path", "name", F.lit("Both.").alias("doc")).distinct())


@corpus("SELECT path, language, (SELECT count(*) FROM symbols s WHERE s.path = f.path AND (s.path <> 'lib/f2.go' OR kind = 'function'))::BIGINT AS n_symbols FROM files f", "files", "symbols")
def symbols_replaced(t):
    """SK-2: one file's symbols replaced, its count with them."""
    files, _ = store.set_symbols(t("files"), t("symbols"), t("symbols").where("kind = 'function'"), "lib/f2.go")
    return files.withColumn("n_symbols", F.col("n_symbols").cast("long"))


@corpus("SELECT path FROM files WHERE string_split(path, '/')[-1] IN ('main.py', '__main__.py', 'app.py', 'main.go', 'main.rs', 'Program.cs') UNION SELECT path FROM symbols WHERE kind IN ('function', 'method') AND regexp_matches(name, '^main$|Main$') AND NOT starts_with(path, 'tests/')", "files", "symbols")
def entrypoint_union(t):
    """EX-13, SO-2: entry points by file name or symbol."""
    return store.entry_points(t("files"), t("symbols"))


@corpus("""
, c AS (SELECT CASE WHEN starts_with(src, 'src/') THEN split_part(src, '/', 2) WHEN starts_with(src, 'vendor/') THEN 'vendor/x' ELSE split_part(src, '/', 1) END AS src, CASE WHEN starts_with(dst, 'src/') THEN split_part(dst, '/', 2) WHEN starts_with(dst, 'vendor/') THEN 'vendor/x' ELSE split_part(dst, '/', 1) END AS dst FROM edges)
SELECT src, dst, count(*) AS n FROM c WHERE src <> dst GROUP BY ALL
""", "edges")  # fmt: skip
def component_imports(t):
    """GR-1: import edges between components."""
    return store.component_graph(t("edges"))


@corpus("SELECT language, count(*) AS n FROM files GROUP BY language ORDER BY n DESC, min(path) LIMIT 3", "files")
def languages_by_count(t):
    """ST-3: commonest languages, ties in path order."""
    return t("files").groupBy("language").agg(F.count("*").alias("n"), F.min("path").alias("first")).orderBy(F.desc("n"), "first").limit(3).drop("first")


@corpus("SELECT path, row_number() OVER (ORDER BY starts_with(path, 'vendor/'), path) <= 3 AS kept FROM files", "files")
def max_files_cap(t):
    """ST-5: the first three files by rank, the skipped tail flagged."""
    return store.capped_files(t("files"), px.path_rank(F.col("path")), 3).select("path", "kept")


@corpus("""
, r AS (SELECT *, sum(tokens) OVER (ORDER BY ord)::BIGINT AS running FROM diffs)
SELECT path, running, running <= 20000 AS fits, running > 20000 AND 20000 - (running - tokens) > 80 AS cut FROM r WHERE running - tokens <= 20000
""", "diffs")  # fmt: skip
def budgeted_diff(t):
    """RK-8: diffs within a budget, and the one that is cut."""
    return pack.budget_pack(t("diffs"), [F.asc("ord")], "tokens", 20_000, room=80).select("path", "running", "fits", "cut")


@query(r"""
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
""")
def first_seen_words(t):
    """WN-4: distinct words of a text, in the order of their first use."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return t("documents").select("doc_id", F.array_join(F.array_distinct(words), " ").alias("words"))


@query(r"SELECT page_id, regexp_replace(url, '(://)[^/@\s]*@', '\1') AS url, '<' || lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) || '>' AS host FROM pages")
def redacted_urls(t):
    """SF-18, SF-28: addresses without credentials, and their hosts."""
    return t("pages").select("page_id", fx.redact_url(F.col("url")).alias("url"), F.concat(F.lit("<"), fx.host_of(F.col("url")), F.lit(">")).alias("host"))


@corpus("""
SELECT component, purpose FROM (SELECT split_part(path, '/', 1) AS component, purpose, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY source <> 'model', length(path), path) AS rn FROM summaries WHERE NOT ends_with(purpose, ' bytes).')) WHERE rn = 1
""", "summaries")
def representative_purpose(t):
    """RK-14: a component's purpose from its best file; placeholders don't count."""
    s = t("summaries").where(~store.is_placeholder(F.col("purpose"))).withColumn("component", F.substring_index("path", "/", 1))
    order = F.struct((F.col("source") != "model").alias("a"), F.length("path").alias("b"), F.col("path"))
    return s.groupBy("component").agg(F.min_by("purpose", order).alias("purpose"))
