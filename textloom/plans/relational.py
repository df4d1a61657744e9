"""Relational operators of the file model, proved on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as px
from ..functions import text as fx
from ..operators import caps, dedupe, graph, resolve, snapshot
from .registry import query

#: Severity ranks: of findings, and of the priorities that stand for them.
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
PRIORITY = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3, "5-LOW": 4}
_RANK_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 9 END"


def severity_rank(col, ranks=SEVERITY):
    """Rank of a severity; unknown ones come last."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), col), F.lit(9))


@query(f"SELECT o_orderkey, o_custkey, rn FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK_SQL}, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def severity_cap_per_key(t):
    """Three most severe per key."""
    o = t("orders").select("o_orderkey", "o_custkey", severity_rank(F.col("o_orderpriority"), PRIORITY).alias("sev"))
    return caps.cap_per_key(o, "o_custkey", [F.asc("sev"), F.asc("o_orderkey")], 3).select("o_orderkey", "o_custkey", F.col("rn").cast("long").alias("rn"))


@query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {_RANK_SQL} <= 2")
def severity_threshold(t):
    """At least medium."""
    return t("orders").where(severity_rank(F.col("o_orderpriority"), PRIORITY) <= 2).select("o_orderkey", "o_orderpriority")


@query("""
WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
k AS (SELECT unnest(range(10)) AS k)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE n <= 10 OR EXISTS (SELECT 1 FROM k WHERE (k.k * r.n) // 10 = r.rn - 1)
""")
def systematic_sample(t):
    """Ten evenly spaced rows of each flag."""
    return caps.systematic_sample(t("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", [F.asc("l_orderkey"), F.asc("l_linenumber")], 10).drop("rn")


@query("""
WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn, greatest(1, count(*) OVER (PARTITION BY l_returnflag) // 25) AS step FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 25
""")
def strided_sample(t):
    """Every step-th row of each flag, at most 25."""
    return caps.strided_sample(t("lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), "l_returnflag", [F.asc("l_orderkey"), F.asc("l_linenumber")], 25).drop("rn")


@query("""
WITH r AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS pos, count(*) OVER () AS n FROM customer)
SELECT pos, c_name AS line FROM r WHERE pos <= 200 UNION ALL SELECT DISTINCT 201, '+' || (n - 200) || ' more' FROM r WHERE n > 200
""")
def capped_with_note(t):
    """200 rows and a note of how many more there are."""
    return caps.capped_with_note(t("customer"), [F.asc("c_custkey")], 200, F.col("c_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%0001%' ORDER BY c_name, c_custkey LIMIT 25")
def find_symbol(t):
    """Substring search whatever the case, first 25."""
    return t("customer").where(F.col("c_name").ilike("%0001%")).orderBy("c_name", "c_custkey").limit(25).select("c_custkey", "c_name")


@query("SELECT o_orderstatus AS status, NULL::VARCHAR AS priority, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, o_orderpriority, count(*) FROM orders GROUP BY 2")
def grouped_counters(t):
    """Counters of several attributes in one pass."""
    o = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.groupingSets([["status"], ["priority"]], "status", "priority").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_partkey, min(nullif(l_linenumber, 0)) AS line FROM lineitem GROUP BY 1, 2")
def edge_dedupe_min(t):
    """One edge a pair with its smallest known line."""
    return dedupe.keep_min_known(t("lineitem").select("l_suppkey", "l_partkey", F.col("l_linenumber").alias("line")), ["l_suppkey", "l_partkey"], "line")


@query("""
SELECT l_suppkey, l_returnflag, l_partkey, line FROM (SELECT l_suppkey, l_returnflag, l_partkey, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1
""")
def callers_rollup(t):
    """One caller a key, that of the smallest line, with what it carries."""
    rows = t("lineitem").select("l_suppkey", "l_returnflag", "l_partkey", F.col("l_linenumber").alias("line"))
    return dedupe.keep_first_by(rows, ["l_suppkey", "l_returnflag"], ["l_partkey"], "line").select("l_suppkey", "l_returnflag", "l_partkey", "line")


@query("""
WITH b AS (SELECT l_suppkey, list_sort(list(DISTINCT p_brand)) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_suppkey, array_to_string(b[1:6], ',') || CASE WHEN len(b) > 6 THEN ' (+' || (len(b) - 6) || ' more)' ELSE '' END AS brands FROM b
""")
def call_pair_rollup(t):
    """First six distinct names of a pair, and how many more."""
    b = t("lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_brand"), "p_partkey").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    more = F.when(F.size("b") > 6, F.concat(F.lit(" (+"), (F.size("b") - 6).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return b.select("l_suppkey", F.concat(F.array_join(F.slice("b", 1, 6), ","), more).alias("brands"))


@query("SELECT p_name, arg_min(p_partkey, (p_type LIKE 'ECONOMY%')::INT * 1000000000::BIGINT + p_partkey) AS p_partkey FROM part GROUP BY p_name")
def definition_table(t):
    """Where a name is defined: the first that is no double."""
    return dedupe.definitions(t("part"), "p_name", F.col("p_type").startswith("ECONOMY"), "p_partkey", "p_partkey")


@query("""
WITH c AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
loc AS (SELECT l_suppkey, p_brand, min(l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
g AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_size > 25 GROUP BY 1)
SELECT c.l_suppkey, c.p_brand, coalesce(loc.k, g.k) AS target FROM c LEFT JOIN loc USING (l_suppkey, p_brand) LEFT JOIN g USING (p_brand) WHERE coalesce(loc.k, g.k) IS NOT NULL
""")
def precedence_resolve(t):
    """A definition nearby beats one anywhere."""
    j = t("lineitem").select("l_suppkey", "l_returnflag", F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_brand"), "p_partkey")
    local = j.where("l_returnflag = 'R'").groupBy("l_suppkey", "p_brand").agg(F.min("p_partkey").alias("target"))
    everywhere = t("part").where("p_size > 25").groupBy("p_brand").agg(F.min("p_partkey").alias("target"))
    return resolve.precedence_resolve(j.select("l_suppkey", "p_brand").distinct(), local, everywhere, ["l_suppkey", "p_brand"], "p_brand", "target").select("l_suppkey", "p_brand", "target")


@query("""
WITH d AS (SELECT split_part(p_name, ' ', 1) AS short, p_name FROM part WHERE p_size <= 20),
u AS (SELECT short, min(p_name) AS p_name FROM d GROUP BY short HAVING count(*) = 1)
SELECT p_partkey, split_part(p.p_name, ' ', 1) AS short, coalesce(u.p_name, split_part(p.p_name, ' ', 1)) AS p_name, u.p_name IS NOT NULL AS repaired FROM part p LEFT JOIN u ON u.short = split_part(p.p_name, ' ', 1)
""")
def unique_match_repair(t):
    """Names with exactly one definition are rewritten to it."""
    short = F.substring_index("p_name", " ", 1)
    defs = t("part").where("p_size <= 20").select(short.alias("short"), "p_name")
    return resolve.unique_match_repair(t("part").select("p_partkey", short.alias("short")), "short", defs, "p_name").select("p_partkey", "short", "p_name", "repaired")


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS a FROM pages),
e AS (SELECT page_id, unnest(range(1, len(a) + 1)) AS depth, a FROM p),
x AS (SELECT page_id, depth, array_to_string(a[1:depth], '/') AS prefix FROM e),
i AS (SELECT prefix, max(page_id) AS target FROM x WHERE depth <= 2 GROUP BY prefix)
SELECT x.page_id, arg_max(i.target, x.depth) AS target FROM x LEFT JOIN i ON x.prefix = i.prefix AND i.target IS NOT NULL WHERE i.target IS NOT NULL GROUP BY x.page_id
""")
def longest_prefix_resolve(t):
    """Longest indexed prefix of each page's path."""
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), lambda x: x != "")
    pages = t("pages").select("page_id", parts.alias("a"))
    index = pages.select("page_id", F.explode(resolve.prefixes(F.col("a"))).alias("p")).where("p.depth <= 2").groupBy(F.col("p.prefix").alias("prefix")).agg(F.max("page_id").alias("target"))
    return resolve.longest_prefix(pages, "page_id", F.col("a"), index, "prefix", "target").where("target is not null")


@query("""
WITH k AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS base FROM pages WHERE starts_with(url, 'https:')),
c AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS base FROM pages)
SELECT page_id, c.base, k.base IS NOT NULL AS verified FROM c LEFT JOIN k ON c.base = k.base
""")
def ground_paths(t):
    """Paths of all pages are known if a page behind TLS has their base name."""
    base = px.basename(F.col("url"))
    return resolve.grounded(t("pages").select("page_id", base.alias("base")), t("pages").where("startswith(url, 'https:')").select(base.alias("base")), "base").select("page_id", "base", "verified")


_W = r"regexp_extract_all(lower(text), '[\p{L}]+')"


@query(f"""
WITH c AS (SELECT DISTINCT unnest({_W}) AS w FROM conversations), k AS (SELECT DISTINCT unnest({_W}) AS w FROM documents WHERE lang = 'en')
SELECT count(*) AS words, count(*) FILTER (WHERE k.w IS NOT NULL) AS verified FROM c LEFT JOIN k ON c.w = k.w
""")
def ground_symbols(t):
    """How many words of conversations the corpus knows."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("w")
    g = resolve.grounded(t("conversations").select(words).distinct(), t("documents").where("lang = 'en'").select(words), "w")
    return g.agg(F.count("*").alias("words"), F.count_if("verified").alias("verified"))


@query("""
WITH a AS (SELECT DISTINCT regexp_extract(url, '[^/]*/[^/]*$') AS ask FROM pages),
p AS (SELECT DISTINCT url, regexp_extract(url, '[^/]*$') AS b FROM pages),
m AS (SELECT ask, url, ends_with(url, '/' || ask) OR url = ask AS s FROM a JOIN p ON regexp_extract(ask, '[^/]*$') = p.b),
g AS (SELECT ask, list_sort(list(DISTINCT url) FILTER (WHERE s)) AS s, list_sort(list(DISTINCT url)) AS a FROM m GROUP BY ask)
SELECT ask, array_to_string((CASE WHEN len(s) > 0 THEN s ELSE a END)[1:3], ',') AS found FROM g
""")
def suggestion_join(t):
    """Known paths for an asked one: by suffix, else by base name."""
    asked = t("pages").select(F.regexp_extract("url", r"[^/]*/[^/]*$", 0).alias("ask")).distinct()
    return resolve.suggestions(asked, t("pages").select("url").distinct(), "url")


_DIFF = """
WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 13 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.s = b.s THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.doc_id = b.doc_id
"""


def _snapshots(t):
    d = t("documents").select("doc_id", "text")
    old = d.where("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"))
    new = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return old, new


@query(_DIFF)
def incremental_diff(t):
    """Two snapshots compared by digest; texts are hashed before the shuffle."""
    return snapshot.diff(*_snapshots(t), "doc_id", "sha")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 13 <> 0)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
""")
def snapshot_merge(t):
    """Upsert by key."""
    return snapshot.upsert(*_snapshots(t), ["doc_id"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'old' AS origin FROM lineitem WHERE l_linenumber <= 3
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'new' FROM lineitem WHERE l_linenumber > 3
""")
def append_if_absent(t):
    """Append rows whose key is absent."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return snapshot.append_if_absent(rows.where("l_linenumber <= 3").withColumn("origin", F.lit("old")), rows.where("l_linenumber >= 2").withColumn("origin", F.lit("new")), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels")
def file_scoped_replace(t):
    """Replace the rows of some files only."""
    rows = t("labels").select("doc_id", "quality")
    return snapshot.replace_scope(rows, rows.withColumn("quality", 1 - F.col("quality")), rows.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def cascade_delete(t):
    """Edges of which neither end is gone."""
    edges = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    kept = snapshot.cascade_delete(edges, t("orders").where("o_orderstatus = 'P'"), "o_orderkey", ["l_orderkey"])
    return snapshot.cascade_delete(kept, t("part").where("p_size < 10"), "p_partkey", ["l_partkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, p_brand, s_name, s_nationkey IS NULL AS unknown_supplier FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
def enrich_left(t):
    """Findings with what is known of their file; the sides' sizes decide the joins."""
    p, s = t("part").where("p_size > 10").select("p_partkey", "p_brand"), t("supplier").where("s_acctbal > 0").select("s_suppkey", "s_name", "s_nationkey")
    j = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "p_brand", "s_name", F.col("s_nationkey").isNull().alias("unknown_supplier"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part UNION SELECT p_partkey, (p_partkey * 3 + 11) % 1999 FROM part WHERE p_size > 40),
r AS (SELECT unnest([1, 2, 3, 5, 8])::BIGINT AS node UNION SELECT e.b FROM r JOIN e ON e.a = r.node)
SELECT node FROM r
""")
def include_closure(t):
    """All that five seeds include, however far."""
    p = t("part")
    edges = p.select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b")).union(p.where("p_size > 40").select("p_partkey", (F.col("p_partkey") * 3 + 11) % 1999))
    seeds = p.sparkSession.range(9).where("id in (1, 2, 3, 5, 8)").select(F.col("id").alias("node"))
    return graph.closure(seeds, edges, "a", "b")


@query("""
WITH e AS (SELECT DISTINCT 'n' || (l_suppkey % 100) AS a, 'n' || (l_partkey % 100) AS b FROM lineitem),
d AS (SELECT n, count(*) AS c FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n),
k AS (SELECT n FROM d ORDER BY c DESC, n LIMIT 40)
SELECT a, b FROM e WHERE a IN (SELECT n FROM k) AND b IN (SELECT n FROM k)
""")
def degree_cap(t):
    """Edges among the forty nodes of highest degree."""
    e = t("lineitem").select(*(F.concat(F.lit("n"), (F.col(c) % 100).cast("string")).alias(n) for c, n in (("l_suppkey", "a"), ("l_partkey", "b")))).distinct()
    return graph.degree_cap(e, "a", "b", 40).select("a", "b")


@query("SELECT node, degree FROM (SELECT n AS node, count(*) AS degree FROM (SELECT 's' || l_suppkey AS n FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY n) ORDER BY degree DESC, node LIMIT 60")
def node_degrees(t):
    """The sixty nodes of highest degree."""
    e = t("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"))
    return graph.degrees(e, "a", "b").orderBy(F.desc("degree"), "node").limit(60)


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"


@query(f"SELECT {_HOST} AS host, count(*) AS n FROM pages WHERE NOT ends_with({_HOST}, '.test') GROUP BY 1")
def outbound_hosts(t):
    """Hosts without those of a blacklisted suffix."""
    host = fx.host_of(F.col("url"))
    return t("pages").select(host.alias("host")).where(~F.col("host").endswith(".test")).groupBy("host").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') AS a FROM pages),
d AS (SELECT page_id, a[1:greatest(len(a) - 1, 0)] AS d FROM p),
c AS (SELECT page_id, CASE WHEN len(d) = 0 THEN '(root)' WHEN len(d) > 1 AND d[1] = 'src' THEN array_to_string(d[2:3], '/') ELSE array_to_string(d[1:2], '/') END AS component FROM d)
SELECT component, count(*) AS n, min(page_id) AS first_id FROM c GROUP BY component
""")
def component_rollup(t):
    """Pages by the component of their path."""
    c = px.component_for(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return t("pages").groupBy(c.alias("component")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


@query(r"""SELECT page_id, regexp_replace(html, '("[^"]*"|''[^''<>]*'')|<!--.*?-->|<script\b.*?</script>', '\1', 'gs') AS html FROM pages""")
def strip_comments_html(t):
    """Pages without comments and scripts."""
    return t("pages").select("page_id", fx.strip_markup_comments(F.col("html")).alias("html"))


@query("""
WITH p AS (SELECT page_id, url, list_filter(string_split(lower(url), '/'), lambda x: x <> '') AS a FROM pages),
d AS (SELECT page_id, url, a[1:len(a) - 1] AS d FROM p)
SELECT page_id, url FROM d ORDER BY list_has_any(d, ['vendor', 'third_party', 'thirdparty', 'node_modules', 'external', 'deps']), list_has_any(d, ['examples', 'example', 'demo', 'demos', 'samples', 'sample']), url, page_id LIMIT 50
""")
def path_rank_topk(t):
    """First fifty paths, own code first."""
    ranked, order = caps.keyed(t("pages"), px.path_rank(F.col("url")))
    return ranked.orderBy(*order, "page_id").limit(50).select("page_id", "url")
