"""Nesting, containment and attribution over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caps, contains, nesting
from .registry import query

_VOIDS = ", ".join(f"'{v}'" for v in nesting.VOID)
_TAGS = rf"""
WITH h AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|(<script\b[^>]*>).*?(</script>)|(<style\b[^>]*>).*?(</style>)', '\1\2\3\4', 'g'), '</?[A-Za-z][A-Za-z0-9]*') AS a FROM pages),
r AS (SELECT page_id, unnest(a) AS tag, (generate_subscripts(a, 1) - 1)::BIGINT AS pos FROM h),
t AS (SELECT page_id, pos, lower(regexp_replace(tag, '[</]+', '')) AS name, CASE WHEN lower(regexp_replace(tag, '[</]+', '')) IN ({_VOIDS}) THEN 0 WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS kind FROM r WHERE NOT (starts_with(tag, '</') AND lower(tag[3:]) IN ({_VOIDS}))),
d AS (SELECT *, sum(kind) OVER w AS d FROM t WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
l AS (SELECT *, least(0, min(d) OVER w) AS low FROM d WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
c AS (SELECT *, d - low AS c, kind = -1 AND low < lag(low, 1, 0) OVER w AS lone FROM l WINDOW w AS (PARTITION BY page_id, name ORDER BY pos)),
n AS (SELECT page_id, pos, name, CASE WHEN kind = 1 AND NOT coalesce(min(c) OVER (PARTITION BY page_id, name ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < c, false) THEN 0 ELSE kind END AS kind, lone FROM c),
s AS (SELECT page_id, pos, name, kind, sum(kind) OVER (PARTITION BY page_id ORDER BY pos) AS d FROM n WHERE NOT lone),
e AS (SELECT page_id, pos, name, kind, d - least(0, min(d) OVER (PARTITION BY page_id ORDER BY pos)) AS d FROM s),
v AS (SELECT *, CASE WHEN kind = 1 THEN d - 1 ELSE d END::BIGINT AS level FROM e)
"""


@query(_TAGS + """
SELECT v.page_id, v.pos, v.name, v.level, CASE WHEN v.level > 0 THEN o.pos END AS parent, CASE WHEN v.level > 0 THEN o.name END AS parent_name
FROM v ASOF LEFT JOIN (SELECT page_id, pos, name, d FROM v WHERE kind = 1) o ON v.page_id = o.page_id AND v.level = o.d AND v.pos > o.pos WHERE v.kind >= 0
""")  # fmt: skip
def tag_nesting(t):
    """GR-4: each element of each page with its depth and the element around it."""
    tags = nesting.paired(nesting.tags(t("pages"), "page_id", "html"), "page_id", "pos", "name", "kind")
    return nesting.enclosing(tags, "page_id", "pos", "kind", ["name"]).where("kind >= 0").drop("kind")


@query("""
SELECT l_orderkey, 's' || l_suppkey AS callee, CASE WHEN l_linenumber = 1 THEN NULL ELSE 'o' || l_orderkey END AS function, count(*) AS n FROM lineitem GROUP BY ALL
""")
def call_sites(t):
    """EX-6: calls of brace code, which is rendered from the orders' lines, with the function around each.

    First lines are calls at top level, others stand in the order's function, odd ones in a block.
    """
    call = F.concat(F.lit(" s"), F.col("l_suppkey"), F.lit("(q);"))
    line = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit(" if (q) {"), call, F.lit(" }"))).otherwise(call)
    inside = F.array_join(F.collect_list(F.when(F.col("l_linenumber") > 1, line)), "")
    outside = F.array_join(F.collect_list(F.when(F.col("l_linenumber") == 1, call)), "")
    n = caps.tasks(t("lineitem"), 200_000)
    code = t("lineitem").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("(int q) {"), inside, F.lit(" }"), outside).alias("code"))
    found = nesting.call_sites(code, "l_orderkey", "code")
    return found.repartition(n, "l_orderkey").groupBy("l_orderkey", "callee", "function").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT item_id * 100 + i AS pattern_id, trim(u) AS p FROM (SELECT item_id, unnest(string_split(text, '.')) AS u, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM benchmark))
SELECT pattern_id, doc_id FROM s JOIN documents ON contains(text, p) WHERE length(p) >= 20
""")
def sentences_in_documents(t):
    """JN-22: the documents that contain a sentence of a benchmark item."""
    parts = t("benchmark").select("item_id", F.posexplode(F.split("text", "[.]")).alias("i", "p")).select((F.col("item_id") * 100 + F.col("i")).alias("id"), F.trim("p").alias("p")).where("length(p) >= 20")
    found = contains.containing(t("documents"), "doc_id", "text", parts, "id", "p")
    return found.select("pattern_id", F.col("text_id").alias("doc_id"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, (epoch(o_orderdate) // 86400)::BIGINT AS d, date_trunc('day', o_orderdate)::DATE AS day, o_orderpriority FROM orders),
u AS (SELECT DISTINCT o_custkey, kind, s, e FROM (SELECT o_custkey, kind, (epoch(date_trunc(kind, day)) // 86400)::BIGINT AS s, (epoch(date_trunc(kind, day) + CASE kind WHEN 'year' THEN INTERVAL 1 YEAR WHEN 'quarter' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 MONTH END) // 86400 - 1)::BIGINT AS e FROM o, (SELECT unnest(['year', 'quarter', 'month']) AS kind) WHERE o_orderpriority = '1-URGENT'))
SELECT o_orderkey, count(s) AS level, arg_max(kind, s * 100000 - e) AS kind FROM o LEFT JOIN u ON o.o_custkey = u.o_custkey AND d BETWEEN s AND e GROUP BY o_orderkey
""")
def innermost_span(t):
    """JN-6, PL-4: each order within the narrowest of the year, quarter and month in which its customer had an urgent one."""
    o = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("day"), F.explode(F.array(*map(F.lit, ("year", "quarter", "month")))).alias("kind"))
    first = F.expr("to_date(date_trunc(kind, day))")
    after = F.expr("add_months(to_date(date_trunc(kind, day)), CASE kind WHEN 'year' THEN 12 WHEN 'quarter' THEN 3 ELSE 1 END)")
    spans = urgent.select("o_custkey", "kind", F.unix_date(first).cast("long").alias("s"), (F.unix_date(after) - 1).cast("long").alias("e")).distinct()
    points = o.select("o_custkey", "o_orderkey", F.unix_date("day").cast("long").alias("d"))
    return nesting.innermost(points, spans, "o_custkey", "d", "s", "e", "o_orderkey", ["kind"]).select("o_orderkey", "level", F.col("span_kind").alias("kind"))
