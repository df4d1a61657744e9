"""Composite queries: rule scan with repeated runs, review context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import coverage, dedupe, pack, rank
from .registry import query
from .texts import _TOK

#: Rules of the synthetic scan: name and what a line must hold.
RULES = {"credential": "password", "key": "AKIA", "licence": "icense"}
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule_id, i AS line, r AS run FROM l, runs WHERE contains(t, '{p}') AND (i + r) % 3 <> 0" for n, p in RULES.items())
_SCAN = f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
runs AS (SELECT unnest([0, 1, 2]) AS r), hits AS ({_HITS}),
e AS (SELECT doc_id, rule_id, line, row_number() OVER (PARTITION BY doc_id, rule_id ORDER BY line) AS rn FROM (SELECT DISTINCT doc_id, rule_id, line FROM hits)),
c AS (SELECT doc_id, rule_id, line, rn, line AS anchor, true AS kept FROM e WHERE rn = 1
UNION ALL SELECT e.doc_id, e.rule_id, e.line, e.rn, CASE WHEN e.line - c.anchor > 3 THEN e.line ELSE c.anchor END, e.line - c.anchor > 3 FROM c JOIN e ON e.doc_id = c.doc_id AND e.rule_id = c.rule_id AND e.rn = c.rn + 1),
f AS (SELECT doc_id, rule_id, line, count(DISTINCT run) AS runs_seen, round(count(DISTINCT run) / 3.0::DOUBLE, 4) AS run_fraction FROM hits GROUP BY ALL)
"""


def _scan(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("line", (F.col("i") + 1).cast("long"))
    rules = F.explode(F.array_compact(F.array(*(F.when(F.contains("t", F.lit(p)), F.lit(n)) for n, p in RULES.items())))).alias("rule_id")
    hits = lines.select("doc_id", "line", rules).select("doc_id", "rule_id", "line", F.explode(F.array(*map(F.lit, range(3)))).alias("run")).where((F.col("line") + F.col("run")) % 3 != 0)
    seen = coverage.run_fraction(hits, ["doc_id", "rule_id", "line"], "run", 3)
    kept = dedupe.anchored_collapse(seen.select("doc_id", "rule_id", "line", F.col("line").alias("at")), ["doc_id", "rule_id"], "line", 3, "at").select("doc_id", "rule_id", "line")
    return seen.join(kept, ["doc_id", "rule_id", "line"], "left_semi")


@query(_SCAN + "SELECT doc_id, rule_id, line, runs_seen, run_fraction FROM f JOIN c USING (doc_id, rule_id, line) WHERE kept AND run_fraction >= 0.5::DOUBLE")
def scan_pipeline(t):
    """Findings of three runs: collapsed on anchors, with the runs that saw them, above a threshold."""
    return _scan(t).where("run_fraction >= 0.5D")


@query(_SCAN + "SELECT rule_id, count(*) FILTER (WHERE run_fraction < 1.0::DOUBLE) AS removed, count(*) AS findings FROM f JOIN c USING (doc_id, rule_id, line) WHERE kept GROUP BY rule_id")
def scan_filtered_counts(t):
    """What a threshold of one would remove, by rule."""
    return _scan(t).groupBy("rule_id").agg(F.count_if(F.col("run_fraction") < 1.0).alias("removed"), F.count("*").alias("findings"))


_REVIEW = r"""
WITH d AS (SELECT source || '/' || lang || '_' || doc_id AS path, text AS body FROM documents),
t AS (SELECT unnest(['license', 'token']) AS t),
x AS (SELECT path, body, t, lower(path || ' ' || body || ' ') AS h, regexp_extract_all(lower(split_part(path, '/', -1)), '[A-Za-z0-9_]+') AS stem FROM d, t),
c AS (SELECT path, t, (length(h) - length(replace(h, t, ''))) / length(t) AS c, list_contains(stem, t) AS s FROM x),
f AS (SELECT t, ln(1 + (count(*) - count(*) FILTER (WHERE c > 0) + 0.5::DOUBLE) / (count(*) FILTER (WHERE c > 0) + 0.5::DOUBLE)) AS w FROM c GROUP BY t),
s AS (SELECT path, round(sum(CASE WHEN c > 0 THEN (1 + ln(c)) * w ELSE 0 END + CASE WHEN s THEN 25 * w ELSE 0 END) + CASE WHEN path IN ('src3/en_3', 'src7/en_7') THEN 1000 ELSE 0 END, 6) AS score FROM c JOIN f USING (t) GROUP BY path),
k AS (SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 60),
b AS (SELECT k.path, k.score, """ + _TOK.format(t="body") + r""" AS tokens FROM k JOIN d USING (path)),
r AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM b)
SELECT path, score, tokens, running, running <= 6000 AS fits FROM r WHERE running - tokens <= 6000
"""  # fmt: skip


@query(_REVIEW)
def review_pipeline(t):
    """Context of a review: changed files first, then relevant ones, within a token budget."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"))
    top = rank.relevance_rank(t("documents"), path, F.col("text"), "license token", extra=["src3/en_3", "src7/en_7"]).orderBy(F.desc("score"), "path").limit(60)
    blocks = t("documents").select(path.alias("path"), fx.token_estimate(F.col("text")).alias("tokens")).join(F.broadcast(top), "path")  # 60 rows
    return pack.budget_pack(blocks, [F.desc("score"), F.asc("path")], "tokens", 6000, most=60).select("path", "score", "tokens", "running", "fits")
