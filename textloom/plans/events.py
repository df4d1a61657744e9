"""Queries over events: as-of attribution, collapse, chains, dispatch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, chain, coverage, dedupe
from .registry import query


@query("""
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id AS view_id FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def asof_attribution(t):
    """Each purchase with the user's last view before it."""
    e = t("events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof.asof_backward(left, right, "user_id", "ts", "view_id", "view_id").select("event_id", "user_id", "view_id")


@query("""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events WHERE event_type = 'purchase'),
i AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 * (1 + event_id % 48) AS b FROM events WHERE event_type = 'view')
SELECT p.event_id, max(i.a) AS inner_start FROM p LEFT JOIN i ON p.user_id = i.user_id AND p.s BETWEEN i.a AND i.b GROUP BY p.event_id
""")
def enclosing_interval(t):
    """Each purchase with the innermost of the user's view intervals around it."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    points = t("events").where("event_type = 'purchase'").select("event_id", "user_id", s.alias("s"))
    spans = t("events").where("event_type = 'view'").select("user_id", s.alias("start"), (s + 3600 * (1 + F.col("event_id") % 48)).alias("end"))
    return asof.innermost_interval(points, spans, "user_id", "s", "event_id", 86400)


@query("""
SELECT user_id, event_type, bucket, count(DISTINCT run) AS runs_seen, round(count(DISTINCT run) / 5.0::DOUBLE, 4) AS run_fraction
FROM (SELECT user_id, event_type, floor(value / 10)::BIGINT AS bucket, day(ts) % 5 AS run FROM events) GROUP BY 1, 2, 3
""")
def run_fraction(t):
    """In what share of five runs a key was seen."""
    e = t("events").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("bucket"), (F.day("ts") % 5).alias("run"))
    return coverage.run_fraction(e, ["user_id", "event_type", "bucket"], "run", 5)


@query("""
SELECT user_id, count(*) AS n, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 OR count(*) FILTER (WHERE event_type = 'signup') > 20 THEN 'partial' ELSE 'ok' END AS outcome
FROM events GROUP BY user_id
""")
def failure_rollup(t):
    """Users by their failed units."""
    rolled = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"), F.count_if(F.col("event_type") == "signup").alias("s"))
    return rolled.select("user_id", "n", F.when(F.col("f") == F.col("n"), "failed").when((F.col("f") > 0) | (F.col("s") > 20), "partial").otherwise("ok").alias("outcome"))


@query("SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(t):
    """Histogram of a JSON property."""
    return t("events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


_CHAIN = """
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id || ':' || event_type AS payload FROM events),
c AS (SELECT user_id, seq, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS hash FROM e WHERE seq = 0
UNION ALL SELECT e.user_id, e.seq, e.payload, c.hash, sha256(c.hash || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
"""


def _chains(t):
    return chain.build(t("events"), "user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type")))


@query(_CHAIN + "SELECT user_id, seq, payload, prev_hash, hash FROM c")
def hash_chain_build(t):
    """Hash chains of each user's events."""
    return _chains(t)


@query(_CHAIN + "SELECT user_id, CASE WHEN max(seq) >= 5 THEN 5 END::BIGINT AS broken_at, CASE WHEN max(seq) >= 5 THEN 'bad hash' END AS error FROM c GROUP BY user_id")
def hash_chain_verify(t):
    """First error of chains whose sixth record was changed."""
    bad = _chains(t).withColumn("payload", F.when(F.col("seq") == 5, F.concat("payload", F.lit("?"))).otherwise(F.col("payload")))
    return chain.verify(bad, "user_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS s, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS rn FROM events),
c AS (SELECT user_id, event_type, rn, s AS anchor, event_id, true AS kept, s FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_type, e.rn, CASE WHEN e.s - c.anchor > 10800 THEN e.s ELSE c.anchor END, e.event_id, e.s - c.anchor > 10800, e.s FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.rn = c.rn + 1)
SELECT user_id, event_type, s, event_id FROM c WHERE kept
""")
def anchored_collapse(t):
    """Events of a kind within three hours of a kept one collapse into it."""
    e = t("events").select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "event_id")
    return dedupe.anchored_collapse(e, ["user_id", "event_type"], "s", 10_800, "event_id")


def route(kind, action):
    """Where an event goes, and why it is ignored."""
    to = F.when((kind == "signup") & action, "review").when((kind == "click") & action, "reply").otherwise("ignored")
    return to, F.when(to != "ignored", F.lit("")).when(kind.isin("signup", "click"), F.lit("not addressed")).otherwise(F.concat(F.lit("unhandled kind "), kind))


@query("""
WITH r AS (SELECT CASE WHEN event_type IN ('signup', 'click') AND json_extract(props, '$.k')::BIGINT % 2 = 0 THEN CASE event_type WHEN 'signup' THEN 'review' ELSE 'reply' END ELSE 'ignored' END AS route, event_type FROM events)
SELECT route, CASE WHEN route <> 'ignored' THEN '' WHEN event_type IN ('signup', 'click') THEN 'not addressed' ELSE 'unhandled kind ' || event_type END AS reason, count(*) AS n FROM r GROUP BY 1, 2
""")
def event_dispatch(t):
    """Routes of events and reasons for ignoring them."""
    to, why = route(F.col("event_type"), F.get_json_object("props", "$.k").cast("long") % 2 == 0)
    return t("events").select(to.alias("route"), why.alias("reason")).groupBy("route", "reason").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def seen_set_batch(t):
    """What a poller with a seen-set takes first of each key."""
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
