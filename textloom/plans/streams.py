"""Streams and sinks over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import report
from ..streaming import retry
from .registry import query

BUDGET = 20
_TIMES = (0, 1, 3, 7, 15)  # seconds at which tries are made within the budget


def _succeeds(payload: str, tries: int) -> bool:
    """An event whose number is k fails k % 8 times."""
    return tries > int(payload) % 8


_RETRIED = f"""
WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, json_extract_string(props, '$.k')::INT % 8 AS f FROM events),
r AS (SELECT event_id, t, CASE WHEN f < {len(_TIMES)} THEN f + 1 ELSE {len(_TIMES)} END::INT AS tries, CASE WHEN f < {len(_TIMES)} THEN 'done' ELSE 'expired' END AS outcome,
t + 1000 * CASE f {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(_TIMES))} ELSE {BUDGET} END AS at_ms FROM e)
SELECT event_id, tries, outcome, at_ms::BIGINT AS at_ms FROM r"""


@query(_RETRIED)
def retried_batch(t):
    """SM-7: tries and outcome of each event under a deadline of twenty seconds."""
    e = t("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return retry.retried(e, "event_id", "t", F.col("k") % 8, BUDGET).withColumnRenamed("key", "event_id")


@query(_RETRIED + " WHERE tries = 1 AND outcome = 'done' OR at_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events)")
def retried_stream(t):
    """SM-3, SM-7: the same by timers of a stream, for what is over when the stream's clock stops."""
    events = t("events")
    spark, folder = events.sparkSession, f"{shared_folder(events.sparkSession)}/retries-{uuid.uuid4().hex}"
    files = [f.rpartition("/") for f in events.inputFiles()]
    # a stream reads folders: of a table in one file that of all tables, by name
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", files[0][2] if len(files) == 1 else "*.parquet").parquet(files[0][0])
    items = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("k"))
    found = retry.with_retries(items, "event_id", "ts", "k", _succeeds, BUDGET)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows").withColumnRenamed("key", "event_id")


_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query(f"""
WITH f AS (SELECT o_orderkey, o_orderpriority, coalesce(nullif(list_position({list(_LEVELS)}, o_orderpriority), 0), {len(_LEVELS) + 1}) AS section, '- order ' || o_orderkey || ' of customer ' || o_custkey || ': ' || o_orderstatus AS line FROM orders),
s AS (SELECT section, count(*) AS n, min(o_orderpriority) AS p FROM f GROUP BY section),
h AS (SELECT section, upper(p[1]) || lower(p[2:]) || ' (' || n || ')' AS heading FROM s),
l AS (SELECT 0 AS section, 0 AS ord, '# Orders' AS line UNION ALL SELECT 0, 1, '' UNION ALL SELECT 0, 2, (SELECT count(*) FROM orders) || ' findings'
UNION ALL SELECT section, -2, '' FROM h UNION ALL SELECT section, -1, '## ' || heading FROM h UNION ALL SELECT section, 0, '' FROM h
UNION ALL SELECT section, o_orderkey + 1, line FROM f)
SELECT row_number() OVER (ORDER BY section, ord) AS pos, CASE WHEN starts_with(line, '## 4') THEN '## 4-not Specified' || line[19:] ELSE line END AS line FROM l
""")
def report_sink(t):
    """SK-7, SK-10: a report of all orders by priority, written by many tasks, committed by one manifest and read again."""
    o = t("orders")
    spark = o.sparkSession
    item = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of customer "), F.col("o_custkey"), F.lit(": "), F.col("o_orderstatus"))
    lines = report.finding_lines(o.withColumn("place", F.col("o_orderkey") + 1), _LEVELS, "o_orderpriority", "place", item, "Orders")
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.write_report(lines, path)
    return report.read_report(spark, path)
