"""Retries by timers, and the report sink's commit and abort."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.sources import report
from textloom.streaming import retry


def test_items_come_back_without_new_rows(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    ticks = [
        [(1, at(0), "2"), (2, at(0), "0"), (1, at(0), "9"), (3, at(1), "99")],  # a key's first row is its item
        [(4, at(5), "0")],  # moves the clock: item 1 succeeds at second 3
        [(1, at(20), "0"), (5, at(30), "0"), (None, at(30), "0")],  # item 1 is done already; item 3's deadline has passed
    ]
    fails = lambda payload, tries: tries > int(payload)
    got = []
    for n, rows in enumerate(ticks):
        df = spark.createDataFrame(rows, "k long, at string, p string").select("k", F.to_timestamp("at").alias("at"), "p")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = retry.with_retries(stream, "k", "at", "p", fails, 20)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        seen = {(r.key, r.tries, r.outcome, r.at_ms // 1000 % 60) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
        got.append(seen - set().union(*got))
    assert got == [{(2, 1, "done", 0)}, {(1, 3, "done", 3), (4, 1, "done", 5)}, {(3, 5, "expired", 21), (5, 1, "done", 30), (None, 1, "done", 30)}]


class Kept:
    """A value state and a timer service, counted."""

    def __init__(self, log):
        self.log, self.value = log, None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.log.append("update")
        self.value = value

    def clear(self):
        self.value = None


def test_keys_of_a_shard_share_one_call_and_one_timer():
    log, timers = [], []

    class Handle:
        def getValueState(self, name, schema):
            return Kept(log)

        def registerTimer(self, at):
            timers.append(at)

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = lambda: now

    p = retry.Retries(lambda payload, tries: tries > int(payload), 20_000)
    p.init(Handle())
    n, big = 500, 2**60 + 1
    rows = pd.DataFrame({"name": [*map(str, range(n)), str(big), None], "at_ms": [0] * n + [5, 7], "payload": [str(k % 3) for k in range(n)] + ["0", "9"]})
    tuples = lambda parts: [(None if pd.isna(r.key) else int(r.key), r.tries, r.outcome, r.at_ms) for part in parts for r in part.itertuples()]
    got = set(tuples(p.handleInputRows((0,), iter([rows[:200], rows[200:]]), Clock(0))))
    assert got == {(k, 1, "done", 0) for k in range(0, n, 3)} | {(big, 1, "done", 5)}
    assert timers == [1000] and len(log) == 2
    got = set(tuples(p.handleExpiredTimer((0,), Clock(1000), None)))
    assert got == {(k, 2, "done", 1000) for k in range(1, n, 3)} and timers == [1000, 1007]
    assert not tuples(p.handleInputRows((0,), iter([rows]), Clock(1000)))
    got = set(tuples(p.handleExpiredTimer((0,), Clock(30_000), None)))
    assert got == {(k, 3, "done", 3000) for k in range(2, n, 3)} | {(None, 5, "expired", 20_007)}


@pytest.mark.parametrize("budget", [1, 2, 7, 8, 20, 60])
def test_batch_and_waits_agree(spark, budget):
    want = []
    for n in range(12):
        tries, at, deadline = 0, 0, budget * 1000
        while at < deadline:
            tries += 1
            if tries > n:
                break
            at += retry.wait_ms(tries, at, deadline)
        want.append((n, tries, "expired" if at >= deadline else "done", at))
    items = spark.createDataFrame([(n, 0) for n in range(12)], "k long, at long")
    assert sorted(tuple(r) for r in retry.retried(items, "k", "at", F.col("k").cast("int"), budget).collect()) == want


def lines(spark, n, bad=None):
    value = F.concat(F.lit("line "), F.col("id"))
    if bad is not None:
        value = F.when(F.col("id") == bad, F.raise_error(F.lit("no"))).otherwise(value)
    return spark.range(n).select((F.col("id") % 3).cast("int").alias("section"), F.col("id").alias("ord"), value.alias("line"))


def test_a_report_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "r")
    report.write_report(lines(spark, 100), path)
    want = [f"line {i}" for s in range(3) for i in range(s, 100, 3)]
    shown = report.read_report(spark, path).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in shown] == list(enumerate(want, 1))
    manifest = json.load(open(f"{path}/manifest.json"))
    assert len(manifest["parts"]) > 1 and {f for f in os.listdir(path) if not f.startswith(".")} == {"manifest.json", *(p["name"] for p in manifest["parts"])}
    with pytest.raises(Exception, match="no"):
        report.write_report(lines(spark, 50, bad=31), path)
    assert [r.line for r in report.read_report(spark, path).orderBy("pos").collect()] == want
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == len(manifest["parts"])
    report.write_report(lines(spark, 2), path, mode="append")
    assert [r.line for r in report.read_report(spark, path).orderBy("pos").collect()] == [*want, "line 0", "line 1"]
    report.write_report(lines(spark, 2), path)
    assert report.read_report(spark, path).count() == 2 and len([f for f in os.listdir(path) if f.startswith("part-")]) <= 2
    report.write_report(lines(spark, 0), path)
    assert report.read_report(spark, path).count() == 0


def test_forms_of_a_report(spark):
    found = spark.createDataFrame([("high", 1, "a.c"), ("odd", 2, "b.c"), ("high", 3, None)], "severity string, n long, file string")
    shown = lambda form: [r.line for r in report.finding_lines(found, ("critical", "high"), "severity", "n", F.col("file"), "Scan", form).orderBy("section", "ord").collect()]
    assert shown("markdown") == ["# Scan", "", "3 findings", "", "## High (2)", "", "- a.c", None, "", "## Odd (1)", "", "- b.c"]
    assert shown("rst") == ["Scan", "====", "", "3 findings", "", "High (2)", "--------", "", "- a.c", None, "", "Odd (1)", "-------", "", "- b.c"]
    assert [json.loads(x) for x in shown("json")] == [{"severity": "high", "n": 1, "file": "a.c"}, {"severity": "high", "n": 3}, {"severity": "odd", "n": 2, "file": "b.c"}]
