"""Retries under one deadline, as a stateful stream, and the same as a batch expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Longest wait between two tries, in seconds (fixed value); waits double up to it.
LONGEST_WAIT = 8
#: Shards of the keys, each with one state and one timer; fixed for a stream's life, as its state lies by shard.
SHARDS = 1024
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def wait_ms(tries: int, now: int, deadline: int) -> int:
    """Wait after so many failed tries: doubling, capped, and never past the deadline."""
    return min(min(2 ** (tries - 1), LONGEST_WAIT) * 1000, deadline - now)


class Retries(StatefulProcessor):
    """The items of one shard: each tried at its own time, then again by timers until it succeeds or its deadline comes.

    The first row of a key is the item, later ones are dropped, also once the
    item is done (the state holds the seen-set). The shard's timer stands at the
    next try of any of its items; when it fires it tries again without any new
    row, and tries that the clock has passed already are made up in one go, each
    at its own time. At the deadline no try is made: the item expires.

    State is read and written a shard at a time, as arrays: a call and a round
    trip for every key would cost far more than the tries.
    """

    def __init__(self, handle: Callable[[str, int], bool], budget_ms: int):
        self.handle, self.budget_ms = handle, budget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.seen = handle.getValueState("seen", "keys array<bigint>")
        self.open = handle.getValueState("open", "keys array<bigint>, payloads array<string>, deadlines array<bigint>, tries array<int>, nexts array<bigint>")

    def _go_on(self, items: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple]]:
        """Tries of items ``key, payload, deadline, tries, next`` that are due: what is over, and what stays open."""
        over, left = [], []
        for key, payload, deadline, tries, at in items:
            clock, outcome = max(at, watermark), None
            while at <= clock:
                if at >= deadline:
                    outcome = "expired"
                else:
                    tries += 1
                    if self.handle(payload, tries):
                        outcome = "done"
                if outcome:
                    over.append((key, tries, outcome, at))
                    break
                at += wait_ms(tries, at, deadline)
            else:
                left.append((key, payload, deadline, tries, at))
        return over, left

    def _held(self) -> list[tuple]:
        return list(zip(*self.open.get(), strict=True)) if self.open.exists() else []

    def _keep(self, items: list[tuple]) -> None:
        """Items that stay open, and the timer of the earliest of them; an older timer that still stands finds nothing due."""
        if items:
            self.open.update(tuple(map(list, zip(*items, strict=True))))
            self.timers.registerTimer(min(item[4] for item in items))
        else:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.seen.get()[0]) if self.seen.exists() else []
        met, first = set(known), {}
        for part in rows:
            for k, at, payload in zip(part["name"], part["at_ms"], part["payload"], strict=True):
                k, row = None if k is None else int(k), (int(at), payload)
                # nulls come after all payloads of their time
                if k not in met and (k not in first or _place(row) < _place(first[k])):
                    first[k] = row
        if first:
            self.seen.update((known + list(first),))
            over, left = self._go_on([(k, payload, at + self.budget_ms, 0, at) for k, (at, payload) in first.items()], timerValues.getCurrentWatermarkInMs())
            if left:
                self._keep(self._held() + left)
            yield _rows(over)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._held()
        due = [item for item in held if item[4] <= watermark]
        if due:
            over, left = self._go_on(due, watermark)
            self._keep([item for item in held if item[4] > watermark] + left)
            yield _rows(over)

    def close(self) -> None:
        pass


def _place(row: tuple) -> tuple:
    return row[0], row[1] is None, row[1] or ""


def _rows(over: list[tuple]) -> pd.DataFrame:
    key, tries, outcome, at = zip(*over, strict=True) if over else ((), (), (), ())
    return pd.DataFrame({"key": pd.array(key, "Int64"), "tries": pd.array(tries, "int32"), "outcome": pd.Series(outcome, dtype="object"), "at_ms": pd.array(at, "int64")})


def with_retries(stream: DataFrame, key: str, at: str, payload: str, handle: Callable[[str, int], bool], budget_s: int, delay: str = "0 seconds") -> DataFrame:
    """``key, tries, outcome (done, expired), at_ms`` of each item of a stream, once it is known.

    ``handle(payload, number of the try)`` tells whether a try succeeds; it may run again
    if a task is retried. Time is event time: timers fire as the watermark moves
    on, with or without rows. ``key`` is a long, ``at`` a timestamp.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    # a key's digits, as pandas would make floats of longs with a null among them
    rows = stream.select(F.col(key).cast("long").cast("string").alias("name"), F.col(at).cast("timestamp").alias("at"), F.col(payload).cast("string").alias("payload"))
    items = rows.withWatermark("at", delay).withColumns({"at_ms": F.unix_millis("at"), "shard": F.pmod(F.xxhash64("name"), F.lit(SHARDS))})
    return items.groupBy("shard").transformWithStateInPandas(statefulProcessor=Retries(handle, budget_s * 1000), outputStructType="key long, tries int, outcome string, at_ms long", outputMode="Append", timeMode="EventTime")


def retried(items: DataFrame, key: str, at_ms: str, failures: Column, budget_s: int) -> DataFrame:
    """What ``with_retries`` says of items that fail ``failures`` times, without state: a fold over the tries that the budget allows."""
    most = 5 + budget_s // LONGEST_WAIT
    budget = budget_s * 1000

    def step(s: Column, n: Column) -> Column:
        wait = F.least(F.least(F.pow(F.lit(2.0), n - 1), F.lit(float(LONGEST_WAIT))).cast("long") * 1000, F.lit(budget) - s["t"])
        over = s["over"] | (s["t"] >= budget) | (n > F.col("__failures"))
        tried = s["over"] | (s["t"] >= budget)
        return F.struct(F.when(over, s["t"]).otherwise(s["t"] + wait).alias("t"), F.when(tried, s["tries"]).otherwise(n).alias("tries"), over.alias("over"))

    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("tries"), F.lit(False).alias("over"))
    r = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    found = items.withColumn("__failures", failures).withColumn("__r", r)
    outcome = F.when(F.col("__r.t") >= budget, "expired").otherwise("done")
    return found.select(F.col(key).cast("long").alias("key"), F.col("__r.tries").alias("tries"), outcome.alias("outcome"), (F.col(at_ms) + F.col("__r.t")).alias("at_ms"))
