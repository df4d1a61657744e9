"""Repair of conversations by shortest paths through an edit lattice.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Each row
is kept, given another role or deleted, and rows may be inserted; Dijkstra's
search runs on the implicit lattice of (rows consumed, grammar state) with the
priority (cost, audit), where the audit is the string of edits so far, and stops
at the first end node popped that the grammar accepts. As zero-cost edges only
lengthen an audit, priorities never fall; audits of one cost into one node
consume the same rows, so none is a beginning of another and the least one stays
least whatever follows.

That property also lets a long conversation be searched in blocks of ``BLOCK``
rows: each block yields its least (cost, audit) from each grammar state to each
other, in tasks of their own, and a pass over a conversation's blocks joins
them. Rows are placed by ranges and carry codes of one character; texts meet the
edits again in one pass that streams rows in order, so no conversation is ever
gathered.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions, written

#: Costs of edits (fixed values); a row that isn't deleted though its text is cut off costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block.
BLOCK = 512
#: Grammar states: nothing yet, after s, after u, after a. Which role comes next but for an s at the start; where a kept role leads.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
KEEP = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
ACCEPTED = (START, AFTER_A)
ROLES = {"u": "user", "a": "assistant"}
_WHITE = r"\x20\x09-\x0D"
_TRIM = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def shortest(codes: str, state: int, accepted_only: bool) -> list[tuple[int, int, str]]:
    """Least ``(end state, cost, audit)`` from ``state`` over rows of ``codes``: of the first accepted end, or of every end state.

    A code is the initial of a role, in upper case if the row's text is cut
    off, or ``-`` for a row that must go.
    """
    n, heap, done, ends = len(codes), [(0, "", 0, state)], set(), []
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n and (not accepted_only or state in ACCEPTED):
            ends.append((state, cost, audit))
            if accepted_only or len(ends) == len(NEXT):
                break
        steps = [(INSERT, "I", at, NEXT[state][1])]
        if at < n:
            code = codes[at]
            steps.append((DELETE, "D", at + 1, state))
            if code != "-":
                more = TRUNCATED if code.isupper() else 0
                steps.append((REROLE + more, "R", at + 1, NEXT[state][1]))
                if (code.lower(), state) in KEEP:
                    steps.append((more, "K", at + 1, KEEP[code.lower(), state]))
        for price, edit, then, follows in steps:
            if (then, follows) not in done:
                heapq.heappush(heap, (cost + price, audit + edit, then, follows))
    return ends


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, last, codes`` to ``paths`` (from state, to state, cost, audit), other columns kept."""
    for batch in batches:
        rows = []
        for block, last, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "last", "codes")), strict=True):
            rows.append([{"f": f, "t": t, "cost": cost, "audit": audit} for f in (NEXT if block else (START,)) for t, cost, audit in shortest(codes, f, last)])
        kind = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(rows, kind)], ["conv", "block", "paths"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one row a conversation: ``conv, cost, audit``."""
    conv, known, out, fresh = None, {}, [], True

    def close() -> None:
        if not fresh:
            cost, audit = min(known[s] for s in ACCEPTED if s in known)
            out.append((conv, cost, audit))

    for batch in batches:
        for key, block, paths in zip(*(batch.column(c).to_pylist() for c in ("conv", "block", "paths")), strict=True):
            if block == 0:
                close()
                conv, known, fresh = key, {START: (0, "")}, False
            then: dict[int, tuple[int, str]] = {}
            for p in paths:
                if p["f"] in known:
                    cost, audit = known[p["f"]]
                    reached = (cost + p["cost"], audit + p["audit"])
                    then[p["t"]] = min(then.get(p["t"], reached), reached)
            known = then
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv", "cost", "audit"])
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv", "cost", "audit"])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit (place 0), then the conversation's rows in order, to repaired rows; memory holds one audit."""
    names, kinds = ["conv_id", "pos", "role", "text", "edit"], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    conv, audit, at, state, pos = None, "", 0, START, 0
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, state, pos
        while at < len(audit) and audit[at] == "I":
            role, state = NEXT[state]
            pos, at = pos + 1, at + 1
            out.append((conv, pos, ROLES[role], "", "I"))

    for batch in batches:
        for key, place, role, text, edits in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text", "audit")), strict=True):
            if place == 0:
                conv, audit, at, state, pos = key, edits, 0, START, 0
                inserts()
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                own, then = NEXT[state]
                role, state = (ROLES[own], then) if edit == "R" else (role, KEEP[role[:1], state])
                pos += 1
                out.append((conv, pos, role, text, edit))
            inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows in order to ``conv, repaired_sha256``; memory holds one hash."""
    state, conv = None, None
    for batch in batches:
        out = []
        for key, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")), strict=True):
            if pos == 1:
                if state is not None:
                    out.append((conv, state.hexdigest()))
                state, conv = hashlib.sha256(), key
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])


def faulty(turns: DataFrame) -> DataFrame:
    """Rows with their ``place`` in the conversation and ``fault`` (blank, duplicate, truncated or null): ``conv, turn, role, text, place, fault``.

    Order is by turn (nulls first), then role, then a hash of the text, so that
    repeated rows lie together. Rows are dealt by ranges of that order; a place
    is that within the range plus the sizes of the conversation's ranges before.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(5), "text", F.lit(3), "role")})
    order = [F.asc("turn"), F.asc("role"), F.asc("a"), F.asc("b")]
    dealt = written(rows.repartitionByRange(partitions(turns.sparkSession), F.asc("conv"), *order).sortWithinPartitions(F.asc("conv"), *order).withColumn("part", F.spark_partition_id()))
    by_part = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv", "part").agg(F.count("*").alias("n")).select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) + F.col("before")
    placed = dealt.join(before, dealt["conv"].eqNullSafe(before["c"]) & (dealt["part"] == before["p"])).withColumn("place", place.cast("long"))
    first = placed.groupBy("conv", "a", "b").agg(F.min("place").alias("first")).select(F.col("conv").alias("c2"), F.col("a").alias("a2"), F.col("b").alias("b2"), "first")
    joined = placed.join(first, placed["conv"].eqNullSafe(first["c2"]) & (placed["a"] == first["a2"]) & (placed["b"] == first["b2"]))
    fault = (
        F.when(~F.col("text").rlike(rf"[^{_WHITE}]"), "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.expr(f"right(trim(TRAILING {_TRIM} FROM text), 1) IN ('.', '!', '?')"), "truncated")
    )
    return joined.select("conv", "turn", "role", "text", "place", fault.alias("fault"))


def edits(rows: DataFrame) -> DataFrame:
    """Cheapest edits of each conversation of ``faulty`` rows: ``conv, cost, audit, illegal``."""
    spark = rows.sparkSession
    initial = F.coalesce(F.nullif(F.substring("role", 1, 1), F.lit("")), F.lit("0"))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    narrow = rows.select("conv", F.floor((F.col("place") - 1) / BLOCK).alias("block"), F.struct("place", known.alias("i"), code.alias("c")).alias("r"))
    blocks = narrow.groupBy("conv", "block").agg(F.array_sort(F.collect_list("r")).alias("r"))  # at most BLOCK rows of three characters
    in_order = Window.partitionBy("conv").orderBy("block")
    blocks = blocks.select("conv", "block", F.array_join("r.c", "").alias("codes"), F.array_join("r.i", "").alias("initials"))
    blocks = written(blocks.withColumns({"last": F.lead("block").over(in_order).isNull(), "joint": F.concat(F.coalesce(F.lag(F.substring("initials", -1, 1)).over(in_order), F.lit("")), "initials")}))
    pairs = F.expr("size(filter(sequence(1, greatest(1, length(joint) - 1)), i -> length(joint) > 1 AND substr(joint, i, 2) NOT IN ('su', 'ua', 'au')))")
    illegal = blocks.groupBy("conv").agg(F.sum(pairs).cast("long").alias("illegal")).withColumnRenamed("conv", "c")
    paths = arrow_map(blocks.select("conv", "block", "last", "codes"), _paths, "conv long, block long, paths array<struct<f: int, t: int, cost: long, audit: string>>")
    ordered = paths.repartition(partitions(spark), "conv").sortWithinPartitions("conv", "block")
    cheapest = arrow_map(ordered, _joined, "conv long, cost long, audit string")
    return cheapest.join(illegal, cheapest["conv"].eqNullSafe(illegal["c"])).drop("c")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired conversations: ``conv_id, pos, role, text, edit``; in order within a partition that holds whole conversations."""
    heads = found.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = heads.unionByName(rows.select("conv", "place", "role", "text", F.lit(None).cast("string").alias("audit")))
    ordered = both.repartition(partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "place")
    return arrow_map(ordered, _applied, "conv_id long, pos long, role string, text string, edit string")


def repair(turns: DataFrame) -> DataFrame:
    """Repaired conversations as rows ``conv_id, pos, role, text, edit`` (K kept, R other role, I inserted).

    Null roles and texts count as one space, a null turn comes first, rows
    without a conversation id are one conversation. Repeated rows are faults
    like any other; a conversation whose rows all go gives no rows, nor does
    an empty table. Other columns are ignored.
    """
    rows = written(faulty(turns))
    return repaired(rows, edits(rows))


def reports(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``: faults, cost, audit and hash of what ``turns`` become."""
    rows = written(faulty(turns))
    found = written(edits(rows))
    hashes = arrow_map(repaired(rows, found), _hashed, "conv long, repaired_sha256 string")
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for i, part in enumerate((rows.groupBy("conv").agg(gaps, count("blank"), count("duplicate"), count("truncated")), found, hashes)):
        out = out.join(part.withColumnRenamed("conv", f"k{i}"), F.col("conv_id").eqNullSafe(F.col(f"k{i}")), "left").drop(f"k{i}")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by the checksum of ``conv_id:turn``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("h <> 0").select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.expr("IF(h = 3, array(1, 2), array(1))")).alias("copy"))
    return rows.drop("copy")
