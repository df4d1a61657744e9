"""Exact deduplication by progressive refinement, in DataFrame expressions.

Rows are equal if their texts are, once each run of white space is one space.
Three names refine one another: the text's length, the hash of its first
characters, the hash of all of it. A row whose length, or whose length and
beginning, nobody shares is a group of its own and is never hashed whole.

Which names are shared is told by a table of bits of fixed size (``SLOTS``), made
of counts by slot: two names in one slot only cost a hash that wasn't needed. The
table is broadcast, as its size doesn't depend on the data. So only names and
ids are shuffled, never texts; groups are counted by partial aggregates and go
back to their rows by a join that splits hot groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: Bits of a table of shared names: 512 KB, in 128 rows.
SLOTS = 1 << 22
#: Code points of the beginning.
PREFIX = 64
_BITS = 32768  # of one bitmap of Spark's bitmap functions


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shared(slots: DataFrame, name: str) -> DataFrame:
    """Bitmaps of the slots (column ``s``) that hold two rows or more: ``<name>_bucket, <name>_bits``, at most ``SLOTS / 32768`` rows."""
    many = slots.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    maps = many.groupBy(F.floor(F.col("s") / _BITS).alias(f"{name}_bucket")).agg(F.bitmap_construct_agg(F.col("s") % _BITS).alias(f"{name}_bits"))
    return F.broadcast(maps)


def _marked(df: DataFrame, slot: Column, bitmaps: DataFrame, name: str) -> DataFrame:
    """Adds ``<name>``: whether a row's slot is shared."""
    df = df.withColumn(f"{name}_slot", slot).join(bitmaps, F.floor(F.col(f"{name}_slot") / _BITS) == F.col(f"{name}_bucket"), "left")
    bit = f"getbit(cast(conv(hex(substring({name}_bits, cast({name}_slot % {_BITS} div 8 AS INT) + 1, 1)), 16, 10) AS INT), cast({name}_slot % 8 AS INT)) = 1"
    return df.withColumn(name, F.expr(f"coalesce({bit}, false)")).drop(f"{name}_slot", f"{name}_bucket", f"{name}_bits")


def deduplicate(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns ``carry`` of all rows (default: all), with ``keep_id``, ``group_size`` and ``kept``.

    The row with the smallest id of a group stays (rows without an id come
    last); of repeated rows with that id exactly one does. A null text counts as
    empty, and all empty texts are one group. Columns named like the three new
    ones are replaced. An empty table gives no rows.
    """
    out = [c for c in (docs.columns if carry is None else carry) if c not in ("keep_id", "group_size", "kept")]
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in out), F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__t"))
    size, start = F.length("__t").cast("long"), F.xxhash64(F.substring("__t", 1, PREFIX))
    by_size = lambda n: F.pmod(n, F.lit(SLOTS))
    by_start = lambda n, p: F.pmod(F.xxhash64(n, p), F.lit(SLOTS))
    facts = cut(rows.select(size.alias("n"), start.alias("p")))
    sizes = _shared(facts.select(by_size(F.col("n")).alias("s")), "__same_size")
    starts = _shared(_marked(facts, by_size(F.col("n")), sizes, "__same_size").where("__same_size").select(by_start(F.col("n"), F.col("p")).alias("s")), "__same_start")
    marked = _marked(_marked(rows, by_size(size), sizes, "__same_size"), by_start(size, start), starts, "__same_start")
    full = F.when(F.col("__same_size") & F.col("__same_start"), F.unhex(F.sha2("__t", 256))).alias("__full")
    named = written(marked.select(*(f"c_{c}" for c in out), "__id", full, F.monotonically_increasing_id().alias("__row")))
    groups = named.where("__full IS NOT NULL").groupBy("__full").agg(F.min(F.struct(F.isnull("__id").alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("best"), F.count("*").alias("n"))
    met = named.join(groups, "__full").select(*(f"c_{c}" for c in out), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("__row") == F.col("best.row")).alias("kept"))
    alone = named.where("__full IS NULL").select(*(f"c_{c}" for c in out), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return met.unionByName(alone).select(*(F.col(f"c_{c}").alias(c) for c in out), "keep_id", "group_size", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: one a document, dropped ones too."""
    named = docs.select("doc_id", "text", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return deduplicate(named, carry=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
