"""Winnowing: document fingerprints with a match guarantee.

Every k-gram of code points is hashed; of each window of w consecutive hashes
the smallest is chosen, the rightmost on ties, and its position is kept. Two
texts that share a passage of k+w-1 characters share a chosen hash of it.

To compare each document with its successor (descending id) and with an edit
made from it, texts are dealt to buckets by id ranges taken from quantiles, the
first row of a bucket also going to the end of the bucket before it. Rows then
meet their successor in a sorted stream: one shuffle, of compressed texts, and
no window over the whole table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kgram_hash, partitions, sliding_min

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SPAN = 1 << 23  # windows that are looked at together: positions among them have a fixed width beside the hashes


def winnow(text: str, k: int = 16, window: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's fingerprint, in text order.

    A text shorter than k is one gram; one with fewer than ``window`` grams has
    one window. An empty text has no fingerprint.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(points))
    window = min(window, len(points) - k + 1)
    low, hashes, places = np.uint64(2 * SPAN - 1), [], []
    for at in range(0, len(points) - k - window + 2, SPAN):
        h = kgram_hash(points[at : at + SPAN + window + k - 2], k)
        where = low - np.arange(len(h), dtype=np.uint64)  # a later position is smaller: rightmost on ties
        least = sliding_min((h & ~low) | where, window)
        chosen = (low - (least[np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))] & low)).astype(np.int64)
        if places and places[-1][-1] == at + chosen[0]:
            chosen = chosen[1:]
        if len(chosen):
            hashes.append(h[chosen])
            places.append(at + chosen)
    return np.concatenate(hashes), np.concatenate(places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hash sets; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def show(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash@position`` of each choice."""
    return " ".join([f"{h:x}@{p}" for h, p in zip(fp[0].tolist(), fp[1].tolist(), strict=True)])


def edit(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, k: int = 16, window: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint documents, their edits, and their likeness to edit and successor.

    One row per input row. Null texts count as empty. Equal ids follow each
    other in the order of their texts' digests; null ids come after all others;
    the last is followed by the first (a single row by itself). Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    n = partitions(spark)
    #: Bounds are ids of the table, so each bucket's largest id is known without a further pass.
    bounds = sorted({int(b) for b in rows.where("doc_id is not null").approxQuantile("doc_id", [i / (4 * n) for i in range(1, 4 * n)] + [1.0], 1 / (16 * n))}) if n else []
    highest = rows.agg(F.max("doc_id")).first()[0]
    if highest is not None and (not bounds or bounds[-1] != highest):
        bounds.append(highest)
    edges = np.asarray(bounds, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                digest, z = hashlib.md5(raw, usedforsecurity=False).digest(), squeeze(raw)
                bucket = int(np.searchsorted(edges, doc)) if doc is not None else 0
                to = [(bucket, False)]
                if doc is not None and doc == bounds[bucket]:
                    to.append(((bucket + 1) % len(bounds), True))
                elif not bounds:
                    to.append((0, True))
                for b, extra in to:
                    for col, v in zip(out, (b, extra, doc, digest, z), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], names=["bucket", "extra", "doc_id", "digest", "z"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        waiting = None  # a row whose successor hasn't come: bucket, id, text, fingerprint
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                for bucket, extra, doc, z in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    if extra and (waiting is None or waiting[0] != bucket):
                        continue  # the bucket is full of successors already, or has no rows of its own
                    text = expand(z).decode("utf-8", "surrogatepass")
                    fp = winnow(text, k, window)
                    if waiting is not None and waiting[0] == bucket:
                        _, d, t, f = waiting
                        edited = edit(t, text)
                        g = winnow(edited, k, window)
                        out.append((d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), show(f), show(g), likeness(f[0], g[0]), likeness(f[0], fp[0])))
                    waiting = None if extra else (bucket, doc, text, fp)
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    dealt = arrow_map(rows, deal, "bucket int, extra boolean, doc_id long, digest binary, z binary")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "digest")
    return arrow_map(ordered, meet, SCHEMA)
