"""Shared helpers of the training-data operators: reading, checkpoints, rolling hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
DEFAULT_TOKENIZERS = "/opt/tokenizers"
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a vocabulary file lies: in ``folder``, else in the installed package."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = DEFAULT_TOKENIZERS
    return os.path.join(folder, name)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_ROOT])


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it; a local one only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder: lost executors then cost no recomputation of what came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: smaller than a checkpoint for whole texts."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_key() -> list:
    """128 bits that name a text: two seeded 64-bit hashes. A null text counts as empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t, F.lit(11)).alias("k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numpy


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kgram_hash(symbols: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hash (odd base, modulo 2^64) of each window of k symbols, built by doubling."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, done, span, power = None, 0, 1, base
    while True:
        if k & span:
            out = h[:n].copy() if out is None else out * np.uint64(power) + h[done : done + n]
            done += span
        if span * 2 > k:
            return mix64(out)
        h = h[:-span] * np.uint64(power) + h[span:]
        span *= 2
        power = power * power & 0xFFFFFFFFFFFFFFFF


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w entries; empty if there is none."""
    if len(a) < w:
        return a[:0]
    m, span = a, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if span < w else m


class Memo(dict):
    """A bounded memo: ``make`` fills misses; once it holds ``limit`` entries it takes no more."""

    def __init__(self, make: Callable, limit: int = 500_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __reduce__(self):  # a copy elsewhere starts empty
        return Memo, (self.make, self.limit)

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


#: White space other than the space and the line feed (fixed values: Unicode's White_Space, and the four separators that str.split adds).
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RARE_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def odd_space(text: str) -> bool:
    """Whether white space is anything but single spaces and line feeds between other characters."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return True
    return any(map(text.__contains__, _RARE_ASCII)) or not text.isascii() and any(map(text.__contains__, _RARE_WIDE))
