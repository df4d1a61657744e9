"""Folds over ordered rows whose state depends on all that came before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], out: str, step: Callable) -> DataFrame:
    """Each key's rows in order, run through ``step``; linear in time, with one state a task.

    ``step(state, row)`` takes the state (None before a key's first row) and the
    row's values after the keys, and returns the next state and a list of output
    rows (tuples after the keys). ``out`` is the schema after the keys. Rows
    come sorted (nulls first) in Arrow batches, and the state is carried from
    batch to batch, so a key of any size is never gathered. Null keys are one
    key; an empty table gives no rows.
    """
    n, names = len(keys), [f"__k{i}" for i in range(len(keys))]
    kept = df.select(*(F.col(k).alias(name) for k, name in zip(keys, names, strict=True)), *(c for c in df.columns if c not in keys))
    schema = ", ".join([f"`{name}` {kept.schema[name].dataType.simpleString()}" for name in names] + [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, wanted = None, None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found: list[tuple] = []
            for row in zip(*columns, strict=True):
                key = row[:n]
                if key != last:
                    last, state = key, None
                state, rows = step(state, *row[n:])
                found += [key + r for r in rows]
            if found:
                wanted = wanted or pa.schema([*(batch.schema.field(i) for i in range(n))])
                places = list(zip(*found, strict=True))
                arrays = [pa.array(v, wanted.field(i).type) if i < n else pa.array(v) for i, v in enumerate(places)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *outputs])

    outputs = [field.split()[0] for field in out.split(", ")]
    ordered = kept.repartition(*names).sortWithinPartitions(*names, *(F.asc_nulls_first(c) for c in order))
    return ordered.mapInArrow(run, schema).select(*(F.col(name).alias(k) for k, name in zip(keys, names, strict=True)), *outputs)
