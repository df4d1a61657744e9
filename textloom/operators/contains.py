"""Which texts contain which patterns: an automaton over arrays, or equality of grams.

While the patterns' automaton fits ``TABLE_BYTES`` it is built once as a dense
table (state by class of byte) and shipped to the tasks, which run it over many
pieces of texts in step, one byte of each at a time. Larger sets of patterns are
met by equality: of the grams of a pattern's first window the one with the least
hash is emitted, of a text the least gram of every window, so a text that holds
the pattern emits the pattern's gram; what meets is verified on the text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest automaton that is shipped to tasks, in bytes of its table; texts of patterns that are read to the driver to build it.
TABLE_BYTES, PATTERN_BYTES = 64 << 20, 4 << 20
#: Bytes of a piece, and pieces that run in step.
PIECE, STEP = 4096, 4096
#: Bytes of a gram, and grams of a window.
GRAM, WINDOW = 8, 8


class Automaton:
    """Deterministic automaton of all patterns: ``table[state, class of byte]``, and for each state the patterns that end there."""

    def __init__(self, patterns: list[bytes]):
        self.longest = max(map(len, patterns), default=0)
        used = sorted({b for p in patterns for b in p})
        self.classes = np.zeros(256, np.uint8 if len(used) < 255 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = {}
        for number, pattern in enumerate(patterns):
            state = 0
            for c in self.classes[list(pattern)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                state = children[state][c]
            ends.setdefault(state, []).append(number)
        self.table = np.zeros((len(children), len(used) + 1), np.int32)
        fail, self.found = [0] * len(children), {s: tuple(n) for s, n in ends.items()}
        queue = deque(children[0].values())
        for c, s in children[0].items():
            self.table[0, c] = s
        while queue:
            s = queue.popleft()
            # a missing edge leads where the longest proper ending leads
            self.table[s] = self.table[fail[s]]
            for c, child in children[s].items():
                fail[child] = int(self.table[fail[s], c])
                self.table[s, c] = child
                queue.append(child)
            if more := self.found.get(fail[s]):
                self.found[s] = self.found.get(s, ()) + more
        self.ending = np.zeros(len(children), bool)
        self.ending[list(self.found)] = True

    def search(self, texts: list[bytes]) -> set[tuple[int, int]]:
        """Pairs (number of text, number of pattern)."""
        if not self.longest:
            return set()
        warm = self.longest - 1  # bytes before a piece, whose matches belong to the piece before
        starts = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), PIECE)]
        out: set[tuple[int, int]] = set()
        for first in range(0, len(starts), STEP):
            part = sorted(starts[first : first + STEP], key=lambda s: s[1] - min(len(texts[s[0]]), s[1] + PIECE) - min(warm, s[1]))  # longest first
            before = np.array([min(warm, a) for _, a in part])
            pieces = [texts[i][max(0, a - warm) : a + PIECE] for i, a in part]
            sizes = np.array([len(p) for p in pieces])
            flat = self.classes[np.frombuffer(b"".join(pieces), np.uint8)]
            at = np.cumsum(sizes) - sizes
            live = len(part) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1)) if len(part) else []
            state, hits = np.zeros(len(part), np.int32), []
            for j, n in enumerate(live):
                state = self.table[state[:n], flat[at[:n] + j]]
                hit = np.flatnonzero(self.ending[state] & (before[:n] <= j))
                if len(hit):
                    hits.append(np.stack([hit, state[hit]]))
            if hits:
                for p, s in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
                    out.update((part[p][0], number) for number in self.found[s])
        return out


def _grams(text: bytes, first_only: bool) -> np.ndarray:
    """Least hashes of the grams of each window, or of the first window alone."""
    b = np.frombuffer(text[: GRAM + WINDOW - 1] if first_only else text, np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ b[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1))


def _by_automaton(texts: DataFrame, patterns: list[tuple[int, bytes]]) -> DataFrame:
    machine, numbers = Automaton([p for _, p in patterns]), [n for n, _ in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            pairs = sorted(machine.search([t or b"" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([numbers[p] for _, p in pairs], pa.int64())], ["text_id", "pattern_id"])

    return texts.mapInArrow(run, "text_id long, pattern_id long")


def _by_grams(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    def emit(first_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = [_grams(t or b"", first_only) for t in batch.column(1).to_pylist()]
                sizes = [len(g) for g in grams]
                ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*grams, np.empty(0, np.uint64)]).view(np.int64))], ["id", "gram"])

        return run

    asked = patterns.mapInArrow(emit(True), "id long, gram long").select(F.col("id").alias("pattern_id"), "gram")
    met = texts.mapInArrow(emit(False), "id long, gram long").join(asked, "gram").select(F.col("id").alias("text_id"), "pattern_id").distinct()
    both = met.join(texts.toDF("text_id", "text"), "text_id").join(patterns.toDF("pattern_id", "pattern"), "pattern_id")
    return both.where(F.contains("text", F.col("pattern"))).select("text_id", "pattern_id")


def containing(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str, table_bytes: int = TABLE_BYTES, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Distinct ``text_id, pattern_id`` (longs): each pattern with the texts that contain it.

    Comparison is by bytes of UTF-8. Empty and null patterns are in no text, nor
    does a null text hold any. Rows without an id are left out. Sets of patterns
    beyond the limits are met by equality of grams; of these, patterns shorter
    than a window run through automata in blocks within the limits.
    """
    t = texts.select(F.col(text_id).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("b")).where("id IS NOT NULL AND b IS NOT NULL")
    p = patterns.select(F.col(pattern_id).cast("long").alias("id"), F.col(pattern).cast("string").cast("binary").alias("b")).where("id IS NOT NULL AND octet_length(b) > 0").distinct()
    # states are bytes of patterns at most, classes 257
    most = min(pattern_bytes, table_bytes // (4 * 257))
    size = p.agg(F.coalesce(F.sum(F.octet_length("b")), F.lit(0))).first()[0]
    if size <= most:
        return _by_automaton(t, [(n, bytes(b)) for n, b in p.collect()]).distinct()
    least = GRAM + WINDOW - 1
    found = _by_grams(t, p.where(F.octet_length("b") >= least))
    block, held = [], 0
    for n, b in p.where(F.octet_length("b") < least).toLocalIterator():
        if held + len(b) > most and block:
            found, block, held = found.union(_by_automaton(t, block)), [], 0
        block.append((n, bytes(b)))
        held += len(b)
    return (found.union(_by_automaton(t, block)) if block else found).distinct()
