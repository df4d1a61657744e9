"""Ranked lexical search by best-first branch-and-bound over a hierarchical max tree.

The index holds, for each document, its length and the terms that any query
asks for, with their counts; it is one pass over the texts and is written as a
table. A task that searches takes documents in ranges of ``FAN ** 3``: for each
term a tree of maxima lies over the range, whose nodes cover ``FAN``, ``FAN ** 2``
and ``FAN ** 3`` documents. A query's bound at a node is the sum of its terms'
maxima there. Nodes are opened from the highest bound on, and nodes whose bound
equals the last kept score too, as ties are told by id; the search of a range
ends at the first node below it. Kept scores pass on from range to range, so
later ranges open fewer nodes.

Documents stay where they are: no posting is shuffled, each task hands on ten
documents a query at most, and a window ranks those. Queries go to the tasks in
blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Children of a tree node; a range has FAN ** 3 documents.
FAN = 32
#: Distinct terms, and queries, of a block at most (a longer query is a block of its own).
BLOCK_TERMS, BLOCK_QUERIES = 200_000, 5_000
#: Letters become lower case (A-Z alone), what parts terms becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all other characters."""
    return text.translate(_TABLE).split()


def _index(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            ids, sizes, found, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = Counter(terms(text.as_py() or b""))
                if not words:
                    continue
                hits = [(t, n) for w, n in words.items() if (t := get(w)) is not None]
                ids.append(doc_id.as_py())
                sizes.append(words.total())
                found.append([t for t, _ in hits])
                counts.append([n for _, n in hits])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return run


class Range:
    """Maxima of a range of documents: per level, entries sorted by (term, node)."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, gain: np.ndarray):
        order = np.lexsort((doc, term))
        term, node, top = term[order].astype(np.int64), doc[order].astype(np.int64), gain[order]
        self.levels = []
        for width in (FAN**3, FAN**2, FAN, 1):
            self.levels.append((term * width + node, top, width))
            key = term * (width // FAN or 1) + node // FAN
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            term, node, top = term[first], node[first] // FAN, np.maximum.reduceat(top, first)

    def children(self, query: np.ndarray, times: np.ndarray, level: int, node: int) -> np.ndarray:
        """Bounds of the children (of ``level``) of a node: sums of the query's maxima; of level 0, scores."""
        keys, tops, width = self.levels[level]
        at = query * width + node * FAN
        low, high = np.searchsorted(keys, at), np.searchsorted(keys, at + FAN)
        sizes = high - low
        total = int(sizes.sum())
        picked = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
        # sums stay below 2^53, so doubles are exact
        return np.bincount(keys[picked] % width - node * FAN, tops[picked] * np.repeat(times, sizes), FAN)


def _better(kept: list, k: int, entry: tuple) -> None:
    heapq.heappush(kept, entry) if len(kept) < k else heapq.heappushpop(kept, entry)


def search_range(tree: Range, ids: list, query: np.ndarray, times: np.ndarray, kept: list, k: int) -> int:
    """Best-first search of one range: updates ``kept``, a heap of (score, not without id, -id) with its least entry first; returns the number of opened nodes."""
    heap, opened = [(-math.inf, 3, 0)], 0
    while heap:
        bound, level, node = heapq.heappop(heap)
        if len(kept) == k and -bound < kept[0][0]:
            break
        opened += 1
        bounds = tree.children(query, times, level - 1, node)
        least = kept[0][0] if len(kept) == k else 1
        for child in np.flatnonzero(bounds >= least).tolist():
            if level > 1:
                heapq.heappush(heap, (-bounds[child], level - 1, node * FAN + child))
            elif bounds[child] > 0:
                doc_id = ids[node * FAN + child]
                _better(kept, k, (int(bounds[child]), doc_id is not None, -(doc_id or 0)))
    return opened


def _search(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]

        def ranges() -> Iterator[pa.Table]:
            held, rows = [], 0
            for batch in batches:
                while batch.num_rows:
                    part = batch.slice(0, FAN**3 - rows)
                    held.append(part)
                    rows += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if rows == FAN**3:
                        yield pa.Table.from_batches(held)
                        held, rows = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for table in ranges():
            flat = table.column("terms").combine_chunks()
            term, tf = flat.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            if not len(term):
                continue
            n = table.column("n").to_numpy()
            m = 25 + 75 * n * docs // length
            doc = np.repeat(np.arange(len(n)), np.diff(flat.offsets.to_numpy()))
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            tree, ids = Range(term, doc, gain), table.column("doc_id").to_pylist()
            for (query, times), kept in zip(queries, best, strict=True):
                if len(query):
                    search_range(tree, ids, query, times, kept, k)
        rows = [(i, score, -least if known else None) for i, kept in enumerate(best) for score, known, least in kept]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "score", "doc_id"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Queries with their term counts, in blocks of bounded size; they pass the driver one after the other."""
    block, seen = [], set()
    for row in items.toLocalIterator():
        counts = Counter(terms(bytes(row[1] or b"")))
        if block and (len(block) == BLOCK_QUERIES or len(seen) + len(counts) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((row[0], counts))
        seen |= counts.keys()
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0, equal scores by id.

    Null and empty texts have no terms: such a document is never found and
    counts nowhere, such an item gives no rows. A document without an id comes
    last among equal scores. Repeated documents are found one by one, repeated
    items searched one by one. Other columns are ignored; an empty table on
    either side gives no rows.
    """
    spark, found = docs.sparkSession, []
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    for block in _blocks(items.select(F.col(item_id).cast("long"), F.col(text_col).cast("string").cast("binary"))):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
        index = written(arrow_map(texts, _index(vocabulary), "doc_id long, n long, terms array<int>, counts array<int>"))
        n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).toLocalIterator():  # as many as the block has terms at most
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        queries = [(np.array([vocabulary[t] for t in counts], np.int64), np.array(list(counts.values()), np.int64)) for _, counts in block]
        hits = arrow_map(index, _search(queries, weights, n_docs, length, k), "query int, score long, doc_id long")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found.append(hits.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
asked AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
