"""Similarity join of documents by shingle sets, with parity sketches.

A set's sketch has segments of 2^16 bits; each shingle toggles one bit of one
segment, so an even number of toggles leaves no trace and the Hamming distance
of two sketches is at most the size of the sets' symmetric difference. Sets of
size n whose Jaccard similarity reaches p/100 differ in at most
d(n) = floor((100-p) n / p) shingles: at most d segments differ, and of any d+1
segments one is equal in both (pigeonhole). Sketches are comparable within a
size band only (the band sets the number of segments); a set also enters the
next band where partners above its own band can exist.

Segments with fewer than two set bits say little and would be hot. A document
emits its first d+1 *telling* segments. Whether a segment tells depends on its
bits alone, so an equal pair of segments tells for both: among the first t of
one of them at most d differ and fewer than t-d don't tell, so one is left that
both emit. A set with too few telling segments emits all it has, and tries
again with another hash; after ``SEEDS`` hashes it emits every segment.

Buckets are never expanded into pairs. Where a bucket's members meet, their
whole sketches (folded to some five bits for each shingle that may differ) are compared
in blocks; pairs beyond the bound fall out there. First each member is paired
with a hub of its bucket only; links, verified on the exact shingle sets, join
into components. Then pairs within the bound that are still in different
components, rare by now, are verified too; so no link is lost. Buckets larger
than ``BLOCK`` are dealt to tasks by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, arrow_map, cut, mix64, partitions, release, text_key
from .graph import components

SEEDS = 4
#: Members of a bucket that are compared in one task.
BLOCK = 2000
#: Tasks among which the rows of one text or component are dealt.
SALTS = 32
_ITEMS = "doc_id long, id long, n long, even binary, odd binary"
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    import xxhash

    return Memo(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z in lower case; of a shorter text, one of all its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else 0, np.uint64)
    for i in range(min(size, len(h))):
        out = (out ^ h[i : i + n]) * _C[0] + _C[1]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


def differ_at_most(n: int, percent: int) -> int:
    return (100 - percent) * n // percent


def band_segments(band: int, percent: int) -> int:
    """Segments of sketches in a band: a quarter more than its largest set must emit, and a few."""
    return (5 * (differ_at_most((2 << band) - 1, percent) + 1)) // 4 + 3


def bands(n: int, percent: int) -> list[int]:
    """A set's own band, and the next if partners reach into it."""
    own = n.bit_length() - 1
    return [] if not n else [own, own + 1] if 100 * n // percent >= 2 << own else [own]


def segments(tokens: np.ndarray, m: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sketch's segments with set bits: index, a hash of the bits, their number."""
    h = mix64(tokens ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    code = (h >> np.uint64(32)) % np.uint64(m) << np.uint64(16) | h & np.uint64(0xFFFF)
    code, times = np.unique(code, return_counts=True)
    code = code[times & 1 == 1]
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    index = (code >> np.uint64(16)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    bits = np.diff(np.append(first, len(code)))
    return index[first], np.bitwise_xor.reduceat(mix64((code & np.uint64(0xFFFF)) + _C[2]), first), bits


def keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Bucket keys of a set; the lowest bit is that of the band."""
    need, out = differ_at_most(len(tokens), percent) + 1, []
    for band in bands(len(tokens), percent):
        before = len(out)
        m = band_segments(band, percent)
        telling = 2 if band >= 5 else 1
        for seed in range(SEEDS):
            index, value, bits = segments(tokens, m, band * SEEDS + seed + 1)
            tells = bits >= telling
            index, value = index[tells], value[tells]
            place = np.uint64((band * SEEDS + seed) << 32)
            out.append(mix64(value ^ mix64(place + index.astype(np.uint64))))
            if len(index) >= need:
                out[-1] = out[-1][:need]
                break
        else:
            index, value, _ = segments(tokens, m, band * SEEDS + SEEDS)
            every = np.zeros(m, np.uint64)
            every[index] = value
            out.append(mix64(every ^ mix64(np.uint64((band * SEEDS + SEEDS - 1) << 32 | 1 << 31) + np.arange(m, dtype=np.uint64))))
        out[before:] = [k & ~np.uint64(1) | np.uint64(band & 1) for k in out[before:]]
    return np.concatenate([*out, np.empty(0, np.uint64)])


def folded(tokens: np.ndarray, band: int, percent: int) -> bytes:
    """The set's parity sketch in a band as bits, about five for each shingle that may differ."""
    words = differ_at_most((2 << band) - 1, percent) // 12 + 4
    h = mix64(tokens + np.uint64(band + 77))
    code, times = np.unique(h % np.uint64(64 * words), return_counts=True)
    code = code[times & 1 == 1]
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (code >> np.uint64(6)).astype(np.int64), np.uint64(1) << (code & np.uint64(63)))
    return out.tobytes()


def _name(docs: DataFrame, text_col: str) -> Column:
    """The 64-bit name of a text: its first hash, but its second one where different texts share the first.

    Such texts are found by both hashes together; of n texts some n^2 / 2^65 are
    to be expected: none below a billion, some seventy in fifty billion.
    """
    k1, k2 = text_key()
    texts = docs.select(docs[text_col].cast("string").alias("text")).select(k1, k2)
    shared = texts.groupBy("k1").agg(F.min("k2").alias("a"), F.max("k2").alias("b")).where("a < b").select("k1").collect()
    first, second = (F.get(F.array(k), F.lit(0)) for k in text_key())
    return F.when(first.isin([r.k1 for r in shared]), second).otherwise(first) if shared else first


def _items(docs: DataFrame, name: Column, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id of the document, name of its text, set size, folded sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = [shingles(t, size) for t in batch.column(2).to_pylist()]
                sketches = [{b & 1: folded(s, b, percent) for b in bands(len(s), percent)} for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x.get(i) for x in sketches], pa.binary()) for i in (0, 1))], names=["doc_id", "id", "n", "even", "odd"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(rows.select("doc_id", name.alias("id"), "text"), run, _ITEMS)


def _keyed(docs: DataFrame, name: Column, size: int, percent: int, text_col: str) -> DataFrame:
    """``key, id``: bucket keys of the texts, once for all copies that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                new = {i: t for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if i not in met}
                met.update(new)
                found = [keys(shingles(t, size), percent) for t in new.values()]
                ids = np.repeat(np.fromiter(new, np.int64, len(new)), [len(k) for k in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return arrow_map(docs.select(docs[text_col].cast("string").alias("text")).select(name.alias("id"), "text"), run, "key long, id long")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets reach the similarity, compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        name, known = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                us, vs = [], []
                batch = whole.slice(at, 1000)
                for u, v, zu, zv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if v != name:
                        name, known = v, shingles(expand(zv).decode("utf-8", "surrogatepass"), size)
                    mine = shingles(expand(zu).decode("utf-8", "surrogatepass"), size)
                    both = len(np.intersect1d(mine, known, assume_unique=True))
                    if both and 100 * both >= percent * (len(mine) + len(known) - both):
                        us.append(u)
                        vs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    a = texts.select(F.col("id").alias("u"), F.col("z").alias("zu"))
    b = texts.select(F.col("id").alias("v"), F.col("z").alias("zv"))
    return arrow_map(pairs.join(a, "u").join(b, "v").select("u", "v", "zu", "zv"), run, "u long, v long")


def _squeezed(docs: DataFrame, name: Column, wanted: DataFrame, text_col: str) -> DataFrame:
    """One compressed text for each wanted name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).select(name.alias("id"), "text")
    return arrow_map(rows, run, "id long, z binary").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("z").alias("z"))


def _candidates(rows: DataFrame, percent: int, stars: bool) -> DataFrame:
    """Pairs (u, v) within the bound, of members in different components, by block of a bucket.

    ``stars``: only enough pairs to tie members to hubs, at most one or two a member.
    """

    def block(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
        near = np.zeros((len(ids), len(ids)), bool)
        for i in range(0, len(ids), 32):
            far = np.bitwise_count(sketch[i : i + 32, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
            near[i : i + 32] = far <= (100 - percent) * (n[i : i + 32, None] + n[None, :]) // (100 + percent)
            near[i : i + 32] &= comp[i : i + 32, None] != comp[None, :]
        if side.any():  # two blocks meet: each alone is another task's
            near &= side[:, None] != side[None, :]
        if not stars:
            i, j = np.nonzero(np.triu(near))
            return list(zip(ids[i].tolist(), ids[j].tolist(), strict=True))
        out, free = [], near.any(axis=1)
        while free.any():
            hub = int(np.argmax(np.where(free, near.sum(axis=1), -1)))
            free[hub] = False
            out += [(int(ids[hub]), int(x)) for x in ids[near[hub] & free]]
            if (tied := np.flatnonzero(near[hub] & ~free)).size:
                out.append((int(ids[hub]), int(ids[tied[0]])))
            free &= ~near[hub]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, waiting, seen = None, [], set()

        def close():
            if len(waiting) > 1:
                cols = list(zip(*waiting, strict=True))
                sketch = np.frombuffer(b"".join(cols[4]), np.uint64).reshape(len(waiting), -1)
                seen.update((max(p), min(p)) for p in block(*(np.array(c, np.int64) for c in cols[:4]), sketch))
            waiting.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([p[i] for p in seen], pa.int64()) for i in (0, 1)], names=["u", "v"])
            seen.clear()
            return out

        for whole in batches:
            for key, a, b, own, *row in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                if (key, a, b) != name:
                    close()
                    name = (key, a, b)
                waiting.append((*row[:3], int(own != a), row[3]))
            if len(seen) > 100_000:
                yield flush()
        close()
        yield flush()

    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark), "key", "a", "b").sortWithinPartitions("key", "a", "b", "id")
    return arrow_map(dealt.select("key", "a", "b", "own", "id", "n", "component", "sketch"), run, "u long, v long").where("u <> v").distinct()


def near_components(docs: DataFrame, percent: int = 85, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents under links of Jaccard similarity ``percent``/100 of word ``size``-shingles.

    One row per input row: ``doc_id, n_shingles, component_id`` (smallest id of
    the component, itself for an unlinked document; null if it has no id).
    Texts without words and null texts have no shingles and no links. Copies
    and repeated rows are linked. Other columns are ignored; an empty table
    gives no rows.
    """
    items, pairs = _components(docs, _name(docs, text_col), percent, size, id_col, text_col)
    found = items.join(pairs.select("id", "salt", "first.doc_id"), ["id", "salt"]).toDF(*"id salt doc_id n least".split())
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _components(docs: DataFrame, name: Column, percent: int, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (``id`` of the text, ``salt``, ``doc_id``, ``n``), and for each (id, salt) the ``first`` row (doc_id, id) of its component
    and the number of ``rows``."""
    spark = docs.sparkSession
    items = cut(_items(docs, name, size, percent, id_col, text_col))
    # known not null, so that both readers of the exchange ask for the same one and it is made once
    rows = _keyed(docs, name, size, percent, text_col).where("key is not null").repartition(partitions(spark), "key")
    buckets = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "size")
    members = rows.join(buckets, "key").groupBy("key", "id").agg(F.max("size").alias("size"))
    # for large buckets, the pairs of blocks that a member goes to
    blocks = F.expr(f"CAST((size + {BLOCK} - 1) div {BLOCK} AS INT)")
    members = members.withColumn("blocks", blocks).withColumn("own", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
    members = cut(members.select("key", "id", "own", F.explode(F.expr("transform(sequence(0, blocks - 1), i -> struct(least(i, own) AS a, greatest(i, own) AS b))")).alias("p")).select("key", "id", "own", "p.a", "p.b"))
    release(spark)
    sketches = items.groupBy("id").agg(F.max("n").alias("n"), F.first("even").alias("even"), F.first("odd").alias("odd"))

    def sketched(rows: DataFrame) -> DataFrame:
        return rows.join(sketches, "id").withColumn("sketch", F.when(F.col("key").bitwiseAND(1) == 0, F.col("even")).otherwise(F.col("odd"))).drop("even", "odd")

    pairs = cut(_candidates(sketched(members.withColumn("component", F.col("id"))), percent, stars=True))
    texts = _squeezed(docs, name, pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), text_col)
    links = cut(_linked(pairs, texts, size, percent))
    release(spark)
    found = components(links)
    named = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = named.groupBy("key", "a", "b").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key", "a", "b")
    more = cut(_candidates(sketched(named.join(apart, ["key", "a", "b"], "left_semi")), percent, stars=False).join(pairs, ["u", "v"], "left_anti"))
    release(spark)
    if not more.isEmpty():
        texts = _squeezed(docs, name, more.select(F.col("u").alias("id")).union(more.select("v")).distinct(), text_col)
        late = cut(_linked(more, texts, size, percent))
        if not late.isEmpty():
            found = components(links.union(late))
    release(spark)

    # a text or a component may hold very many rows: they are dealt by salts, and summed up by salt before a window over at most SALTS rows
    items = items.select("id", F.expr(f"CAST(pmod(xxhash64(doc_id), {SALTS}) AS INT)").alias("salt"), "doc_id", "n")
    last = F.lit((1 << 63) - 1)  # a row without an id stands for its component only where all are without
    mine = items.groupBy("id", "salt").agg(F.min(F.coalesce("doc_id", last)).alias("d"), F.max("n").alias("n"), F.count("*").alias("rows"))
    mine = mine.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "salt", "rows", F.struct("d", "id").alias("own"), F.when(F.col("n") > 0, F.coalesce("component", "id")).alias("component"))
    mine = mine.withColumn("deal", F.expr(f"CAST(pmod(xxhash64(id, salt), {SALTS}) AS INT)"))
    linked = mine.where("component is not null")
    least = linked.groupBy("component", "deal").agg(F.min("own").alias("own")).select("component", "deal", F.min("own").over(Window.partitionBy("component")).alias("least"))
    mine = mine.join(least, ["component", "deal"], "left").withColumn("first", F.coalesce("least", "own"))
    return items, mine.select("id", "salt", "rows", F.struct(F.nullif("first.d", last).alias("doc_id"), F.col("first.id").alias("id")).alias("first"))


def without_copies(docs: DataFrame, percent: int = 85, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all its columns: that with the smallest id (rows without an id come last, of equal ids one text's).

    Of repeated rows one stays, whichever other columns it has. Texts without
    words are linked with nothing: all their rows stay. An empty table gives no rows.
    """
    name = _name(docs, text_col)
    items, pairs = _components(docs, name, percent, size, id_col, text_col)
    key = [docs[id_col].cast("long").alias("__d"), name.alias("__t")]
    named = docs.withColumn("text", F.col(text_col).cast("string")) if text_col != "text" else docs
    wordless = items.where("n = 0").select(F.col("doc_id").alias("__d"), F.col("id").alias("__t")).distinct()
    chosen = items.where("n > 0").join(pairs, ["id", "salt"]).where("doc_id <=> first.doc_id and id = first.id")
    keep = chosen.groupBy(F.col("doc_id").alias("__d"), F.col("id").alias("__t")).agg(F.count("*").alias("n"))
    same = F.col("l.__d").eqNullSafe(F.col("r.__d")) & (F.col("l.__t") == F.col("r.__t"))
    rows = named.select("*", *key)
    once = keep.where("n = 1").select("__d", "__t").union(wordless)
    out = rows.alias("l").join(once.alias("r"), same, "left_semi")
    again = keep.where("n > 1").select("__d", "__t")
    if not again.isEmpty():
        out = out.unionByName(rows.alias("l").join(again.alias("r"), same, "left_semi").dropDuplicates(["__d", "__t"]))
    return out.select(*docs.columns)
