"""Removal of byte strings that occur twice or more, by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as ``threshold`` bytes: passes of digits, most
significant first, split groups of suffixes that agree so far; a group of one
is done, and groups that still agree at full depth are exactly the repeated
windows. Two things keep the passes small.

* Suffixes start at anchors. Of the grams (``gram`` bytes) of a window, the one
  with the least hash is its anchor: equal windows have equal anchors at equal
  places, so comparing windows anchor by anchor misses none. An anchor stands for
  all neighbouring windows that it anchors; there is about one for 150 bytes.
* Digit one is the anchor's gram. Digit two is all bytes of all windows that the
  anchor stands for; suffixes that agree in it are repeated in all these windows
  at once. Only where suffixes agree in digit one, but some stand alone in digit
  two (the ends of repeated passages), the range is split: into blocks of
  ``BLOCK`` windows, whose digits are the bytes that all of them share and the
  bytes of all of them, and where these disagree again into single windows.

Suffixes whose first digit occurs once (most) fall out in the first pass, before
anything else is shuffled or kept. Groups are counted and joined back, never
gathered, however many documents hold a passage: of the rows of one digit in a
batch the first two meet those of other batches; the others, repeated by these
two, are dealt at random. Digits two and three are hashes: 128 bits with what
they are compared within. Texts travel compressed.

Lengths count bytes, or with ``words`` words between ASCII white space, each named
by a 64-bit hash: a passage then is so many equal words, however short they are
and whatever white space is between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, kgram_hash, mix64, release, sliding_min, text_key

_ANCHORS = "d1 long, d2 long, k1 long, k2 long, r long, s int, t int"
_NAMES = ["d1", "d2", "k1", "k2", "r", "s", "t"]
#: Windows of a block between the anchor's range and the single window.
BLOCK = 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, clean_text string"
#: Further columns where repeated passages are counted in words too.
PASSAGES = ", n_passages long, n_passage_words long"
#: Windows of a text that are looked at together.
SPAN = 1 << 23
_RANGE = 10  # bits of a range's lengths beside its start
_LOW = (1 << _RANGE) - 1
#: Words of an anchor's gram when lengths count words.
WORD_GRAM = 13
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _packed(first, anchor, last):
    """A range of window starts and its anchor in one number."""
    return first << 2 * _RANGE | anchor - first << _RANGE | last - first


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a, pa.int64())


def _salts(spread: np.ndarray, *digits: np.ndarray) -> np.ndarray:
    """0 for the first two rows of equal digits, for the others a number above it by ``spread``."""
    order = np.lexsort(digits)
    later = np.ones(max(len(order) - 2, 0), bool)
    for d in digits:
        later &= d[order[2:]] == d[order[:-2]]
    salts, hot = np.zeros(len(order), np.int32), order[2:][later]
    salts[hot] = spread[hot] % np.uint64(0x7FFFFFFE) + np.uint64(1)
    return salts


def _rows(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Suffixes as a batch, with salts by digit one (``s``) and by both digits (``t``).

    A digit that the batch holds twice or more has two rows without a salt, so
    rows without one show whether a digit is repeated, and rows with one are.
    """
    d1, d2, k1, _, r = cols
    spread = mix64(np.arange(len(d1), dtype=np.uint64) ^ k1.view(np.uint64) ^ r.view(np.uint64))
    return pa.RecordBatch.from_arrays([*map(_long, cols), pa.array(_salts(spread, d1)), pa.array(_salts(spread, d1, d2))], names=_NAMES)


def _symbols(raw: bytes, words: bool) -> np.ndarray:
    """A text's bytes, or the hashes of its words."""
    if not words:
        return np.frombuffer(raw, np.uint8)
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw.split()), np.uint64)


def anchors(symbols: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchors' grams, their places, and the first and last start of the windows that each anchors.

    Long texts go in blocks of ``SPAN`` windows, so that places in a block have a
    fixed width beside the hashes whose minimum is taken: which gram anchors a
    window depends on the window alone.
    """
    out: list[list] = [[], [], [], []]
    for at in range(0, len(symbols) - threshold + 1, SPAN):
        n = min(SPAN, len(symbols) - threshold + 1 - at)
        h = kgram_hash(symbols[at : at + n + threshold - 1], gram)
        low = np.uint64(2 * SPAN - 1)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), threshold - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = (least[first] & low).astype(np.int64)
        for col, v in zip(out, (h[place], at + place, at + first, at + np.append(first[1:] - 1, n - 1)), strict=True):
            col.append(v)
    if not out[0]:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    return tuple(map(np.concatenate, out))


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that packed ranges (start, length) cover."""
    marks = np.sort(marks)
    start = marks >> _RANGE
    end = np.maximum.accumulate(start + (marks & _LOW))
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def squeezed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, name of the text, compressed text (null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            z = pa.array([squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["doc_id", "k1", "k2", "z"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(rows.select("doc_id", *text_key(), "text"), run, "doc_id long, k1 long, k2 long, z binary")


def repeated_ranges(docs: DataFrame, packed: DataFrame, threshold: int = 400, gram: int = 101, text_col: str = "text", words: bool = False) -> DataFrame:
    """Ranges of bytes (or words) covered by repeated windows: ``k1, k2`` (names of a text), ``marks`` (array of packed ranges).

    ``packed``: the same documents, as ``squeezed`` gives them.
    """
    import xxhash

    if not 0 < gram <= threshold or threshold + (threshold - gram + 1) >= 1 << _RANGE:
        raise ValueError("threshold out of range")
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].cast("string").alias("text")).where(F.octet_length("text") >= (2 * threshold - 1 if words else threshold)).select(*text_key(), "text")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digit = xxhash.xxh3_64_intdigest
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                cols: list[list] = [[], [], [], [], []]
                for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    symbols = _symbols(text.encode("utf-8", "surrogatepass"), words)
                    h, place, first, last = anchors(symbols, threshold, gram)
                    d2 = np.array([digit(symbols[a : b + threshold]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                    for col, v in zip(cols, (h, d2, np.full(len(h), k1, np.int64), np.full(len(h), k2, np.int64), _packed(first, place, last)), strict=True):
                        col.append(v)
                yield _rows([np.concatenate(c) for c in cols])

    rows = cut(_shared(arrow_map(texts, suffixes, _ANCHORS), ["d1"]))
    release(spark)
    whole, open_ranges = _settle(rows)

    def split(step: int):
        """Digits of the open ranges' blocks of ``step`` windows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            expand, digit, other = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
            before, cols = None, ([], [], [], [], [])

            def flush():
                out = _rows([np.array(c, t) for c, t in zip(cols, (np.uint64, np.uint64, np.int64, np.int64, np.int64), strict=True)])
                for c in cols:
                    c.clear()
                return out

            for batch in batches:
                for k1, k2, z, rs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                    if not rs or (k1, k2) == before:  # of further copies all windows are repeated anyhow
                        continue
                    before, symbols = (k1, k2), _symbols(expand(z), words)
                    for r in rs:
                        start, n = r >> 2 * _RANGE, (r & _LOW) + 1
                        anchor = start + (r >> _RANGE & _LOW)
                        # blocks are counted from the anchor, so equal windows are in equal blocks
                        for j in range((anchor - start - n + 1) // step, (anchor - start) // step + 1):
                            top = anchor - step * j
                            first, last = max(start, top - step + 1), min(start + n - 1, top)
                            for col, v in zip(cols, (digit(symbols[top : top - step + 1 + threshold]), other(symbols[first : last + threshold]), k1, k2, _packed(first, anchor, last)), strict=True):
                                col.append(v)
                    if len(cols[0]) > 100_000:
                        yield flush()
            yield flush()

        return run

    marks = whole
    for step in (BLOCK, 1):
        # every pass reads the same exchange of packed texts
        with_ranges = packed.join(open_ranges, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "rs")
        # in the order of names, so that a task that runs again makes the same batches and salts
        with_ranges = with_ranges.sortWithinPartitions("k1", "k2")
        found = _shared(arrow_map(with_ranges, split(step), _ANCHORS), ["d1", "d2"] if step == 1 else ["d1"])
        if step > 1:
            found = cut(found)
            release(spark)
            found, open_ranges = _settle(found)
        marks = marks.union(found.select("k1", "k2", "r"))
    # a range of n windows from a start covers n - 1 + threshold bytes
    return marks.groupBy("k1", "k2").agg(F.collect_set(F.shiftright("r", 2 * _RANGE) * (1 << _RANGE) + F.col("r").bitwiseAND(_LOW) + threshold).alias("marks"))


def _sized(rows: DataFrame, digits: list[str]) -> DataFrame:
    """Rows with the size ``n`` of their group of equal digits and salt; no task sees more of a digit than two rows a batch."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*digits, "s" if len(digits) == 1 else "t")))


def _shared(rows: DataFrame, digits: list[str]) -> DataFrame:
    """Rows whose digits occur twice or more."""
    return _sized(rows, digits).where("n > 1 or s > 0" if len(digits) == 1 else "n > 1 or t > 0").select(*_NAMES)


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges that agree in both digits with another one (``k1, k2, r``), and of those that agree
    in digit one but stand alone in digit two, with one of each class they are to be compared with,
    the ranges by text (``k1, k2, rs``)."""
    sized = _sized(rows, ["d1", "d2"])
    whole = sized.where("n > 1 or t > 0").select("k1", "k2", "r")
    # a filter on t alone would slip below the exchange, which both are to read
    plain = sized.where("case when t = 0 then n else 0 end > 0")
    classes = plain.groupBy("d1", "d2", "t").agg(F.max("n").alias("n"), F.min(F.struct("k1", "k2", "r")).alias("x")).select("d1", "d2", "t", "n", "x.k1", "x.k2", "x.r")
    unsure = classes.groupBy("d1").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("d1")
    return whole, classes.join(unsure, "d1", "left_semi").groupBy("k1", "k2").agg(F.sort_array(F.collect_list("r")).alias("rs"))


def _cleaned(raw: bytes, marks: list | None, words: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    found = spans(np.array(marks, np.int64)) if marks else []
    if found and words:  # white space around a passage stays
        at = [m.span() for m in _WORD.finditer(raw)]
        found = [(at[a][0], at[b - 1][1]) for a, b in found]
    ends = [0, *(b for _, b in found)]
    starts = [*(a for a, _ in found), len(raw)]
    return b"".join([raw[a:b] for a, b in zip(ends, starts, strict=True)]), found


def remove_repeats(docs: DataFrame, threshold: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """Remove every byte that a repeated ``threshold``-byte string covers.

    One row per input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` (of the bytes left) and ``clean_text`` (characters left whole). Null and short texts lose nothing, unless copied whole.
    Repeated rows are copies of each other. Other columns are ignored; an empty
    table gives no rows.

    With ``passage``, also ``n_passages, n_passage_words``: the maximal runs of
    words that repeated strings of ``passage`` words cover, and the words in
    them, however few bytes they have. These words are counted, not removed.
    """
    packed = squeezed(docs, id_col, text_col)
    marks = repeated_ranges(docs, packed, threshold, text_col=text_col)
    if passage:
        # settled first, so that the passes over bytes and over words don't lie on disk together
        marks = cut(marks)
        release(docs.sparkSession)
        passages = repeated_ranges(docs, packed, passage, min(WORD_GRAM, passage), text_col, words=True).withColumnRenamed("marks", "passages")
    schema = SCHEMA + PASSAGES * bool(passage)
    names = [c.split()[0] for c in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for doc, z, m, *runs in zip(*(batch.column(i).to_pylist() for i in (0, *range(3, batch.num_columns))), strict=True):
                raw = expand(z)
                kept, found = _cleaned(raw, m)
                row = (doc, len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
                for p in runs:
                    of_words = spans(np.array(p, np.int64)) if p else []
                    row += (len(of_words), sum(b - a for a, b in of_words))
                out.append(row)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("kept_sha256", "clean_text") else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    # the same exchange of packed texts as in the third pass
    joined = packed.join(marks, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "marks")
    if passage:
        joined = joined.join(passages, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "marks", "passages")
    return arrow_map(joined, digest, schema)


def without_repeats(docs: DataFrame, threshold: int = 400, text_col: str = "text", words: bool = False) -> DataFrame:
    """``docs`` with all its columns, repeated strings of ``threshold`` bytes (or words) cut from the text; a character cut in two goes whole."""
    marks = repeated_ranges(docs, squeezed(docs.withColumn("__id", F.lit(0)), "__id", text_col), threshold, WORD_GRAM if words else 101, text_col, words)
    keys = [k.alias(n) for k, n in zip(text_key(), ("__k1", "__k2"), strict=True)]
    hits = marks.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "marks": "__marks"})
    clean = docs.withColumn("text", F.col(text_col).cast("string")) if text_col != "text" else docs
    joined = clean.select("*", *keys).join(hits, ["__k1", "__k2"], "left")
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if not m else _cleaned(t.encode("utf-8", "surrogatepass"), m, words)[0].decode("utf-8", "ignore") for t, m in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(joined.select(*names, "__marks"), rewrite, docs.schema)
