"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class c holds the lengths in
(capacity/(c+1), capacity/c], and each of its bins takes exactly c pieces. So a
worker fills bins knowing nothing of other workers: no shuffle, no global sort.

Plain harmonic packing loses up to half of a bin for lengths just above
capacity/2. Documents may be cut, so a document gives first whole bins, then
pieces of capacity/2, /4, /8 and /16, which fill their classes' bins without
rest, and one tail below capacity/16, whose class wastes 1/17 of it at most.
What is left in unfilled bins when a worker ends (less than a bin a class) is
packed by first fit, largest first.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe_codec import byte_alphabet
from .common import Memo, arrow_map, odd_space, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
#: How the vocabulary splits text before merging (fixed value, as its README gives it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE vocabulary.

    Where every white space of a text is one space or line feed between two
    other characters, the pattern never matches across it: a space belongs to
    what follows, a line feed is a token's text of its own. Such texts are split
    at white space and each distinct chunk is encoded once; all others take the
    pattern over the whole text. The merging itself is tiktoken's, given the
    vocabulary with ids as ranks.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes([byte_of[c] for c in t]): i for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.special = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec["added_tokens"]}
        for s in self.special:
            ranks.pop(s.encode(), None)
        bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = lambda text: array("I", bpe.encode_ordinary(text)).tobytes()
        self._piece = lambda text: array("I", bpe._encode_single_piece(text)).tobytes()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.heads = Memo(lambda w: self._chunk("", w), 250_000)
        self.words = Memo(lambda w: self._chunk(" ", w), 250_000)
        self.newline = self._plain("\n")

    def _chunk(self, space: str, word: str) -> bytes:
        if word.isalpha():
            return self._piece(space + word)
        core = word.rstrip(".,")
        if core.isalpha():  # letters and what follows them are apart in the pattern
            return (self.words if space else self.heads)[core] + self.heads[word[len(core) :]]
        return self._plain(space + word)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.split and any(s in text for s in self.special):
            return b"".join(self.special.get(part) or self._chunks(part) for part in self.split(text) if part)
        return self._chunks(text)

    def _chunks(self, text: str) -> bytes:
        if not text or odd_space(text):
            return self._plain(text)
        parts, words = [], self.words.__getitem__
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts += (self.newline, self.heads[head])
            parts += map(words, rest)
        return b"".join(parts[1:])


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """One for each worker process, so that its memo outlives a task."""
    return ByteTokenizer(path)


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= capacity // 16 and size:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] if rest else out


def first_fit(pieces: list, capacity: int) -> list[list]:
    """Bins of (length, ...) pieces, largest first."""
    bins: list[list] = []
    room: list[int] = []
    for p in sorted(pieces, key=lambda p: -p[2]):
        at = next((i for i, r in enumerate(room) if r >= p[2]), None)
        if at is None:
            bins.append([])
            room.append(capacity)
            at = len(bins) - 1
        bins[at].append(p)
        room[at] -= p[2]
    return bins


def pack(docs: DataFrame, capacity: int = 1024, separator: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens (a power of two).

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Every document ends with ``separator``. Null and
    empty texts: the separator alone. Repeated rows and equal or null ids: each
    row is packed. Other columns are ignored. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    tail = int(separator).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_tokenizer(path)
        worker = TaskContext.get().partitionId() if TaskContext.get() else 0
        next_id = worker << 40
        open_bins: dict[int, list] = {}
        cols: list[list] = [[] for _ in range(7)]

        def close(pieces):
            nonlocal next_id
            offset = 0
            for doc, start, length, crc, total in pieces:
                for col, v in zip(cols, (doc, start, length, crc, total, next_id, offset), strict=True):
                    col.append(v)
                offset += length
            next_id += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)
            for c in cols:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tok.encode(text or "") + tail
                total, start = len(ids) // 4, 0
                for n in cuts(total, capacity):
                    piece = (doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total)
                    start += n
                    per_bin = capacity // n
                    waiting = open_bins.setdefault(per_bin, [])
                    waiting.append(piece)
                    if len(waiting) == per_bin:
                        close(waiting)
                        open_bins[per_bin] = []
                if len(cols[0]) >= 20_000:
                    yield flush()
        for pieces in first_fit([p for w in open_bins.values() for p in w], capacity):
            close(pieces)
        yield flush()

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)
