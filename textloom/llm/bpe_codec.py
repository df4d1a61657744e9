"""BPE encoding and decoding: speculate and verify.

For the distinct words of a batch, greedy longest match proposes tokens. A
token sequence is what merging gives exactly if merging leaves each adjacent
pair as it is; so the pairs of all proposals are laid out in one array and
looked up together, pairs never seen before are decided once, and only words
with a failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, tokenizer_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
END = "</w>"
SCANNED = 64
#: How the vocabulary splits normalised text; what it doesn't match is dropped (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

#: White space for str.split, not for the pattern (fixed value).
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_alphabet() -> list[str]:
    """Byte-level BPE's printable character for each byte: printable Latin-1 as is, the rest from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBPE:
    """Encoder and decoder of a word-end BPE vocabulary in the tokenizers library's format."""

    def __init__(self, path: str, memo_limit: int = 250_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of.update({i: t for t, i in self.special.items()})
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.alphabet = byte_alphabet()
        self.find = regex.compile(PATTERN).findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.known: dict[int, bool] = {}  # pair code -> merging leaves the pair as it is
        self.memo: dict[str, tuple[str, int, str]] = {}  # word -> ids as text, their number, tokens as text
        self.chunks: dict = {}  # the same of chunks between white space
        self.memo_limit = memo_limit

    # -- words

    def normalise(self, text: str) -> str:
        """Canonical composition and lower case, each character for itself."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def words(self, text: str) -> list[str]:
        return self.find(self.normalise(text))

    def symbols(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")])

    # -- exact merging

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the best-ranked pair, leftmost first, until no pair has a rank.

        Short words are scanned for each merge, which is faster there. Beyond
        ``SCANNED`` symbols a heap of (rank, place) over a linked list takes
        n log n steps; its entries of pairs that have changed since are skipped.
        """
        return self._scanned(list(parts)) if len(parts) <= SCANNED else self._heaped(list(parts))

    def _scanned(self, parts: list[str]) -> list[str]:
        get, none = self.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def _heaped(self, parts: list[str]) -> list[str]:
        get, n = self.rank.get, len(parts)
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := get(p)) is not None]
        if not heap:
            return parts
        heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            rank, at = heappop(heap)
            right = after[at]
            if parts[at] is None or right < 0 or get((parts[at], parts[right])) != rank:
                continue
            parts[at] += parts[right]
            parts[right] = None
            after[at] = follows = after[right]
            if follows >= 0:
                before[follows] = at
                if (r := get((parts[at], parts[follows]))) is not None:
                    heappush(heap, (r, at))
            if (left := before[at]) >= 0 and (r := get((parts[left], parts[at]))) is not None:
                heappush(heap, (r, left))
        return [p for p in parts if p is not None]

    def exact(self, symbols: str) -> list[int]:
        return [self.vocab[p] for p in self.merge([*symbols[:-1], symbols[-1] + END])]

    # -- speculation

    def greedy(self, symbols: str) -> list[int]:
        """Longest match from the left; the word's last token carries the word end."""
        out, at, n = [], 0, len(symbols)
        get = self.vocab.get
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                token = get(symbols[at:end] + END if end == n else symbols[at:end])
                if token is not None:
                    break
            out.append(token)
            at = end
        return out

    def _stays(self, code: int) -> bool:
        """Whether merging the spelling of a pair (or of one token, first part 0) gives it back."""
        a, b = code >> 20, code & 0xFFFFF
        tokens = [b] if a == 0 else [a - 1, b]
        parts: list[str] = []
        for t in tokens:
            s = self.text_of[t]
            parts += [*s[: -len(END) - 1], s[-len(END) - 1 :]] if s.endswith(END) and len(s) > len(END) else list(s)
        return self.merge(parts) == [self.text_of[t] for t in tokens]

    def learn(self, words: list[str]) -> None:
        """Fill the memo for words that it lacks."""
        spelt = [self.symbols(w) for w in words]
        proposed = [self.greedy(s) for s in spelt]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(flat)
        before[1:] = flat[:-1] + 1
        before[starts] = 0
        codes = before << 20 | flat
        distinct, place = np.unique(codes, return_inverse=True)
        for c in distinct.tolist():
            if c not in self.known:
                self.known[c] = self._stays(c)
        good = np.fromiter((self.known[c] for c in distinct.tolist()), bool, len(distinct))[place]
        fails = np.add.reduceat(~good, starts) > 0 if len(flat) else np.zeros(0, bool)
        for i, word in enumerate(words):
            ids = self.exact(spelt[i]) if fails[i] else proposed[i]
            self.memo[word] = (" ".join(map(str, ids)), len(ids), " ".join([self.text_of[t] for t in ids]))

    # -- texts

    def pieces(self, text: str) -> list[str]:
        """A text's chunks: split at white space where that is all the pattern drops, else its words."""
        text = self.normalise(text)
        return self.find(text) if any(map(text.__contains__, SEPARATORS)) else text.split()

    def encode_all(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """Per text its chunks' entries: ids as text, their number, tokens as text."""
        if len(self.known) > 4 * self.memo_limit:
            self.known.clear()
        for m in (self.chunks, self.memo):
            if len(m) > self.memo_limit:
                m.clear()
        rows = []
        for text in texts:
            if "<|" in text and any(s in text for s in self.special):
                row = []
                for part in self.split(text):
                    row += [(part,)] if part in self.special else self.pieces(part)
                rows.append(row)
            else:
                rows.append(self.pieces(text))
        chunks = self.chunks
        if new := {c for row in rows for c in row if c not in chunks}:
            special = {c: (str(self.special[c[0]]), 1, c[0]) for c in new if c.__class__ is tuple}
            split = {c: self.find(c) for c in new if c.__class__ is str}
            if unknown := list({w for words in split.values() for w in words if w not in self.memo}):
                self.learn(unknown)
            memo = self.memo
            for c, words in split.items():
                e = [memo[w] for w in words]
                chunks[c] = e[0] if len(e) == 1 else (" ".join([x[0] for x in e]), sum([x[1] for x in e]), " ".join([x[2] for x in e]))
            chunks.update(special)
        return [[chunks[c] for c in row] for row in rows]

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.encode_all([text])[0] for i in e[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens joined by one space, unknown ids left out."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """One for each worker process, so that its memo outlives a task."""
    return WordBPE(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again; digests of both.

    One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    Null and empty texts have no tokens. Repeated rows and null ids stay; other
    columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = codec.encode_all([t or "" for t in batch.column(1).to_pylist()])
                sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([sum([e[1] for e in r]) for r in rows], pa.int64()), pa.array([sha([e[0] for e in r]) for r in rows], pa.string()), pa.array([sha([e[2] for e in r]) for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)
