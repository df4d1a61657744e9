"""Exact token counts at every prefix, by dynamic programming.

The vocabulary's pieces never hold a word mark after another character, so a
text's encoding is that of its words one after another. Within a word the
encoding of a prefix is that of a shorter prefix plus one last token: of all
pieces that end at a position, exactly one forms, with the last token before
it, a pair which merging leaves as it is. The table of counts over a word's
prefixes is made once a distinct word and kept; counts at any prefix of a text,
truncation points and budget questions are then sums and lookups.

New words are tabulated in sorted order: the table of the word before is kept as
far as the two begin alike, so a beginning that many words share costs one step
a character, not one for each of the words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, arrow_map, tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chars long"
MARK = "▁"
NONE = float("-inf")
#: Characters of texts whose words are tabulated together.
CHUNK = 4_000_000
_PARTS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_LAST = itemgetter(-1)


class PrefixCounter:
    """Token counts of a sentencepiece BPE model with byte fallback, at every prefix."""

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.ends: dict[str, set[int]] = {}  # last four characters of pieces -> lengths of such pieces
        for p in self.score:
            if len(p) > 3:
                self.ends.setdefault(p[-4:], set()).add(len(p))
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}  # neighbours within a piece
        self.lengths = Memo(self._lengths, 200_000)
        self.order = {p: i for i, p in enumerate(sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p]))}
        self.never = len(self.order)
        self.odd: set[str] = set()  # pieces that rank before a part of theirs: of these pairs are merged step by step
        self.halves = Memo(self._halves, 100_000)
        self.pairs = Memo(self._stays, limit)
        self.limit = limit
        self.spaced: dict[str, bytes | array] = {}  # tables of words after a mark, which their names leave out
        self.bare: dict[str, bytes | array] = {}  # tables of other parts, as they are

    def merged(self, text: str, until: str | None = None) -> list[str]:
        """Exact merging: again and again the best-scored adjacent pair, leftmost first; ``until`` is not merged."""
        parts = list(text)
        get = self.score.get
        gains = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == NONE:
                break
            at = gains.index(best)
            if parts[at] + parts[at + 1] == until:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(gains):
                gains[at] = get(parts[at] + parts[at + 1], NONE)
        return parts

    def _stays(self, pair: tuple[str, str]) -> bool:
        """Whether merging leaves the pair as it is ("" first: the piece alone).

        Merges of the two are undone, latest first; at each state the neighbours
        at the border must not merge before the merge just undone.
        """
        a, b = pair
        if self.halves[b] is None or a and self.halves[a] is None:
            return False
        if a in self.odd or b in self.odd:
            return self.merged(a + b) == ([a, b] if a else [b])
        if not a or a[-1] + b[0] not in self.inside:  # no piece reaches over the border
            return True
        order, halves, before = self.order, self.halves, self.never
        while True:
            if order.get(a + b, self.never) < before:
                return False
            x, y = order[a] if len(a) > 1 else -1, order[b] if len(b) > 1 else -1
            if x > y:
                before, a = x, halves[a][1]
            elif y >= 0:
                before, b = y + 1, halves[b][0]  # of equal merges the left one comes first
            else:
                return True

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None if merging doesn't give the piece."""
        if len(piece) == 1:
            return piece, piece
        parts = self.merged(piece, piece)
        if len(parts) != 2:
            return None
        if any(len(p) > 1 and (self.halves[p] is None or p in self.odd or self.order[p] >= self.order[piece]) for p in parts):
            self.odd.add(piece)
        return parts[0], parts[1]

    def _lengths(self, tail: str) -> tuple[int, ...]:
        """Lengths that a piece may have which ends in these (at most four) characters."""
        return *sorted(self.ends.get(tail, ()), reverse=True), *(n for n in (3, 2, 1) if n <= len(tail) and tail[-n:] in self.score)

    def tables(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Counts at each prefix (index 0: the empty one) of words given in sorted order; the list is reused."""
        last, count, before = [""], [0], ""
        score, pairs, lengths = self.score, self.pairs, self.lengths
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            before = word
            for end in range(same + 1, len(word) + 1):
                ch = word[end - 1]
                if ch not in score:  # spelt in bytes, merges with nothing
                    last.append("")
                    count.append(count[-1] + len(ch.encode("utf-8", "surrogatepass")))
                    continue
                for n in lengths[word[end - 4 : end] if end > 4 else word[:end]]:
                    start = end - n
                    if start >= 0 and (piece := word[start:end]) in score and pairs[last[start], piece]:
                        last.append(piece)
                        count.append(count[start] + 1)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            yield word, count

    def _learn(self, spaced: set[str], bare: set[str]) -> None:
        """Tabulate words not known yet; once the memo is full it starts anew."""
        if len(self.spaced) + len(self.bare) > self.limit:
            self.spaced.clear()
            self.bare.clear()
        kept = lambda count: bytes(count) if max(count) < 256 else array("I", count)
        self.bare.update((w, kept(c)) for w, c in self.tables(sorted(bare - self.bare.keys())))
        self.spaced.update((w[1:], kept(c)) for w, c in self.tables(sorted(MARK + w for w in spaced - self.spaced.keys())))

    @staticmethod
    def _parts(text: str) -> tuple[list[str], list[str], int]:
        """Words after a mark, other parts, and line feeds of a text with its dummy mark.

        A line feed is spelt as a byte: no merge crosses it, and no mark follows it.
        """
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            every = _PARTS.findall(MARK + text.replace(" ", MARK))
            return [], [p for p in every if p != "\n"], text.count("\n")
        first, *lines = text.split("\n")
        spaced, bare = first.split(" "), []
        for line in lines:
            head, *rest = line.split(" ")
            bare.append(head)
            spaced += rest
        return spaced, bare, len(lines)

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts; their words' tables are known afterwards."""
        parts = [self._parts(t) if t else ([], [], 0) for t in texts]
        self._learn(set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)))
        spaced, bare = self.spaced.__getitem__, self.bare.__getitem__
        return [sum(map(_LAST, map(spaced, a))) + sum(map(_LAST, map(bare, b))) + n for a, b, n in parts]

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def _ordered(self, text: str) -> Iterator[tuple[int, bytes | array]]:
        """Parts in order: number of characters, dummy mark included, and table."""
        for part in _PARTS.findall(MARK + text.replace(" ", MARK)):
            name = part[1:] if part[0] == MARK else part
            known = (self.spaced if part[0] == MARK else self.bare).get(name) if part != "\n" else b"\0\1"
            if known is None:
                known = self.bare.get(part) or next(self.tables([part]))[1]
            yield len(part), known

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: the token count of the text's first i characters."""
        if not text:
            return np.zeros(1, np.int64)
        out, base = [], 0
        for _, table in self._ordered(text):
            out.append(base + np.array(list(table[1:]), np.int64))
            base += table[-1]
        # the dummy mark is no character of the text
        return np.concatenate([np.zeros(1, np.int64), np.concatenate(out)[1:]])

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, by the tables of its words."""
        at = -1  # the dummy mark
        for n, table in self._ordered(text) if text else ():
            if table[-1] > budget:
                return max(0, at + max(i for i, c in enumerate(table) if c <= budget))
            budget -= table[-1]
            at += n
        return len(text)


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each worker process, so that its memo outlives a task."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, limit: int = 4096, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts, and the longest prefix within ``limit`` tokens.

    One row per input row: ``doc_id, n_bytes, n_tokens, over_limit,
    budget_chars``. Null and empty texts: zeros, not over. Repeated rows and
    null ids stay. Other columns are ignored; an empty table gives no rows.
    """
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            texts, n, fits = [t or "" for t in batch.column(1).to_pylist()], [], []
            ends = np.cumsum([len(t) for t in texts]) // CHUNK
            for chunk in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                some = [texts[i] for i in chunk]
                found = counter.counts(some)
                n += found
                fits += [len(t) if c <= limit else counter.longest_prefix(t, limit) for t, c in zip(some, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([c > limit for c in n]), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_chars"],
            )

    return arrow_map(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)
