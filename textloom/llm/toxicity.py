"""Toxicity with noisy-channel deobfuscation.

Channel: a writer replaces letters by look-alikes, puts marks or spaces between
letters and repeats letters. A suspicious token (letters mixed with digits or
marks, single letters in a row, a letter thrice) opens a lattice: each position
may be read as a letter it resembles, as nothing, or as one more of the letter
before. Viterbi decoding under a character trigram model, counted over all
texts of the corpus, gives the likeliest spelling, which is scored beside the
token as written.

Score: words, and word beginnings that several words share, whose presence goes
with the label in training documents are evidence; a logistic regression weighs
how much of it a text holds against its length. Evidence is learnt from one part
of the labelled documents outside the held-out fold, the regression from the
rest; ``max_train`` bounds both together (in the order of a hash of the id, so
the bound samples evenly). Of copies and near copies one is learnt from, so that
they don't make their rare words evidence: texts are named by the least hash of
their word shingles, which near copies share as often as they share shingles.
What is shuffled are words with their counts, summed by each task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, arrow_map, cut
from .parity_join import shingles

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Letters of the character model; index 0 is the word boundary, 1 any other letter.
ALPHABET = "\x00\x01abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøœùúûüýÿß"
CODE = {c: i for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET)
#: Letters that a sign may stand for (fixed values).
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "*": "aeiou", "?": "aeiou", "%": "o", "&": "ae",
}
SEPARATORS = " .-_*~'’`^/\\,:;|+#"
#: Costs (negative log probabilities) of the channel's steps.
AS_WRITTEN, LOOK_ALIKE, DROPPED, REPEATED = 0.05, 1.2, 1.0, 0.7
_SINGLES = re.compile(r"\b\w[ .\-_*]\w(?!\w)(?:[ .\-_*]\w(?!\w))+")  # single letters in a row
_MIXED = re.compile(  # within what white space leaves whole
    r"[^\W\d_]+(?:[\d@$!|+(<{€£¡*#%&?.\-_]+[^\W\d_]+)+"  # signs between letters
    r"|[@$!|(0-9]+[^\W\d_]+|[^\W\d_]+[0-9$@]+"  # signs before or after letters
)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")  # a letter three times
_AROUND = re.compile(r"\w*")
_WORD = re.compile(r"[^\W\d_]+")


class Decoder:
    """Viterbi decoding of character lattices under a trigram model."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()  # [a * SIZE + b][c]: negative log probability of c after ab
        self.memo = Memo(self._decode, 200_000)

    def __call__(self, token: str) -> str:
        return self.memo[token]

    def _decode(self, token: str) -> str:
        """States are the last two letters; each keeps its cheapest path."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for ch in token:
            reads: list[tuple[str, float]] = []
            if ch in CODE and CODE[ch] > 1:
                reads.append((ch, AS_WRITTEN))
            elif ch.isalpha():
                reads.append((ch, AS_WRITTEN))
            reads += [(c, LOOK_ALIKE) for c in LOOKS_LIKE.get(ch, "")]
            drop = DROPPED if ch in SEPARATORS or not ch.isalpha() else None
            following: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (spent, text) in states.items():
                row = self.cost[a * SIZE + b]
                for letter, price in reads:
                    c = CODE.get(letter, 1)
                    total = spent + price + row[c]
                    if (b, c) not in following or total < following[b, c][0]:
                        following[b, c] = (total, text + letter)
                    if text and text[-1] == letter and (state := (a, b)) and (state not in following or spent + REPEATED < following[state][0]):
                        following[state] = (spent + REPEATED, text)
                if drop is not None and ((a, b) not in following or spent + drop < following[a, b][0]):
                    following[a, b] = (spent + drop, text)
            states = following or states
        return min((spent + self.cost[a * SIZE + b][0], text) for (a, b), (spent, text) in states.items())[1]


def suspects(low: str) -> set[str]:
    """What looks obfuscated in a lower-case text."""
    found = {m.group() for m in _SINGLES.finditer(low)}
    for token in set(low.split()):
        core = token.rstrip(".,")
        if not core.isalpha():
            found.update(_MIXED.findall(core))
    for m in _TRIPLE.finditer(low):
        start = m.start()
        while start and (low[start - 1].isalnum() or low[start - 1] == "_"):
            start -= 1
        found.add(_AROUND.match(low, start).group())
    return found


def words_of(text: str, decode) -> set[str]:
    """Distinct lower-case words as written, and as restored where they look obfuscated."""
    low = text.lower()
    found = set(_WORD.findall(low))
    for token in suspects(low):
        found.update(_WORD.findall(decode(token)))
    return found


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram costs from the words of all texts: ``[SIZE * SIZE, SIZE]``, smoothed."""
    table = {ord(c): i for c, i in CODE.items() if i > 1}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        lookup = np.zeros(65536, np.int64)
        lookup[[c for c in range(65536) if chr(c).isalpha()]] = 1
        for c, i in table.items():
            lookup[c] = i
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
                    codes = np.concatenate(([0, 0], lookup[np.minimum(points, 65535)], [0]))
                    inner = codes[:-2].copy()
                    inner[codes[1:-1] == 0] = 0  # nothing before a boundary counts
                    tri = (inner * SIZE + codes[1:-1]) * SIZE + codes[2:]
                    total += np.bincount(tri, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    counted = arrow_map(docs.select(docs[text_col].cast("string").alias("text")), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(SIZE**3)
    for r in counted.toLocalIterator():  # at most SIZE^3 rows, whatever the corpus
        n[r.code] = r.n
    n = n.reshape(SIZE * SIZE, SIZE)
    n[0, 0] = 0  # boundaries after boundaries
    pairs = n.reshape(SIZE, SIZE, SIZE).sum(axis=0)
    backed = (pairs + 0.5) / (pairs + 0.5).sum(axis=1, keepdims=True)
    return -np.log((n + 5 * np.tile(backed, (SIZE, 1))) / (n.sum(axis=1, keepdims=True) + 5))


def held_out(doc_id) -> F.Column:
    """Whether a document belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


class Model:
    """Feature weights and a logistic regression over what a text holds of them."""

    def __init__(self, weights: dict[str, float]):
        self.words = {f: w for f, w in weights.items() if f[-1:] != "~"}
        self.begins = {f[:-1]: w for f, w in weights.items() if f[-1:] == "~"}
        self.heads = {f[:3] for f in self.begins}
        self.beta = np.zeros(6)
        self.beta[0] = -3.0

    def best(self, word: str) -> float:
        """Weight of the longest known feature of a word."""
        if (weight := self.words.get(word)) is not None:
            return weight
        if word[:3] in self.heads:
            for n in range(min(8, len(word) - 1), 2, -1):
                if (weight := self.begins.get(word[:n])) is not None:
                    return weight
        return 0.0

    def measures(self, text: str | None, decode) -> list[float]:
        words = words_of(text or "", decode)
        found = sorted((q for q in map(self.best, words) if q > 0), reverse=True)
        total, n = sum(found), max(1, len(words))
        return [1.0, math.log1p(total), found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, min(1.0, 10 * total / n), math.log(n)]

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> None:
        """Newton steps of a ridge logistic regression."""
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.beta = beta

    def __call__(self, text: str | None, decode) -> float:
        z = float(np.dot(self.beta, self.measures(text, decode)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def weigh(counts: list[tuple[str, int, int]], docs1: int, docs0: int, most: int = 4) -> dict[str, float]:
    """Log odds ratios (positive; 0 for a feature known to say nothing), at the cautious end of their spread."""
    out = {}
    for f, n1, n0 in counts:
        ratio = math.log((n1 + 0.5) / (docs1 + 1)) - math.log((n0 + 0.5) / (docs0 + 1))
        out[f] = min(most, max(0.0, ratio - math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))))
    return out


def group_name(text: str) -> int:
    """Of a text and most of its near copies: the least hash of its five-word shingles."""
    found = shingles(text, 5)
    return int(found[:1].view(np.int64)[0]) if len(found) else 0


def training_sample(docs: DataFrame, labels: DataFrame, max_train: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``text, y, part`` of at most ``max_train`` labelled documents outside the held-out fold, one for each group of copies and label."""
    rated = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = rated.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text is not null")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([group_name(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=["doc_id", "text", "y", "name"])

    found = arrow_map(rows.join(F.broadcast(chosen), "doc_id"), named, "doc_id long, text string, y int, name long")  # broadcast: max_train rows of two numbers
    return cut(found.groupBy("name", "y").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "y", F.expr("pmod(xxhash64(name), 10)").alias("part")))


def evidence(sample: DataFrame, cost: np.ndarray, least: int) -> dict[str, float]:
    """Weights of features, from ``text, y`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, seen = Decoder(cost), ({}, {})
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = seen[y]
                for w in words_of(text, decode) | {""}:  # "" counts the texts
                    if not w or 2 < len(w) < 40:
                        mine[w] = mine.get(w, 0) + 1
        for y, mine in enumerate(seen):  # at most the words of the sample
            yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.string()), pa.array(list(mine.values()), pa.int64()), pa.array([y] * len(mine), pa.int32())], names=["w", "n", "y"])

    counts = arrow_map(sample.select("text", "y"), run, "w string, n long, y int")
    words = counts.groupBy("w").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (1, 0)))
    begins = "transform(sequence(3, 8), n -> IF(length(w) > n, concat(left(w, n), '~'), NULL))"
    counted = words.select(F.explode(F.expr(f"array_compact(array_append({begins}, w))")).alias("f"), "n1", "n0")
    counted = counted.groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count(F.when(F.col("n1") > 0, 1)).alias("words"))
    # a beginning is evidence only if several words with it are; one word speaks for itself. Bounded by the sample.
    kept = counted.where((F.col("n1") + F.col("n0") >= least) & ((F.substring("f", -1, 1) != "~") & (F.col("n1") + F.col("n0") >= 3 * least) | (F.col("words") >= 4) & (F.col("n1") > F.col("n0") / 8) | (F.col("f") == ""))).collect()
    totals = next(((r.n1, r.n0) for r in kept if r.f == ""), (0, 0))
    return weigh([(r.f, r.n1, r.n0) for r in kept if r.f], *totals)


def learn(docs: DataFrame, labels: DataFrame, cost: np.ndarray, max_train: int = 20_000, least: int = 6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit the model on at most ``max_train`` labelled documents outside the held-out fold."""
    sample = training_sample(docs, labels, max_train, id_col, text_col, label_col)
    return fitted(sample.where("part < 7"), sample.where("part >= 7"), cost, least)


def fitted(words: DataFrame, weighed: DataFrame, cost: np.ndarray, least: int = 6) -> Model:
    """A model with its evidence from some ``text, y`` rows and its regression from others."""
    model = Model(evidence(words, cost, least))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, names = Decoder(cost), [f"x{i}" for i in range(6)]
        for batch in batches:
            x = np.array([model.measures(t, decode) for t in batch.column(0).to_pylist()]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(6)] + [batch.column(1)], names=[*names, "y"])

    got = arrow_map(weighed.select("text", "y"), measure, ", ".join(f"x{i} double" for i in range(6)) + ", y int").collect()
    if got and 0 < sum(r.y for r in got) < len(got):
        table = np.array([tuple(r) for r in got], float)
        model.fit(table[:, :6], table[:, 6])
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score whole texts: ``doc_id, held_out, score, predicted``, one row per input row.

    Null and empty texts get the score of no evidence. Documents without an id
    are scored, not held out. Repeated rows score alike; labels that are null
    don't count, of clashing ones the greater does. Without labels all texts
    get the same low score. Other columns are ignored; an empty table gives no rows.
    """
    cost = character_model(docs, text_col)
    model = learn(docs, labels, cost, max_train, id_col=id_col, text_col=text_col, label_col=label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(cost)
        for batch in batches:
            scores = [model(t, decode) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(rows.withColumn("held_out", held_out(F.col("doc_id"))), run, SCHEMA)
