"""Whole words, conversations and tables of a size that quadratic steps would not end on."""

import random

from pyspark.sql import functions as F

from textloom.llm import bpe_codec, chat_collapse
from textloom.llm.common import tokenizer_path


def plain_merge(codec, parts):
    """The best-ranked pair, leftmost first, by a scan for each merge."""
    parts = list(parts)
    while True:
        pairs = [(codec.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in codec.rank]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_equals_scans_and_is_fast_on_a_long_word():
    codec, rng = bpe_codec.WordBPE(tokenizer_path("word_bpe_49k.json")), random.Random(5)
    for _ in range(300):
        word = codec.symbols("".join(rng.choices("aeinrstho" if rng.random() < 0.5 else "abé", k=rng.randrange(1, 60))))
        parts = [*word[:-1], word[-1] + bpe_codec.END]
        assert codec.merge(parts) == codec._heaped(list(parts)) == plain_merge(codec, parts)
    long = codec.symbols("".join(rng.choices("aeinrstho", k=200_000)))
    assert "".join(codec.merge([*long[:-1], long[-1] + bpe_codec.END])) == long + bpe_codec.END
    assert codec.merge([]) == [] and codec.merge(["a"]) == ["a"]


def brute_collapse(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, v in convs.items():
        if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in convs.items()):
            kept[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)
    return kept


def test_collapse_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(60), rng.choice([None, 0, 1, 1]), rng.choice(["user", "", None]), rng.choice(["a", "b", None])) for _ in range(150)] + [(None, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, i int, last string")
    got = {r.conv_id: r for r in chat_collapse.collapse(df).collect()}
    assert {c: r.rendered for c, r in got.items()} == brute_collapse(rows)
    assert all(r.n_chars == len(r.rendered) for r in got.values())
    assert chat_collapse.collapse(df.limit(0)).count() == 0


def test_collapse_of_a_long_conversation_and_all_its_snapshots(spark):
    n = 100_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    shorter = turns.where(f"turn < {n // 2}").withColumn("conv_id", F.lit(0))
    other = turns.where("turn < 3").withColumn("conv_id", F.lit(5)).withColumn("text", F.concat("text", F.lit("!")))
    got = chat_collapse.collapse(turns.union(shorter).union(other)).select("conv_id", "n_turns").collect()
    assert sorted(r[:] for r in got) == [(1, n), (5, 3)]
