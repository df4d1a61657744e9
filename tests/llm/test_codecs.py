"""Tokenizing operators against the libraries, on texts of the tables and on odd ones."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF

from textloom.llm import bpe_codec, packing, token_counts, winnow
from textloom.llm.common import tokenizer_path

ODD = ["", "  hello  world ", "a\tb\n\n c", "ÉÀÇ ß İI ΣΑΣ ς ﬁ Å é 中文 🙂🙂 x\x1c\x85\xa0y", "don't I'LL we've 'S", "<|endoftext|> x <|startoftext|>y<|endoftext|>", " <s> </s> ▁▁a ▁", "x" * 300, "\na b\n", "a\n\n\nb", "x \ny", "\x00\x01abc"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    letters = "ab eé\n\t'sSΣ1²<|>中🙂 ▁\xa0."
    fuzz = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    return ODD + fuzz + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")


def test_codec_agrees_with_the_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe_codec.encode_documents(frame(spark, texts)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate([*texts, ""]):
        ids = lib.encode(t, add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))), repr(t[:80])


def test_codec_round_trip_and_exact_path():
    codec = bpe_codec.WordBPE(tokenizer_path("word_bpe_49k.json"))
    for word in ("therehanding", "stupid", "élève", "xqzxqz"):
        s = codec.symbols(word)
        assert codec.encode(word) == codec.exact(s)
        assert codec.decode(codec.encode(word)) == " ".join(codec.text_of[i] for i in codec.exact(s))


def test_counts_agree_with_the_library_at_every_prefix(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), limit=50).collect()}
    for i, t in enumerate([*texts, ""]):
        r, n = got[i], len(sp.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 50), repr(t[:80])
        assert len(sp.encode(t[: r.budget_chars])) <= 50
    counter = token_counts.PrefixCounter(tokenizer_path("piece_bpe_32k.model"))
    for t in texts[:80]:
        t = t[:200]
        assert counter.prefix_counts(t).tolist() == [len(sp.encode(t[:k])) for k in range(len(t) + 1)], repr(t)


def test_packing_is_gapless_whole_and_tight(spark, texts):
    import zlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(frame(spark, texts).selectExpr("*", "7 AS start", "8 AS length")).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate([*texts, ""]):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids), repr(t[:80])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(r.length for r in rows)
    assert used / (len(bins) * 1024) > 0.9


def test_packing_cuts_fill_reciprocal_classes():
    for n in (1, 63, 64, 700, 1024, 3000):
        assert sum(packing.cuts(n, 1024)) == n and max(packing.cuts(n, 1024)) <= 1024


def test_winnowing_guarantee_and_ties():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(60))
    a = "".join(rng.choice("abcdefgh ") for _ in range(300)) + shared
    b = shared + "".join(rng.choice("abcdefgh ") for _ in range(300))
    fa, fb = winnow.winnow(a, 16, 32), winnow.winnow(b, 16, 32)
    assert set(fa[0].tolist()) & set(fb[0].tolist())  # 60 >= 16 + 32 - 1
    h, pos = winnow.winnow("a" * 200, 16, 32)
    assert pos.tolist() == list(range(31, 185))  # rightmost on ties
    assert len(winnow.winnow("")[0]) == 0 and len(winnow.winnow("ab")[0]) == 1


def test_fingerprints_meet_their_successors(spark, texts):
    rows = {r.doc_id: r for r in winnow.fingerprints(frame(spark, texts)).collect()}
    every = [*texts, ""]
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        after = every[i - 1]  # descending ids; the first one follows the last
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.fingerprint == winnow.show(winnow.winnow(t)) and r.edited_fingerprint == winnow.show(winnow.winnow(edited))
        assert r.near_next == winnow.likeness(winnow.winnow(t)[0], winnow.winnow(after)[0])


@pytest.mark.parametrize("op", [bpe_codec.encode_documents, token_counts.count_tokens, packing.pack, winnow.fingerprints])
def test_empty_table_repeated_rows_and_null_ids(spark, op):
    assert op(frame(spark, ["x"]).where("doc_id < 0")).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert op(df).count() == 4
    assert op(frame(spark, []).limit(1)).count() == 1
