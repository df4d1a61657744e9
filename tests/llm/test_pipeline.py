"""The pipeline's stages against brute force."""

import collections
import random
import re

import corpus_pipeline
from test_joins import docs, prose


def cut_passages(texts, n):
    """Texts without the words that a repeated run of ``n`` words covers."""
    at = [[m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", t)] for t in texts]
    words = [[t[a:b] for a, b in spans] for t, spans in zip(texts, at, strict=True)]
    seen = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for t, spans, w in zip(texts, at, words, strict=True):
        gone = bytearray(len(t))
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                a, b = spans[i][0], spans[i + n - 1][1]
                gone[a:b] = b"\1" * (b - a)
        out.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    return out


def test_small_hosts_lose_their_boilerplate_lines(spark):
    rng = random.Random(52)
    bodies = [prose(rng, 60, 10**6) for _ in range(12)]
    texts = [b + "\nfooter of six" * (i < 6) + "\nfooter of five" * (i >= 7) for i, b in enumerate(bodies)]
    got = corpus_pipeline.quality_rules(spark, docs(spark, texts), "").orderBy("doc_id").collect()
    assert [r.text for r in got] == [b + "\nfooter of five" * (i >= 7) for i, b in enumerate(bodies)]


def test_passages_of_over_fifty_short_words_are_cut(spark):
    rng = random.Random(51)
    passage = [rng.choice("abcdefghij") + rng.choice("aeiou") for _ in range(51)]
    long = prose(rng, 200).split()
    texts = [f"{prose(rng, 30, 10**6)} {' '.join(passage)} {prose(rng, 30, 10**6)}" for _ in range(6)]
    texts += [f"{prose(rng, 9, 10**6)}\n{' '.join(passage[:25])}\n{'  '.join(passage[25:])}\té {prose(rng, 9, 10**6)}"]
    texts += [f"{prose(rng, 40, 10**6)} {' '.join(passage[:50])} {prose(rng, 40, 10**6)}" for _ in range(3)]
    texts += [prose(rng, 20, 10**6) + " " + " ".join(long[rng.randint(0, 90) :]) + "\n\n" + prose(rng, 20, 10**6) for _ in range(8)]
    texts += ["", " ", "x", " ".join(passage), prose(rng, 300), *[prose(rng, 60)] * 2, "a " * 60]
    got = corpus_pipeline.repeated_passages(spark, docs(spark, texts), "").orderBy("doc_id").collect()
    assert [r.text for r in got] == cut_passages(texts, 51)
    assert [r.n_chars for r in got] == [len(r.text) for r in got]
    assert not any(" ".join(passage) in r.text for r in got) and " ".join(passage[:50]) in got[7].text
