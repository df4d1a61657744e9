"""Conversation repair, exact deduplication and ranked search against plain references."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF
from test_catalog import rows_of

from textloom.llm import catalog, chat_repair, exact_dedup, lexical_search, pii

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_ranked_search"])
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    r = duck.sql(catalog.ORACLE_SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of(list(r.columns), r.fetchall())


# ---------------------------------------------------------------- conversation repair


def first_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Layered dynamic programme over (cost, audit, output)."""
    then = lambda state, role: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))
    best = {"": (0, "", ())}

    def better(table, state, entry):
        if state is not None and entry < table.get(state, (10**9,)):
            table[state] = entry

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, then(state, role[0]), (cost + 5, audit + "I", (*out, (role, ""))))
        return table

    best = inserted(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, out) in best.items():
            better(after, state, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                better(after, then(state, role[:1]), (cost + more, audit + "K", (*out, (role, text))))
                for new in ("user", "assistant"):
                    better(after, then(state, new[0]), (cost + more + 1, audit + "R", (*out, (new, text))))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def every_audit(codes):
    """All edit sequences with up to two insertions a gap: least (cost, audit) whose roles the grammar accepts."""
    gaps = [("",), *([x] for x in ("u", "a", "ua", "au", "uu", "aa"))]
    rows = [[("D", "", 2)] + ([] if c == "-" else [("K", c.lower(), 5 * c.isupper()), ("R", "u", 1 + 5 * c.isupper()), ("R", "a", 1 + 5 * c.isupper())]) for c in codes]
    found = []
    for picked in itertools.product(*rows):
        for put in itertools.product([g[0] for g in gaps], repeat=len(codes) + 1):
            roles = put[0] + "".join(r + g for (_, r, _), g in zip(picked, put[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((sum(p for _, _, p in picked) + 5 * sum(map(len, put)), "I" * len(put[0]) + "".join(e + "I" * len(g) for (e, _, _), g in zip(picked, put[1:], strict=True))))
    return min(found)


def test_shortest_paths_are_the_least_of_all_edit_sequences():
    rng = random.Random(11)
    cases = ["", *"sua-SUAxX", *("".join(rng.choice("suaxSUA-") for _ in range(rng.choice([2, 2, 3]))) for _ in range(16))]
    for codes in cases:
        (_, cost, audit), *_ = chat_repair.shortest(codes, chat_repair.START, True)
        assert (cost, audit) == every_audit(codes), codes


def reference(conversations):
    """The contract's rows in plain Python."""
    rows = collections.defaultdict(list)
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv in {c for c, *_ in conversations}:
        own = sorted(rows[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [(r, t) for _, r, t in own]
        faults = first_faults(pairs)
        cost, audit, fixed = cheapest(pairs, faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return sorted(out, key=repr)


def reports(df):
    return sorted((tuple(r) for r in chat_repair.reports(chat_repair.damaged(df), df).collect()), key=repr)


def test_conversations_against_the_reference(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert reports(df) == reference([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_conversations_in_blocks_of_three_rows(spark, monkeypatch):
    monkeypatch.setattr(chat_repair, "BLOCK", 3)
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "unknown", "tool", "", None]), rng.choice(["Yes.", "No!\n", "cut", "", " \t", None, f"{c} {t}?"])) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (77, None, "user", None), (78, 3, "user", "x" * 10**6 + "."), (79, 5, "user", "." + " " * 10**5 + "x"), *[(80, t, "user", "same.") for t in range(400)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", cost int").repartition(7)
    assert reports(df) == reference(rows)


def test_repaired_rows_and_an_empty_table(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Why?"), (2, 0, "user", " ")], TURNS)
    got = chat_repair.repair(turns).orderBy("conv_id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 1, "user", "", "I"), (1, 2, "assistant", "Hi.", "K"), (1, 3, "user", "Why?", "K"), (1, 4, "assistant", "", "I")] or [r.edit for r in got]
    assert chat_repair.repair(turns.limit(0)).count() == 0 and chat_repair.reports(turns.limit(0), turns.limit(0)).count() == 0


# ---------------------------------------------------------------- exact deduplication


def test_groups_of_equal_texts(spark):
    rng = random.Random(5)
    texts = ["a  b", "a\tb", "a b ", " a b", "", None, "\n", "x" * 70 + "y", "x" * 70 + "z", "x" * 70 + "y", "é" * 10**6, "é" * 10**6, " " * 10**6, "only"] + [f"t{rng.randrange(40)}" + " " * rng.randrange(1, 4) + "q" for _ in range(300)]
    rows = [(None if i % 50 == 7 else i // 2, t, i, "old") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, kept string").repartition(5)
    got = {r.n: r for r in exact_dedup.deduplicate(df).collect()}
    groups = collections.defaultdict(list)
    for doc_id, text, n, _ in rows:
        groups[re.sub(r"[ \t\n\v\f\r]+", " ", text or "")].append((doc_id is None, doc_id, n))
    assert len(got) == len(rows)
    for members in groups.values():
        assert {(got[n].keep_id, got[n].group_size) for _, _, n in members} == {(min((m[0], m[1] or 0) for m in members)[1] if any(not m[0] for m in members) else None, len(members))}
        (kept,) = [n for _, _, n in members if got[n].kept]
        assert rows[kept][0] == got[kept].keep_id
    assert all(got[n].text == t for n, t in enumerate(texts))
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0


def test_slots_are_shared_without_harm(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLOTS", 4)
    df = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.digests(df).collect()) == [(i, i % 90, 2 if i % 90 < 10 else 1) for i in range(100)]


# ---------------------------------------------------------------- ranked search


def test_search_of_a_range_is_exact_and_opens_few_nodes():
    rng = np.random.default_rng(3)
    n, k = 20_000, 10
    term, doc = rng.integers(0, 50, 200_000), rng.integers(0, n, 200_000)
    term, doc = np.unique(np.stack([term, doc]), axis=1)
    gain = rng.integers(0, 4, len(term)) ** 6
    ids = [None if i % 97 == 0 else int(x) for i, x in enumerate(rng.permutation(n) - 500)]
    tree = lexical_search.Range(term, doc, gain)
    for query, times in (([3], [1]), ([1, 4, 9, 30], [1, 2, 1, 5]), (list(range(50)), [1] * 50), ([49, 48], [3, 1])):
        kept: list = []
        opened = lexical_search.search_range(tree, ids, np.array(query), np.array(times), kept, k)
        score = np.zeros(n, np.int64)
        for t, q in zip(query, times, strict=True):
            score[doc[term == t]] += q * gain[term == t]
        best = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-score[i], ids[i] is None, ids[i] or 0))[:k]
        assert sorted((-s, not known, -least) for s, known, least in kept) == [(-score[i], ids[i] is None, ids[i] or 0) for i in best]
    top = np.r_[gain, np.full(40, 10**6)]
    tree = lexical_search.Range(np.r_[term, np.full(40, 60)], np.r_[doc, np.arange(40) * 500], top)
    kept = []
    assert lexical_search.search_range(tree, ids, np.array([60, 3, 4]), np.array([1, 1, 1]), kept, k) < 64 and all(s >= 10**6 for s, *_ in kept)


def test_odd_texts_ties_and_blocks(spark, monkeypatch):
    docs = [(1, "The cat, the CAT"), (2, "cat the cat the"), (None, "cat the cat the"), (3, "Ünï-cøde ÉÉ x1"), (4, ""), (5, None), (6, "..."), (7, "dog\x00cat\x7fdog"), (7, "dog\x00cat\x7fdog"), (8, "w " * 300_000 + "cat"), (9, "z" * 10**6)] + [(i, f"cat n{i}") for i in range(20, 40)]
    items = [(1, "CAT cat"), (2, "É ÉÉ cøde"), (3, ""), (4, None), (5, "nothing"), (6, "dog " * 3 + "the"), (7, "w z" + "z" * 999)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = duckdb.connect()
    want.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)").executemany("INSERT INTO documents VALUES (?, ?)", [r for r in docs if r[0] is not None or True])
    want.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)").executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    # repeated rows are found one by one: the SQL over (doc_id) would sum them up, so rows are numbered there
    want.execute("CREATE TABLE numbered AS SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS doc_id, text, doc_id AS own FROM documents")
    sql = lexical_search.ORACLE_SQL.replace("FROM documents", "FROM numbered")
    ref = sorted(want.sql(f"SELECT item_id, rank, own, score FROM ({sql}) JOIN numbered USING (doc_id)").fetchall(), key=repr)
    for most in (5_000, 2):
        monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", most)
        assert sorted((tuple(r) for r in lexical_search.search(d, q).collect()), key=repr) == ref
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0


# ---------------------------------------------------------------- surrogates for personal data


def replaced(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace_personal_data(df, key).orderBy("doc_id").collect()]


def test_surrogates_survive_runs_of_any_length(spark):
    many = 10**6
    hostile = ["a@" + "b." * 10**5 + "com", "x" * many, "7" * many, "a@" * 10**5, "a." * 10**5 + "@b.com", "token=" + "Ab1/" * 50_000, "Mr " + "A" * many, "+1" * 10**5, ("ab1" * 30 + " ") * 3_000, "a@b." + "c" * many, "1.2." * 10**5, "Mr X" * 10**5, "-" * many + "@", "\n" * many]
    got = replaced(spark, hostile + ["mail me: jo@mail.example.org."])
    assert "jo@" not in got[-1] and got[-1].endswith(".org.") and got[1] == hostile[1] and hostile[5][6:50] not in got[5]
    assert len(got[5]) == len(hostile[5])


def test_distinct_entities_stay_distinct_and_each_has_one_surrogate(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"{a}{b}{c}" for a in ("Ab", "Cer", "Dov", "Eln") for b in ("an", "ok", "ir", "um", "es") for c in ("sen", "ti", "ra", "lov", "det")]
    mails = [f"{n.lower()}{i}@host{i % 7}.example.com" for i, n in enumerate(names)] + [f"{c}@x.org" for c in "abcdefghijklmnopqrst"]
    phones = [f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}" for _ in range(80)]
    entities = [("Mr " + n, "Dr " + n) for n in names] + [(m, m.upper()) for m in mails] + [(p, f"({p[:3]}) {p[4:]}") for p in sorted(set(phones))]
    for small in (False, True):  # with four family names, a first draw can't hold the hundred
        if small:
            monkeypatch.setattr(pii, "SYLLABLES", ["ba", "do"])
            monkeypatch.setattr(pii, "FAMILY_ENDS", ["n"])
        got = replaced(spark, [f"{a} and {b}" for a, b in entities])
        plain = [re.sub(r"\W", "", re.sub(r"^(Mr|Dr) ", "", side)).lower() for text in got for side in text.split(" and ")]
        assert plain[::2] == plain[1::2]
        assert len(set(plain[::2])) == len(entities)
        assert not {re.sub(r"\W", "", re.sub("^Mr ", "", a)).lower() for a, _ in entities} & set(plain)


def test_account_numbers_keep_their_check_number(spark):
    remainder = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
    valid, broken = "DE89370400440532013000", "GB82WEST12345698765433"
    a, b, c = replaced(spark, [valid, "DE89 3704 0044 0532 0130 00", broken])
    assert a != valid and a[:2] == "DE" and remainder(a) == 1 and b.replace(" ", "") == a and remainder(broken) != 1 and c != broken
