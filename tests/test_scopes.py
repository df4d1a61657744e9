"""Nesting, containment and spans against plain references."""

import random

from pyspark.sql import functions as F

from textloom.operators import contains, nesting

VOID, OPEN, CLOSE = 0, 1, -1


def stack_of(tokens):
    """(level, parent) of each token by a stack; ends beyond all starts close nothing."""
    out, stack = [], []
    for i, (_, kind) in enumerate(tokens):
        if kind == CLOSE:
            if stack:
                stack.pop()
            out.append((len(stack), stack[-1] if stack else None))
        else:
            out.append((len(stack), stack[-1] if stack else None))
            if kind == OPEN:
                stack.append(i)
    return out


def test_enclosing_scopes_against_a_stack(spark):
    rng = random.Random(1)
    docs = [[(rng.choice("abc"), rng.choice([OPEN, OPEN, CLOSE, CLOSE, VOID])) for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    rows = [(d, i, *t) for d, doc in enumerate(docs) for i, t in enumerate(doc)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, pos int, name string, kind int")
    got = {(r.k, r.pos): (r.level, r.parent, r.parent_name) for r in nesting.enclosing(df, "k", "pos", "kind", ["name"]).collect()}
    assert got == {(d, i): (*e, None if e[1] is None else doc[e[1]][0]) for d, doc in enumerate(docs) for i, e in enumerate(stack_of(doc))}
    assert nesting.enclosing(df.limit(0), "k", "pos", "kind").count() == 0


def test_nearest_naming_scope(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(30):
        stack = []
        for i in range(50):
            kind, names = rng.choice([OPEN, CLOSE, VOID]), rng.random() < 0.4
            if kind == CLOSE and stack:
                stack.pop()
            want[d, i] = next((j for j, n in reversed(stack) if n), None)
            if kind == OPEN:
                stack.append((i, names))
            rows.append((d, i, kind, names))
    df = spark.createDataFrame(rows, "k int, pos int, kind int, names boolean")
    assert {(r.k, r.pos): r.parent for r in nesting.enclosing_named(df, "k", "pos", "kind", "names").collect()} == want


def test_unclosed_and_stray_tags(spark):
    html = ["<ul><li>a<li>b</ul></i><b><i>x</b></i><br/><p>y</P>", "<!-- <b> --><script>if (a<b) '</p>'</script>", "", None, "<b>" * 3000 + "</b>" * 3000]
    tags = nesting.tags(spark.createDataFrame(list(enumerate(html)), "k int, html string"), "k", "html")
    found = nesting.enclosing(nesting.paired(tags, "k", "pos", "name", "kind"), "k", "pos", "kind", ["name"]).where("kind >= 0").orderBy("k", "pos").collect()
    shown = [(r.name, r.level, r.parent_name) for r in found if r.k == 0]
    assert shown == [("ul", 0, None), ("li", 1, "ul"), ("li", 1, "ul"), ("b", 0, None), ("i", 1, "b"), ("br", 0, None), ("p", 0, None)]
    assert [r.name for r in found if r.k == 1] == ["script"] and max(r.level for r in found if r.k == 4) == 2999


def test_calls_of_nested_functions(spark):
    code = "int f(int a) { if (a) { g(a); } while (h()) { } return (k(2)); } m(); class C { void p() { q(); } } }"
    got = nesting.call_sites(spark.createDataFrame([(1, code)], "id int, code string"), "id", "code").orderBy("pos").collect()
    assert [(r.callee, r.function) for r in got] == [("g", "f"), ("h", "f"), ("k", "f"), ("m", None), ("q", "p")]


def test_innermost_of_wide_spans(spark):
    rng = random.Random(3)
    spans = []

    def split(a, b):
        spans.append((1, a, b, f"{a}-{b}"))
        if b - a > 4:
            m = rng.randrange(a + 1, b)
            for x, y in ((a, m), (m + 1, b)):
                if rng.random() < 0.8:
                    split(x, y)

    split(0, 10**6)
    points = [(1, i, rng.randrange(-5, 10**6 + 6)) for i in range(300)] + [(2, 999, 5)]
    got = nesting.innermost(spark.createDataFrame(points, "k int, id int, at int"), spark.createDataFrame(spans, "k int, s int, e int, name string"), "k", "at", "s", "e", "id", ["name"])
    for r in got.collect():
        at = next(p[2] for p in points if p[1] == r.id)
        around = [s for s in spans if s[0] == r.k and s[1] <= at <= s[2]]
        assert r.level == len(around) and r.span_name == (min(around, key=lambda s: s[2] - s[1])[3] if around else None)


def test_patterns_by_automaton_and_by_grams(spark):
    rng = random.Random(4)
    letters = "abé "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(60)] + ["", None, "ab" * 20_000 + "needle in the end", "a" * 10**6]
    patterns = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [t[5:40] for t in texts[:30] if t and len(t) > 60] + ["needle in the end", "", None, "b" * 5000, "ab" * 3000, "a" * 40, "a"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(patterns)), "id long, p string")
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(patterns) if x and y and y in x}
    for limit in (contains.PATTERN_BYTES, 40):
        found = contains.containing(t, "id", "text", p, "id", "p", pattern_bytes=limit).select("text_id", "pattern_id").collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert contains.containing(t, "id", "text", p.where(F.lit(False)), "id", "p").count() == 0


def test_automaton_pieces_meet(monkeypatch):
    monkeypatch.setattr(contains, "PIECE", 7)
    monkeypatch.setattr(contains, "STEP", 3)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 90))) for _ in range(30)]
    patterns = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    assert contains.Automaton(patterns).search(texts) == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(patterns) if y in x}
