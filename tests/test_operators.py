"""Semantics that single operators pin down."""

from pyspark.sql import functions as F

from textloom.functions import comments
from textloom.functions import paths as px
from textloom.functions import text as fx
from textloom.operators import asof, caps, chain, coverage, dedupe, frameworks, graph, pack, resolve, snapshot
from textloom.streaming import seen


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_anchors_do_not_move_with_dropped_rows(spark):
    df = spark.createDataFrame([("f", a, a) for a in (9, 0, 6, 3)], "k string, at long, id long")
    assert sorted(r.at for r in dedupe.anchored_collapse(df, ["k"], "at", 3, "id").collect()) == [0, 6]


def test_min_known_line_ignores_zero(spark):
    df = spark.createDataFrame([("a", 0), ("a", 7), ("a", 5), ("b", 0)], "k string, line int")
    assert dict(dedupe.keep_min_known(df, ["k"], "line").collect()) == {"a": 5, "b": None}


def test_definition_prefers_what_is_no_double(spark):
    df = spark.createDataFrame([("f", True, 1, "t.py"), ("f", False, 2, "a.py"), ("f", False, 3, "b.py"), ("g", True, 4, "t.py")], "name string, test boolean, ord int, file string")
    assert dict(dedupe.definitions(df, "name", F.col("test"), "ord", "file").collect()) == {"f": "a.py", "g": "t.py"}


def test_fair_cap_is_round_robin(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 1), ("c", 2)], "k string, i int")
    got = caps.fair_cap(df, "k", [F.asc("i")], 6).orderBy("pick").select("k", "i").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("b", 1), ("c", 1), ("a", 1), ("c", 2), ("a", 2)]


def test_systematic_sample_matches_its_formula(spark):
    for n, limit in ((7, 3), (10, 10), (25, 4), (3, 10)):
        df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"))
        want = [int(k * n / limit) for k in range(limit)] if n > limit else list(range(n))
        assert sorted(r.i for r in caps.systematic_sample(df, "k", [F.asc("i")], limit).collect()) == want


def test_note_only_when_something_is_cut(spark):
    df = spark.range(3)
    assert caps.capped_with_note(df, [F.asc("id")], 3, F.col("id").cast("string")).count() == 3
    assert [r.line for r in caps.capped_with_note(df, [F.asc("id")], 2, F.col("id").cast("string")).orderBy("pos").collect()] == ["0", "1", "+1 more"]


def test_asof_takes_the_last_one_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 11), ("a", 5, 12), ("a", 6, 13)], "k string, at int, v int")
    got = asof.asof_backward(left, right, "k", "at", "v", "hit").select("id", "hit").collect()
    assert dict(got) == {1: 12, 2: None, 3: None}


def test_chain_detects_edits_and_deletions(spark):
    df = spark.createDataFrame([("u", i, f"p{i}") for i in range(6)], "u string, i long, p string")
    built = chain.build(df, "u", "i", F.col("p"))
    assert chain.verify(built, "u").first().broken_at is None
    edited = built.withColumn("payload", F.when(F.col("seq") == 2, "x").otherwise(F.col("payload")))
    assert tuple(chain.verify(edited, "u").first())[1:] == (2, "bad hash")
    assert tuple(chain.verify(built.where("seq <> 3"), "u").first())[1:] == (4, "broken link")


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    got = graph.closure(spark.createDataFrame([(1,)], "node long"), edges, "a", "b")
    assert sorted(r.node for r in got.collect()) == [1, 2, 3]


def test_coverage_arithmetic_holds(spark):
    states = [(s,) for s, n in zip(coverage.STATES, (3, 2, 1, 4), strict=True) for _ in range(n)]
    r = coverage.coverage(spark.createDataFrame(states, "s string").withColumn("g", F.lit(1)), "g", F.col("s")).first()
    assert r.attempted == r.succeeded + r.partial + r.failed == 6 and r.eligible == 10 and not r.complete


def test_unique_match_leaves_ambiguous_names(spark):
    defs = spark.createDataFrame([("T", "a.T"), ("P", "a.P"), ("P", "b.P")], "short string, full string")
    got = resolve.unique_match_repair(spark.createDataFrame([("T",), ("P",), ("Q",)], "short string"), "short", defs, "full").select("short", "full", "repaired").collect()
    assert sorted(map(tuple, got)) == [("P", "P", False), ("Q", "Q", False), ("T", "a.T", True)]


def test_replace_touches_only_its_scope(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "f string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 2)], "f string, v int")
    assert dict(snapshot.replace_scope(old, new, spark.createDataFrame([("a",)], "f string"), "f").collect()) == {"a": 2, "b": 1}


def test_text_functions(spark):
    assert one(spark, fx.token_estimate(F.lit(""))) == 0
    assert one(spark, fx.token_estimate(F.lit("été foo_1, b!"))) == 6
    assert one(spark, fx.redact_url(F.lit("https://u:p@h/x"))) == "https://h/x"
    assert one(spark, fx.extract_code(F.lit("x\n```py\na = 1\n"))) == "a = 1\n"
    assert one(spark, comments.strip_comments(F.lit('a = "#no" # yes\nb // c'))) == 'a = "#no" \nb '
    assert one(spark, fx.diagnostic(F.lit("x\nfoo: error: bad\ny"))) == "foo: error: bad"


def test_path_functions(spark):
    assert one(spark, px.component_for(F.lit("src/a/b/c.py"))) == "a/b"
    assert one(spark, px.component_for(F.lit("x.py"))) == "(root)"
    assert one(spark, px.detect_language(F.lit("x.h"), F.lit("// class\nint a;"))) == "C"
    assert one(spark, px.detect_language(F.lit("x.h"), F.lit("class A;"))) == "C++"
    assert one(spark, px.is_secret(F.lit("a/.env"))) and not one(spark, px.is_secret(F.lit("a/env.py")))
    assert one(spark, F.lit("build/x/y.o").rlike(px.glob_regex(["build/*", "**/*.tmp"])))


def test_seen_set_marks_only_what_succeeded(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "seen")
    spark.createDataFrame([(1, "ok"), (2, "fails"), (1, "ok")], "iid int, s string").write.parquet(src)
    handled = []

    def handle(df):
        handled.append(sorted(r.iid for r in df.collect()))
        return df.where("s = 'ok'")

    def poll():
        stream = spark.readStream.schema("iid int, s string").parquet(src)
        seen.poll_with_seen_set(stream, "iid", handle, state, str(tmp_path / "ck")).awaitTermination()

    poll()
    spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "ok")], "iid int, s string").write.mode("append").parquet(src)
    poll()
    assert handled == [[1, 2], [2, 3]]
    assert sorted(r.iid for r in spark.read.parquet(state).collect()) == [1, 2, 3]


def test_failed_items_come_back_with_the_next_batch(spark, tmp_path):
    src, state, handled = str(tmp_path / "in"), str(tmp_path / "seen"), []

    def handle(df):
        keys = sorted(r.iid for r in df.collect())
        handled.append(keys)
        return df.where("iid <> 1" if len(handled) < 3 else "true")

    for n in (1, 2, 3, 4):
        spark.createDataFrame([(n, "s")], "iid int, s string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("iid int, s string").parquet(src)
        seen.poll_with_seen_set(stream, "iid", handle, state, str(tmp_path / "ck")).awaitTermination()
    assert handled == [[1], [1, 2], [1, 3], [4]]
    assert sorted(r.iid for r in spark.read.parquet(state).collect()) == [1, 2, 3, 4]


def test_dispatch(spark):
    rows = [
        ('{"object_kind":"merge_request","object_attributes":{"action":"open"}}', "review", ""),
        ('{"object_kind":"note","object_attributes":{"note":"hi @Bot","noteable_type":"MergeRequest"},"user":{"username":"x"}}', "reply", ""),
        ('{"object_kind":"note","object_attributes":{"note":"@bot","noteable_type":"MergeRequest"},"user":{"username":"bot"}}', "ignored", "own note"),
        ('{"object_kind":"push"}', "ignored", "unhandled kind push"),
    ]
    to, why = seen.dispatch(F.col("p"), "bot")
    got = spark.createDataFrame([(r[0],) for r in rows], "p string").select(to, why).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_languages_and_secret_names(spark):
    names = ["a/setup.py", "x.PYI", "b.kt", "c.html", "d", "e.vbproj", "Makefile", "CMakeLists.txt", "k/.ENV.local", "server.PEM", "my_rsa", "id_rsa.pub", "credentials", "credentials.txt", "key", "a.key/b"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").select("i", px.detect_language(F.col("p")).alias("l"), px.is_secret(F.col("p")).alias("s")).orderBy("i")
    rows = df.collect()
    assert [r.l for r in rows[:8]] == ["Build", "Python", "Kotlin", "Other", "Other", "MSBuild", "Build", "Other"]
    assert [r.s for r in rows[8:]] == [True, True, True, False, True, False, False, False]
    assert [bool(spark.range(1).select(px.is_code(F.lit(x))).first()[0]) for x in ("Kotlin", "Shell", "Markdown")] == [True, False, False]


def test_folds_are_linear_in_a_hot_key(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("at"), F.col("id").alias("id"))
    kept = dedupe.anchored_collapse(df, ["k"], "at", 9, "id")
    assert kept.agg(F.count("*").alias("n"), F.sum("at").alias("s")).first()[:] == (n // 10, sum(range(0, n, 10)))
    built = chain.build(df, "k", "id", F.col("at").cast("string"))
    assert built.agg(F.count("*"), F.max("seq")).first()[:] == (n, n - 1)
    assert chain.verify(built, "k").first().broken_at is None


def test_folds_take_null_payloads_repeats_and_no_rows(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 1, "a"), ("u", 1, "a"), (None, 2, "b")], "u string, i long, p string")
    built = {(r.u, r.seq): r for r in chain.build(df, "u", "i", F.col("p")).collect()}
    assert len(built) == 4 and built["u", 0].payload is None
    assert built["u", 0].hash == one(spark, F.sha2(F.lit(chain.GENESIS), 256)) and built["u", 2].prev_hash == built["u", 1].hash
    assert chain.build(df.limit(0), "u", "i", F.col("p")).count() == 0
    places = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 2)], "k string, at long, id long")
    assert [r[:] for r in dedupe.anchored_collapse(places, ["k"], "at", 0, "id").collect()] == [("a", 5, 2)]


def test_suggestions_keep_the_first_of_many(spark):
    paths = spark.range(5000).select(F.format_string("d%04d/index.html", "id").alias("p"))
    asked = spark.createDataFrame([("index.html",), ("zz/index.html",), ("d0007/index.html",), ("none",), (None,)], "ask string")
    got = dict(resolve.suggestions(asked, paths.union(paths), "p").collect())
    first = "d0000/index.html,d0001/index.html,d0002/index.html"
    assert got == {"index.html": first, "zz/index.html": first, "d0007/index.html": "d0007/index.html"}


def test_keyed_packing_keeps_rows_that_cost_nothing(spark):
    df = spark.createDataFrame([("a", i, 0 if i < 20 else 2) for i in range(40)] + [("b", 0, 9)], "k string, i int, c int")
    got = pack.budget_pack(df, [F.asc("i")], "c", 5, key="k", room=0).collect()
    assert sorted((r.k, r.i, r.fits, r.cut) for r in got) == [("a", i, True, False) for i in range(22)] + [("a", 22, False, True), ("b", 0, False, True)]


def test_lines_are_cut_within_the_room(spark):
    text = "one\r\ntwo\nthree\n"
    at = lambda room: one(spark, pack.cut_lines(F.lit(text), F.lit(room), "…"))
    costs = [one(spark, fx.token_estimate(F.lit(w)) + 1) for w in ("one", "two", "three")]
    assert [at(0), at(costs[0]), at(sum(costs) - 1), at(sum(costs))] == ["…", "one\n…", "one\ntwo\n…", "one\ntwo\nthree"]
    assert one(spark, pack.cut_lines(F.lit(""), F.lit(9), "…")) == ""


def test_frameworks_by_evidence(spark):
    rows = [("a", "x/Makefile", "LIBS=-lgmock"), ("a", "x/Makefile", "LIBS=-lgmock"), ("a", "b/one.csproj", '<packagereference include="NUnit3"/>'), ("a", "a/two.csproj", '<PackageReference Include="Moq"/>'), ("a", "setup.cfg", "[tool:pytest]"), (None, "build/Makefile", "gtest"), (None, "node_modules/conftest.py", None), (None, "src/io-test.c", '#include "assert.h"\nvoid main() {')]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {(r.repo, r.language): (r.framework, r.detected) for r in frameworks.frameworks(df, "repo", {"C": "Unity", "C++": "d", "Python": "d", "Rust": "d", "C#": "d", "Go": "d"}).collect()}
    plain = ("plain assert()/main()", True)
    assert got == {
        ("a", "C"): ("Unity", False), ("a", "C++"): ("GoogleTest", True), ("a", "Python"): ("pytest", True), ("a", "Rust"): ("d", False), ("a", "C#"): ("NUnit", True), ("a", "Go"): ("d", False),
        (None, "C"): plain, (None, "C++"): plain, (None, "Python"): ("pytest", True), (None, "Rust"): ("d", False), (None, "C#"): ("d", False), (None, "Go"): ("d", False),
    }
    assert frameworks.frameworks(df.limit(0), "repo", {"C": "Unity"}).count() == 0
