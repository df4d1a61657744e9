"""Comments, records and model outputs against plain references, and texts of any length."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import comments, paths, records
from textloom.operators import store


def mapped(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def stripped(t):
    """One character after the other, with a state."""
    out, state, i = [], "code", 0
    while i < len(t):
        two = t[i : i + 2]
        if state == "block":
            if two == "*/":
                state, i = "code", i + 2
                continue
            out.append("\n" if t[i] == "\n" else " ")
        elif state == "line":
            if t[i] == "\n":
                state = "code"
                continue
        elif state in "'\"":
            if t[i] == "\\":
                out.append(two)
                i += 2
                continue
            out.append(t[i])
            state = "code" if t[i] == state else state
        elif two == "/*":
            state, i = "block", i + 2
            continue
        elif two == "//" or t[i] == "#":
            state = "line"
        else:
            out.append(t[i])
            state = t[i] if t[i] in "'\"" else state
        i += 1
    return "".join(out)


def blanked(t):
    out, state, i = [], "code", 0
    while i < len(t):
        two, keep = t[i : i + 2], "\n" if t[i] == "\n" else " "
        if state == "block" and two == "*/" or state == "code" and two == "/*":
            state = "code" if state == "block" else "block"
            out.append("  ")
            i += 1
        elif state == "block":
            out.append(keep)
        elif state == "line" or state == "code" and two == "//":
            state = "code" if t[i] == "\n" else "line"
            out.append(keep)
        elif state == "code":
            out.append(t[i])
            state = t[i] if t[i] in "'\"" else state
        elif t[i] in (state, "\n"):
            out.append(t[i])
            state = "code"
        elif t[i] == "\\" and len(two) == 2:
            out.append("\\" + ("\n" if two[1] == "\n" else " "))
            i += 1
        else:
            out.append("\\" if t[i] == "\\" else " ")
        i += 1
    return "".join(out)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    return ["".join(rng.choice("\"'/*#\\\n aé") for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + ["", "/*/", "/**/", "/*", '"\\', "'\\\n'x", "a // b", '"' + "x" * 50 + "// no"]


def test_comments_against_a_state_machine(spark, odd_texts):
    assert mapped(spark, comments.strip_comments, [*odd_texts, None]) == [*map(stripped, odd_texts), None]


def test_blanking_keeps_every_place(spark, odd_texts):
    assert mapped(spark, comments.blank_comments, [*odd_texts, None]) == [*map(blanked, odd_texts), None]


def test_texts_of_any_length(spark):
    n = 10**6
    texts = ['"' + "x" * n + '" // c', '"' + "\\n" * n + '" // c', '"' + "\\" * n, "/*" + "*" * n + "\n" + "*/x", "/" * n, "'" * n, "#" * n, "\n" * n + "//", '"\n' * (n // 2)]
    assert mapped(spark, comments.strip_comments, texts) == [stripped(t) for t in texts]
    assert mapped(spark, comments.blank_comments, texts) == [blanked(t) for t in texts]
    assert mapped(spark, store.assertions, texts + ['"' + "\\n" * n + '" assert x']) == [0] * len(texts) + [1]
    assert mapped(spark, lambda t: paths.detect_language(F.lit("a.h"), t), [t + " class" for t in texts[:2]]) == ["C", "C"]
    assert mapped(spark, records.json_object, ['{"a": "' + "\\n" * n + '"} }', "{" * n + "}" * n, "{" * n, "x" * n]) == ['{"a": "' + "\\n" * n + '"}', "{" * n + "}" * n, None, None]


def test_canonical_records(spark):
    rng = random.Random(9)

    def value(depth):
        kind = rng.randrange(6 if depth < 5 else 4)
        if kind == 4:
            return {rng.choice(["a", "b", "B", "é", "z1", "", "Ünï", "a b"]): value(depth + 1) for _ in range(rng.randrange(5))}
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return (rng.randrange(-(10**9), 10**9), rng.choice([True, False, None]), rng.choice(["", "é", "😀x", 'q"\\', "\x1f\x0b\x7f", "\\u001F", "\\\x1b", "line\n"]), "s")[kind]

    def shuffled(v):
        if isinstance(v, dict):
            keys = rng.sample(sorted(v), len(v))
            return {k: shuffled(v[k]) for k in keys}
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    values = [{"r": value(0), "a": value(0)} for _ in range(200)]
    texts = [json.dumps(shuffled(v), ensure_ascii=bool(i % 2), indent=i % 3 or None) for i, v in enumerate(values)]
    assert mapped(spark, records.canonical_json, [*texts, "no", None, ""]) == [*(json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values), None, None, None]


def first_object(t):
    """Without escapes: quotes part strings from braces."""
    start, depth, inside = t.find("{"), 0, False
    for i in range(start, len(t)) if start >= 0 else ():
        inside ^= t[i] == '"'
        depth += 0 if inside else {"{": 1, "}": -1}.get(t[i], 0)
        if t[i] == "}" and not depth and not inside:
            return t[start : i + 1]
    return None


def test_objects_in_free_text(spark):
    texts = ['a {"k": "}\\"{"} b}', "{", "}{}", '{"a": {"b": {}}} {}', 'x ```json\n{"a": 1}\n``` {"b": 2}', '"{" {}', "", None, '{"open']
    assert mapped(spark, records.json_object, texts) == ['{"k": "}\\"{"}', None, "{}", '{"a": {"b": {}}}', '{"a": 1}', None, None, None, None]
    rng = random.Random(10)
    plain = ["".join(rng.choice('{}"ab ') for _ in range(rng.randrange(0, 20))) for _ in range(500)]
    assert mapped(spark, records.json_object, plain) == [first_object(t) for t in plain]
    lenient = mapped(spark, lambda t: F.to_json(records.lenient_variant(t)), ["{'a': [1, 2, ], }", '{"a": 1}', "{'it''s'}", None])
    assert lenient == ['{"a":[1,2]}', '{"a":1}', None, None]


def test_findings_of_model_outputs(spark):
    rules = spark.createDataFrame([("R1", "memory", "high")], "rule_id string, category string, severity string")
    text = 'Sure [1]? ```json\n[{"rule": "R1", "line": "7", "message": " m "}, {"id": "R2", "severity": "LOW", "category": "style", "explanation": "e"}, 5, {"rule": "R3", "severity": "odd"}, {"severity": "info"}, {}]\n```'
    outputs = spark.createDataFrame([("a.c", text), ("b.c", "no findings"), ("c.c", "[1,"), ("d.c", None), ("e.c", '{"rule": "R1"}')], "file string, text string")
    got = records.model_findings(outputs, rules, "file", "text", "low", 2).orderBy("pos").collect()
    assert [(r.file, r.rule_id, r.category, r.severity, r.line, r.message) for r in got] == [("a.c", "R1", "memory", "high", 7, "m"), ("a.c", "UNKNOWN", "general", "medium", None, "")]
