"""Sources on files written for the test."""

import json

from textloom.sources import readers


def test_walk_and_load(spark, tmp_path):
    for path, data in {"src/a.py": b"x = 1\n", "b.md": b"hi", ".git/config": b"x", "build/o.py": b"", "bad.py": b"\xff\xfe", "big.py": b"x" * 300_000}.items():
        f = tmp_path / path
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_bytes(data)
    files = readers.load_text(readers.walk_files(spark, str(tmp_path), ["build/*"]))
    got = {r.path: r for r in files.collect()}
    assert sorted(got) == ["b.md", "bad.py", "big.py", "src/a.py"]
    assert (got["src/a.py"].language, got["src/a.py"].text, got["src/a.py"].loc) == ("Python", "x = 1\n", 1)
    assert got["bad.py"].text is None and got["big.py"].text is None and got["b.md"].loc == 1


def test_compile_commands_and_audit_and_rules(spark, tmp_path):
    db = json.dumps([{"directory": "/r", "file": "a.c", "command": "cc -DX -Iinc -c a.c"}, {"directory": "/r", "file": "/r/a.c", "arguments": ["cc", "-DY"]}])
    assert [tuple(r) for r in readers.compile_commands(spark.createDataFrame([(db,)], "json string")).collect()] == [("/r/a.c", ["-DX", "-Iinc"])]
    log = tmp_path / "audit.jsonl"
    log.write_text('{"seq":1,"hash":"a","prev_hash":"0"}\nnot json\n')
    assert sorted((r.seq or 0, r.hash) for r in readers.audit_log(spark, str(log)).collect()) == [(0, None), (1, "a")]
    rules = readers.load_rules(spark, "rules:\n  - id: r1\n    severity: high\n  - title: no id\n  - id: r2\n    title: Two\n")
    assert sorted((r.id, r.title, r.severity) for r in rules.collect()) == [("r1", "r1", "high"), ("r2", "Two", "medium")]
