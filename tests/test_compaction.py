"""Sequential text functions: logs, traces, diffs, errors, handlers."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from textsluice.functions.compaction import (
    collapse_similar, compact_json_log, compact_ndjson, compact_traces, critical, edits, error_signatures, json_shape, rust_lines, sentences, unified_diff,
)
from textsluice.functions.hashing import fnv1a64, simhash64
from textsluice.functions.summarise import code_sections, keep_edited, summarise, summarise_anchored, summarise_clusters, summarise_message, web_sections
from textsluice.operators.handlers import REGISTRY, handle, resolve


def test_json_log():
    rows = [{"level": "info", "msg": "request handled by worker 1"}] * 5 + [{"lvl": "ERR", "message": "boom", "error": "x"}, {"level": "debug", "msg": "no"}]
    out = compact_json_log("\n".join(map(json.dumps, rows))).split("\n")
    assert out == ["[INFO] request handled by worker 1"] * 3 + ["[2 similar INFO lines omitted]", "[ERROR] boom", "  | error: x"]
    assert compact_json_log("plain\ntext") == "plain\ntext"


def test_go_stream():
    rows = [
        {"Action": "output", "Package": "b", "Output": "--- FAIL: T\n"},
        {"Action": "fail", "Package": "b", "Elapsed": 1.0},
        {"Action": "pass", "Package": "a", "Elapsed": 0.5},
    ]
    assert compact_ndjson("\n".join(map(json.dumps, rows)), "go") == "ok a (0.500s)\nFAIL b\n  --- FAIL: T\nFAIL: 1/2 packages failed"


def test_traces():
    text = 'x\nTraceback (most recent call last):\n  File "/app/a.py", line 1, in f\n    f()\n  File "/usr/lib/python3/x.py", line 2\n    g()\nValueError: bad\n'
    out = compact_traces(text)
    assert "a.py" in out and "f()" not in out and "[... 1 internal/stdlib frames omitted ...]" in out and out.endswith("\n")
    java = "java.lang.Exception: x\n" + "".join(f"\tat com.me.A{i}(A.java:1)\n" for i in range(7)) + "done"
    assert compact_traces(java).count("at com.me") == 5


def test_hashes():
    assert fnv1a64(b"") == 0xCBF29CE484222325
    assert fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert simhash64("") == 0 and simhash64("same words") == simhash64("same words")


def test_collapse_similar_keeps_critical_lines():
    lines = [f"2024-01-01 worker finished job number {i} in queue main" for i in range(60)] + ["error: one", "error: one"]
    out = collapse_similar("\n".join(lines))
    assert out.count("error: one") == 2 and "similar lines omitted" in out and len(out) < len("\n".join(lines))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_script_rebuilds_both_sides(old, new):
    script = edits(old, new)
    assert [old[e[1]] for e in script if e[0] != "+"] == old
    assert [new[e[2]] for e in script if e[0] != "-"] == new
    table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if old[i] == new[j] else max(table[i + 1][j], table[i][j + 1])
    assert sum(e[0] == " " for e in script) == table[0][0]


def test_diff():
    assert unified_diff("d/f.py", "a\nb", "a\nb") == ("unchanged", "")
    assert unified_diff("f", "a\0", "b")[0] == "not_eligible"
    status, text = unified_diff("d/f.py", "a\nb\nc\n", "a\nx\nc\n")
    assert (status, text) == ("diff", "[delta: f.py — +1 / -1 lines]\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n")


def test_error_signatures():
    text = "error[E0308]: mismatched types\n --> src/a.rs:3:4\nsrc/b.ts(1,2): error TS2322: no\nerror: aborting due to previous error\nx.go:1:2: undefined: y"
    found = error_signatures(text)
    assert [(e["code"], e["file"], e["line_no"]) for e in found] == [("E0308", "src/a.rs", 3), ("TS2322", "src/b.ts", 1), (None, "x.go", 1)]


def test_sentences_and_shapes():
    assert sentences("One. Two!  Three? v1.2 end\nNew") == ["One.", "Two!", "Three?", "v1.2 end", "New"]
    assert json_shape({"a": [1, 2], "b": 1.5, "c": None}) == {"a": ["int", "[2 items total]"], "b": "float", "c": "null"}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["ok step", "error: bad", "same", "", "warn x", "other words here"]), max_size=80))
def test_summaries_keep_critical_lines(lines):
    text = "\n".join(lines)
    for f in (summarise, summarise_anchored, summarise_clusters):
        out = f(text, 5)
        assert all(x in out for x in rust_lines(text) if critical.search(x))


def test_sections():
    assert len(web_sections("# A\nx\n\n# B\ny\n\n# C\nz")) == 3
    assert [k for _, _, k in code_sections("use a;\n\nfn f() {\n  x\n}\n\nstruct S {\n}\n", "rs")] == ["Import", "Function", "TypeDef"]
    assert keep_edited("\n".join(map(str, range(100))), [(50, 50)], 1).split("\n")[1:4] == ["48", "49", "50"]
    assert summarise_message("A one. Must keep. B two. C three. D four.", 0.2).count("Must keep") == 1


def test_every_handler_takes_anything():
    samples = ["", "a\n\nb", '{"a": 1}', "x" * 300, "\n".join(f"line {i} error" for i in range(300))]
    for name, f in REGISTRY.items():
        for sub in ("", "build", "test", "install", "get pods", "log", "list"):
            for s in samples:
                assert isinstance(f(s, sub), str), name
    assert len(REGISTRY) >= 60


def test_some_handlers():
    assert resolve("sudo FOO=1 /usr/bin/git status -s") == ("git", "status")
    assert handle("unknown", "x") == "x" and handle("git status", None) is None
    assert "1 staged, 0 modified, 1 untracked" in handle("git status", "M  a\n?? b\n")
    assert handle("kubectl get pods", "NAME   READY   STATUS\na      1/1     Running\n") == "[1 pods, all healthy]"
    pods = handle("kubectl get pods", "NAME   READY   STATUS\na      1/1     Running\nb      0/1     Error\n")
    assert "b  0/1  Error" in pods and "Error: 1, Running: 1" in pods
    assert handle("grep x", "a.py:1:x\na.py:2:x\nb.py:1:x") == "a.py: [2 matches]\n  1: x\n  2: x\nb.py: [1 matches]\n  1: x\n[3 matches in 2 files]"
    assert handle("env", "API_KEY=abc\nHOME=/root").count("***") == 1
    assert handle("pip install x", "Requirement already satisfied: x") == "[already satisfied]"


def test_glob_shows_ten_paths_of_every_folder():
    out = handle("(glob)", "\n".join(f"d{k}/f{i}" for k in range(8) for i in range(12))).split("\n")
    assert [sum(x == f"  f{i}" for x in out) for i in (0, 9, 10)] == [8, 8, 0]
    assert out.count("  ... and 2 more") == 8 and out[-1] == "[96 paths]"


def test_cmake_knows_a_build_without_percent_marks():
    noise, kept = "-- Build files written to: /b\n", "x.c:1: warning: unused\nmake: *** [all] Error 2"
    assert handle("cmake .", noise + "gcc -c a.c\n" + kept) == kept + "\n[0 targets built]"
    assert handle("cmake .", noise + "[1/9] Building c\n" + kept) == kept + "\n[0 targets built]"
    configured = "CMake Error at 3\n    [1/2] Building C object\n    make: *** [all] Error 2\n-- Configuring incomplete"
    assert handle("cmake .", configured) == "CMake Error at 3\n-- Configuring incomplete"
