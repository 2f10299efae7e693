"""Gates, command rewriting, file reads and handlers beyond what the SQL of their queries says."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import textsluice.plans.flow_queries as flows  # noqa: F401
import textsluice.plans.handler_queries  # noqa: F401
from textsluice.functions import commands as K
from textsluice.functions.compaction import rust_lines
from textsluice.functions.summarise import hash_embed
from textsluice.operators import gates
from textsluice.operators import reads as D
from textsluice.operators.handlers import handle
from textsluice.plans.catalog import ORACLE_SQL, QUERIES
from textsluice.plans.pipeline import process

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("command", "bare", "diverted"),
    [
        ("RUST_LOG=debug cargo build", "cargo build", False), ("A='b c' D=\"e \\\" f\" g", "g", False), ("a | b", "a | b", True), ("a || b", "a || b", False),
        ("x -> y", "x -> y", False), ("x >> y", "x >> y", True), ("echo '|>' \"|\"", "echo '|>' \"|\"", False), ("A=1", "", False), ("", "", False),
        ("A='open b", "", False), ("K=" + "v" * 200_000 + " ls", "ls", False), ("K=" + "'a'" * 2_000 + " ls", "ls", False),
    ],
)
def test_command_parts(spark, command, bare, diverted):
    assert one(spark, command, K.without_assignments) == bare
    assert one(spark, command, K.diverts_output) is diverted


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("head f", "cat f"), ("head -20 f", "cat f"), ("tail -n 5 f", "cat f"), ("head --lines=3 f", "cat f"), ("head f -n 3", "cat f"), ("head", None), ("head -", None),
        ("tail -f f", None), ("head -c 3 f", None), ("head a b", None), ("header a", None), (None, None),
    ],
)
def test_head_and_tail_become_cat(spark, command, want):
    assert one(spark, command, K.head_or_tail) == want


def test_gates_pass_small_and_leaked_outputs(spark):
    long = "\n".join(f"some words of line {i}" for i in range(40))
    rows = [(1, "make", "tiny"), (2, "sleep", long), (3, "sleep", long + "\nError"), (4, "make", long), (5, None, long), (6, "make", None), (7, "make", "")]
    df = spark.createDataFrame(rows, "id int, command string, text string")
    got = {r.id: r.u for r in df.select("id", gates.untouched(F.col("command"), F.coalesce("text", F.lit(""))).alias("u")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: True}
    out = {r.id: r.output for r in process(df).collect()}
    assert out[1] == "tiny" and out[2] == long and out[6] == out[7] == ""


def test_semantic_delta_matches_brute_force(spark):
    rows = [
        (1, 1, "build", 30, "compile a\ncompile b\ndone now"), (1, 2, "test", 9, "compile a"), (1, 3, "build", 30, "compile a\ncompile b\nbroken"),
        (1, 4, "build", 30, "nothing alike whatsoever"), (2, 1, "build", 5, "compile a"), (1, 5, "build", 30, ""),
    ]
    df = spark.createDataFrame([(*r, hash_embed([r[4]])[0].tolist()) for r in rows], "session_id int, turn int, cmd string, tokens long, content string, embedding array<double>")
    got = {(r.session_id, r.turn): (r.reference_turn, r.output, r.new_count, r.same_count) for r in D.semantic_delta(df).collect()}
    want = {}
    for s, t, c, _, text in rows:
        prior = [r for r in rows if r[0] == s and r[1] < t and r[2] == c and float(hash_embed([text])[0] @ hash_embed([r[4]])[0]) >= D.DELTA]
        if prior and rust_lines(prior[-1][4]):
            _, ref, _, tokens, old = max(prior, key=lambda r: r[1])
            best = (hash_embed(rust_lines(text)) @ hash_embed(rust_lines(old)).T).max(axis=1)
            new = [x for x, b in zip(rust_lines(text), best, strict=True) if b < D.LINE]
            same = len(best) - len(new)
            note = [f"[Δ from turn {ref}: +{len(new)} new, {same} repeated — ~{tokens * same // len(rust_lines(old))} tokens saved]"] if same else []
            want[s, t] = (ref, "\n".join(note + new), len(new), same)
    assert got == want and want[1, 3] == (1, "[Δ from turn 1: +1 new, 2 repeated — ~20 tokens saved]\nbroken", 1, 2)


def test_cross_file_sections(spark):
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.7, 0.7]}
    rows = [(1, 1, 0, 5, "a"), (1, 2, 0, 5, "a"), (1, 2, 1, 5, "b"), (1, 3, 0, 5, "b"), (2, 1, 0, 5, "a"), (1, 4, 0, 50, "a")]
    df = spark.createDataFrame([(*r[:4], v[r[4]]) for r in rows], "session_id int, turn int, seg_no int, n_lines int, embedding array<double>")
    reads = df.select("session_id", "turn", F.lit(60).alias("total_lines")).distinct()
    hit = lambda n: {(r.session_id, r.turn, r.seg_no) for r in D.cross_file_dedup(df, reads, stored=n).filter("suppressed").collect()}
    assert hit(200) == {(1, 2, 0), (1, 3, 0)} and hit(1) == {(1, 2, 0), (1, 3, 0)}  # the last read would lose 5/6 of its lines
    assert D.cross_file_dedup(df.limit(0), reads).count() == 0


def test_read_flow_routes(spark):
    code = "\n".join(f"fn f{i}(x: u8) {{\n    x + {i}\n}}\n" for i in range(80))
    rows = [
        (1, 1, "a.rs", code, "passthrough"), (1, 2, "a.rs", code, "passthrough"), (1, 3, "a.rs", code + "z = 1\n", "passthrough"), (1, 4, "b.rs", "x\n" * 10, "passthrough"),
        (1, 5, "c.rs", code, "strip"), (1, 6, "d.bin", "a\0" + "\n" * 90, "passthrough"), (1, 7, "e.txt", "word line\n" * 90, "passthrough"), (1, 8, "f.rs", None, "passthrough"), (2, 1, "a.rs", "", "passthrough"),
    ]
    df = spark.createDataFrame(rows, "session_id int, turn int, path string, text string, level string").withColumn("goal", F.lit("f7 return"))
    df = df.withColumn("edited", F.array(F.struct(F.lit(2).alias("first"), F.lit(2).alias("last"))))
    got = {(r.session_id, r.turn): r for r in D.read_flow(df).collect()}
    assert {k: r.route for k, r in got.items()} == {
        (1, 1): "focus", (1, 2): "digest", (1, 3): "delta", (1, 4): "pass", (1, 5): "level", (1, 6): "pass", (1, 7): "pipeline", (2, 1): "pass",
    }
    assert got[1, 4].output == "x\n" * 10 and got[1, 3].output.startswith("[delta: a.rs") and len(got[1, 1].output) < len(code)


def test_git_diff_tallies_and_caps():
    body = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@ fn\n a\n b\n c\n-let x = 1 ;\n+let x = 2 ;\n-foo\n+bar baz\n d\n e\n f\n"
    out = handle("git diff", body).split("\n")
    assert out == ["x [+1 -1 ~1]", "@@ fn", " a", " b", " c", "-let x = 1 ;", "+let x = 2 ;", "-foo", "+bar baz", " d", " e"]
    many = "".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n" + "".join(f"+line {j}\n" for j in range(30)) for i in range(6))
    out = handle("git diff", many).split("\n")
    assert [x for x in out if x.startswith("f")] == [f"f{i} [+30]" for i in range(6)]
    assert out[22] == "  [...truncated...]" and out[-1].startswith("[... diff truncated") and len(out) < 70


#: Least shares that commands save on outputs of their usual kind. Fixed values.
FLOORS = {
    "cargo test": (0.80, "\n".join([f"test m::c{i} ... ok" for i in range(200)] + ["test result: ok. 200 passed; 0 failed"])),
    "pytest": (0.80, "\n".join([f"tests/a.py::t{i} PASSED" for i in range(200)] + ["===== 200 passed in 1s ====="])),
    "terraform plan": (0.60, "\n".join(["Refreshing state... [id=i-%d]" % i for i in range(100)] + ["  + create a", "Plan: 1 to add"])),
    "npm install": (0.30, "\n".join(["npm warn deprecated x"] * 40 + ["added 120 packages in 3s", "0 vulnerabilities"])),
    "make": (0.30, "\n".join(f"gcc -Wall -O2 -c file{i}.c -o file{i}.o" for i in range(60))),
    "grep x": (0.10, "\n".join(f"src/some/long/path/to/file{i % 3}.rs:{i}:  let value = {i};" for i in range(150))),
    "mvn install": (0.55, "\n".join(["[INFO] Downloading from central: https://x/%d" % i for i in range(90)] + ["Tests run: 3, Failures: 0", "[INFO] BUILD SUCCESS"])),
    "ls": (0.70, "\n".join(f"-rw-r--r--  1 user group  {i} Jan  1 10:00 file{i}.rs" for i in range(120))),
    "git status": (0.30, "\n".join([f" M src/module/file{i}.rs" for i in range(60)] + [f"?? new{i}.txt" for i in range(40)])),
    "docker ps": (0.10, "\n".join(f"0123456789ab   image{i}:latest   \"entry\"   2 days ago   Up 2 days   0.0.0.0:80->80/tcp   name{i}" for i in range(20))),
}


@pytest.mark.parametrize("command", FLOORS)
def test_handlers_save_their_floor(command):
    floor, text = FLOORS[command]
    assert len(handle(command, text)) <= (1 - floor) * len(text)


def test_every_handler_query_has_sql():
    names = [n for n in QUERIES if n.startswith("handler_")]
    assert len(names) >= 35 and set(names) <= set(ORACLE_SQL)


def test_hash_embedding_is_unit_or_zero():
    rows = hash_embed(["a b", "", "?"])
    assert np.allclose(np.linalg.norm(rows, axis=1), [1, 0, 0])
