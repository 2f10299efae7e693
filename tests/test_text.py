"""Column functions and row-local stages on small texts."""

import pytest
from pyspark.sql import functions as F

from textsluice.functions import text as T
from textsluice.operators.lines import global_rule, head_tail, explode_lines, normalize_lines, reassemble
from textsluice.operators.rules import Rule, UserFilter, apply_rules, user_filter


def one(spark, text, column, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [(None, []), ("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])],
)
def test_lines(spark, text, expected):
    assert one(spark, text, T.lines("t")) == expected


def test_with_previous_and_let(spark):
    pairs = one(spark, "a\nb", T.with_previous(T.lines("t")))
    assert [(p.x, p.before) for p in pairs] == [("a", None), ("b", "a")]


def test_collapse_is_broken_by_any_other_rule(spark):
    rules = [Rule("^c", "collapse"), Rule("^r", "remove"), Rule("^x", "replace", "[x]"), Rule("^long", "truncate", 4)]
    out = one(spark, "c1\nc2\nr\nc3\nx\nlonger\nplain", apply_rules("t", rules))
    assert out == "[2 matching lines collapsed]\n[1 matching lines collapsed]\n[x]\nlong…\nplain"


def test_match_output_unless_and_on_empty(spark):
    rules = [Rule("^ok$", "match_output", "done", unless="^bad$"), Rule(".", "remove"), Rule("", "on_empty", "(none)")]
    assert one(spark, "a\nok", apply_rules("t", rules)) == "done"
    assert one(spark, "ok\nbad", apply_rules("t", rules)) == "(none)"
    assert one(spark, None, apply_rules("t", rules)) == "(none)"


def test_user_filter(spark):
    f = UserFilter(strip=("^#",), keep=("a", "b"), max_lines=2, on_empty="-")
    assert one(spark, "# a\na1\nb1\na2\nz", user_filter("t", f)) == "a1\nb1"
    assert one(spark, "z", user_filter("t", f)) == "-"


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("[=====>   ] 45%", "progress_bar"),
        ("Downloading x ", "download"),
        ("⠋", "spinner"),
        ("50% done", "percent"),
        ("3/10", "ratio"),
        ("─────────────", "decorator"),
        ("   Compiling a", "build_progress"),
        ("---", None),
        ("", None),
        ("error: x", None),
    ],
)
def test_noise_rules(spark, line, rule):
    assert one(spark, line, global_rule("t")) == rule


def test_normalize_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "a  \na\n\n\nb\nb\n")], "doc_id long, text string")
    once = reassemble(normalize_lines(explode_lines(docs)))
    assert once.first().text == "a\n\nb"
    assert reassemble(normalize_lines(explode_lines(once))).first().text == "a\n\nb"


def test_head_tail(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(10)))), (2, "x\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in reassemble(head_tail(explode_lines(docs), 2, 2)).collect()}
    assert got == {1: "0\n1\n[--- 6 more lines ---]\n8\n9", 2: "x\ny"}


def test_scalars(spark):
    df = spark.createDataFrame([("A_B=1 /usr/bin/git  status",)], "t string")
    row = df.select(
        T.command_key("t").alias("key"),
        T.compact_path(F.lit("a/bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb/ccccccccccccccccccccccccc/d/e.rs")).alias("path"),
        T.docker_size(F.lit("1.5GB")).alias("size"),
        T.common_prefix_dir(F.array(F.lit("a/b/c.py"), F.lit("a/b/d/e.py"))).alias("root"),
        T.jaccard(F.lit("a b c"), F.lit("b c d")).alias("j"),
        T.grep_fields(F.lit("x.py:12:hit")).alias("g"),
        T.utc_day(F.lit(86_399)).alias("day"),
        T.camel_parts(F.lit("parseHTTPResponse")).alias("parts"),
    ).first()
    assert (row.key, row.path, row.size, row.root, row.j, row.day) == ("git status", "a/.../d/e.rs", 1.5e9, "a/b/", 0.5, "1970-01-01")
    assert (row.g.path, row.g.line_no, row.g.match) == ("x.py", 12, "hit")
    assert row.parts == ["parse", "http", "response"]


def test_days_of_five_digit_years_have_no_sign(spark):
    assert one(spark, 253_402_300_799, T.utc_day("t"), "long") == "9999-12-31"
    assert one(spark, 253_402_300_800, T.utc_day("t"), "long") == "10000-01-01"
