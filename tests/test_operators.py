"""Frame operators on small tables, and the plans of the catalogue."""

import pytest
from pyspark.sql import functions as F

from textsluice.operators import analytics as A
from textsluice.operators import convo as C
from textsluice.operators import graph as G
from textsluice.operators import logs as J
from textsluice.operators import session as S
from textsluice.operators.near_dup import greedy_clusters, simhash_members, simhash_pairs
from textsluice.plans.catalog import ORACLE_SQL, QUERIES
from textsluice.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_error_sets(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, [])], "s int, turn int, errors array<string>")
    got = [(r.fixed, r.new, r.unchanged) for r in J.error_sets(df, ["s"], "turn").orderBy("turn").collect()]
    assert got == [([], ["a", "b"], []), (["a"], ["c"], ["b"]), (["b", "c"], [], [])]


def test_noise_learning_and_merge(spark):
    rows = [(i, "noise line") for i in range(12)] + [(i, "useful") for i in range(12)] + [(i, "error: x") for i in range(12)]
    before = spark.createDataFrame(rows, "doc_id int, line string").withColumn("project", F.lit("p"))
    after = before.filter("line = 'useful'")
    learnt = {r.pattern: r.promoted for r in J.learn_noise(before, after).collect()}
    assert learnt == {"noise line": True, "useful": False, "error: x": False}
    fresh = J.learn_noise(before, after).withColumn("last_seen", F.lit(100))
    old = fresh.withColumn("last_seen", F.lit(-(40 * 86_400)))
    assert J.merge_noise(old, fresh, 100).agg(F.max("count")).first()[0] == 24
    assert J.merge_noise(old, fresh.limit(0), 100).count() == 0


def test_cochange_and_impact(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), *((4, f"f{i}") for i in range(60))]
    edges = G.cochanges(spark.createDataFrame(rows, "commit int, file string"))
    assert {(r.file_a, r.file_b, r.change_count) for r in edges.collect()} == {("a", "b", 2), ("b", "c", 1)}
    reached = G.impact(edges, spark.createDataFrame([("a",)], "file string")).collect()
    assert {(r.file, r.depth) for r in reached} == {("b", 1), ("c", 2)}
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["@c", "a", "", "b", "@c", "c"])], "doc_id int, line_no int, line string")
    assert G.parse_git_log(lines, "@").count() == 3


def test_edit_attribution(spark):
    sections = "array<struct<begin: long, end: long, preserved: boolean>>"
    events = spark.createDataFrame([(1, "f", 10, [(0, 5, True), (5, 9, False)])], f"session_id int, file string, ts long, sections {sections}")
    edits = spark.createDataFrame([(1, "f", 11, 4), (1, "f", 12, 5), (1, "f", 9, 1), (1, "g", 11, 1)], "session_id int, file string, ts long, edit_line long")
    assert {(r.ts, r.was_preserved) for r in A.attribute_edits(edits, events).collect()} == {(11, True), (12, False)}


def test_budget_pass_stops_once_it_fits(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", 9 - t, 100, 40) for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, age int, tokens long, tokens_less long")
    got = C.budget_pass(df, 850).filter("stepped").orderBy("turn")
    assert [r.turn for r in got.collect()] == [0, 2, 4]


def test_polling_and_cache(spark):
    rows = [(1, 1, "git log", 0, 5, "t 10:00:00"), (1, 2, "git log", 60, 5, "t 10:01:00"), (1, 3, "git log", 400, 5, "t 10:07:00")]
    df = spark.createDataFrame(rows, "session_id int, turn int, cmd string, ts long, tokens long, content string")
    assert [r.suppressed for r in S.suppress_polling(df).orderBy("turn").collect()] == [False, True, False]
    assert S.fifo_state(df, 2).orderBy("turn").collect()[-1].held_tokens == 10


def test_running_centroid_uses_the_buffer(spark):
    rows = [(1, 1, "a", [1.0, 0.0]), (1, 2, "a", [0.0, 1.0]), (1, 3, "a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id int, turn int, cmd string, embedding array<double>")
    got = {r.turn: r.centroid for r in S.running_centroid(df, 1).collect()}
    assert got == {1: None, 2: [1.0, 0.0], 3: [0.0, 1.0]}


def test_file_delta_and_classes(spark):
    df = spark.createDataFrame([(1, "f", 1, "a\nb"), (1, "f", 2, "a\nc")], "session_id int, path string, turn int, text string")
    assert S.file_deltas(df).first().status == "diff"
    change = spark.createDataFrame([("x y z\nold", "x y w\nnew one\nmore")], "a string, b string").select(S.classify_change(F.col("a"), F.col("b")).alias("c")).first().c
    assert (change.added, change.removed, change.modified) == (2, 1, 1)


def test_simhash_pairs_match_brute_force(spark):
    import random

    random.seed(1)
    hashes = [random.getrandbits(63) for _ in range(40)]
    hashes += [h ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) for h in hashes[:20]] + hashes[:3]
    df = spark.createDataFrame(list(enumerate(hashes)), "doc_id long, simhash long")
    got = {(r.a, r.b) for r in simhash_pairs(df, 3).collect()}
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    reps = sorted(first.values())
    assert got == {(a, b) for a in reps for b in reps if a < b and (hashes[a] ^ hashes[b]).bit_count() <= 3}


def test_near_dup_docs_reaches_every_document(spark):
    hashes = {r.doc_id: r.simhash for r in QUERIES["simhash_docs"](spark, SF).collect() if r.simhash is not None}
    links = QUERIES["near_dup_docs"](spark, SF).collect()
    least = {}
    for i in sorted(hashes):
        least.setdefault(hashes[i], i)
    got = [(r.a, r.b) for r in links if r.distance == 0]
    assert sorted(got) == sorted((least[h], i) for i, h in hashes.items() if least[h] != i) and len(got) > 0
    df = spark.createDataFrame([(5, 7), (3, 7), (9, 7), (1, None), (2, None), (4, 8)], "doc_id long, simhash long")
    assert {tuple(r) for r in simhash_members(df).collect()} == {(3, 5, 0), (3, 9, 0)}


def test_lexical_queries_score_whole_texts(spark):
    import re

    def brute(text, path, tokens):
        def known(parts):
            camel = [x for p in parts for x in re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "\1", p).split("\1")]
            return {x.lower() for x in [*parts, *camel] if len(x.encode()) >= 2}

        sigs, parts = known(re.split(r"[^\w]+", text)), known(re.split(r"[/\\._-]", path))
        begins = lambda t: len(t) >= 4 and any(x.startswith(t) for x in sigs | parts)
        return min(1.0, sum((t in sigs) + 0.8 * (t in parts) + 0.3 * begins(t) for t in tokens) / (len(tokens) * 2.1))

    tokens = ["the", "and", "doc1", "that"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    want = {f"src/{r.source}/doc{r.doc_id}.rs": brute(r.text or "", f"src/{r.source}/doc{r.doc_id}.rs", tokens) for r in docs}
    got = {r.file: r.score for r in QUERIES["lexical_score"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-5 for f in want)
    assert all(abs(r.lexical - want[r.file]) < 1e-5 for r in QUERIES["hybrid_rank"](spark, SF).collect())


def test_hit_at_5_matches_brute_force(spark):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def brute(items, docs):
        out = {}
        for task, text in items:
            w = words(text)
            n, wide = min(3, len(w)), min(8, len(w))
            spots = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []
            counts = sorted((-c, f) for f, t in docs if (c := sum(x in known for x in spots) if (known := runs(words(t), n) if n else set()) else 0))
            expected = {f for f, t in docs if w and runs(w, wide) & runs(words(t), wide)}
            rank = next((i for i, (_, f) in enumerate(counts[:5], 1) if f in expected), None)
            out[task] = (rank is not None, 1 / rank if rank else 0.0)
        return out

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(str(r.doc_id), r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.item_id: (r.hit, r.rr) for r in QUERIES["hit_at_5"](spark, SF).collect()}
    assert got == brute(items, docs) and 0 < sum(hit for hit, _ in got.values()) < len(got)

    # a long word alone is no hit; six files with more runs push the passage out of the five; short items match whole
    eight = "alpha beta gamma delta epsilon zeta theta kappa"
    items = [(1, f"{eight} one two three four five six seven eight nine ten"), (2, "Kappa alpha."), (3, ""), (4, None), (5, "theta-kappa iota")]
    docs = [("z", eight), ("y", "alpha only"), ("x", None), *((f"m{i}", "one two three four five six. Alpha beta gamma delta. seven eight nine ten; alpha theta kappa, iota") for i in range(6))]
    matches = G.passage_matches(spark.createDataFrame(items, "task int, text string"), spark.createDataFrame(docs, "file string, text string"))
    found = G.retrieval_metrics(G.top_files(matches), matches.filter("contains")).collect()
    want = brute(items, docs)
    assert {r.task: (r.hit, r.rr) for r in found} == {t: want[t] for t in (1, 5)} and want[1] == (False, 0.0) and want[5] == (True, 1.0)


def test_cosine_topk_matches_pairwise(spark):
    from textsluice.operators import semantic as M
    from textsluice.plans.tables import vectors

    v = vectors(spark, SF)
    asked = v.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as q")
    pairs = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.cosine, 4)) for r in df.collect())
    want = pairs(M.nearest(v, asked, 10))
    assert pairs(QUERIES["cosine_topk"](spark, SF)) == want and len(want) == 10 * asked.count() > 50
    same = spark.createDataFrame([(i, [1.0, 2.0, 0.5] if i % 3 else [float(i), 1.0]) for i in range(60)] + [(60, [0.0, 0.0]), (61, None)], "vec_id long, embedding array<float>")
    asked = same.filter("vec_id < 61").selectExpr("vec_id as query_id", "embedding as q")
    got = M.nearest_blocks(same, asked, 5, block=16, rows=20)
    assert pairs(got) == pairs(M.nearest(same.filter("embedding is not null"), asked, 5))


def test_impact_bfs2_starts_from_every_file(spark):
    from collections import Counter

    lists = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect():
        lists.setdefault(r.l_orderkey, []).append(r.l_suppkey)
    counts = {}
    for files in lists.values():
        for a in files:
            counts.setdefault(a, Counter()).update(b for b in files if b != a)
    near = {a: [b for b, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]] for a, c in counts.items()}
    want = set()
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        one = set(near.get(r.s_suppkey, []))
        two = {c for b in one for c in near[b]} - one - {r.s_suppkey}
        want |= {(r.s_suppkey, f, 1) for f in one} | {(r.s_suppkey, f, 2) for f in two}
    assert {tuple(r) for r in QUERIES["impact_bfs2"](spark, SF).collect()} == want and len({s for s, _, _ in want}) > 3


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.99, 0.1]), (1, 3, [0.0, 1.0])], "label int, vec_id int, embedding array<double>")
    assert [r.cluster for r in greedy_clusters(df, "label", "vec_id").orderBy("vec_id").collect()] == [0, 0, 1]


def test_sources_and_sinks(spark, tmp_path):
    event = '{"tool_name":"Bash","tool_input":{"command":"ls"},"tool_response":{"output":"","stdout":"x"}}'
    row = readers.hook_events(spark.createDataFrame([(event,)], "value string")).first()
    assert (row.command, row.payload) == ("ls", "x")
    talk = spark.createDataFrame([(1, '[{"content":"a"}]'), (2, '{"messages":[{"role":"assistant","content":"b"}]}')], "conv_id int, value string")
    assert {(r.conv_id, r.role, r.text) for r in readers.conversations(talk).collect()} == {(1, "user", "a"), (2, "assistant", "b")}
    rules = readers.parse_rules('[commands.x]\npatterns=[{regex="^a", action="Remove"},{regex="b",action={MatchOutput={message="m",unless="c"}}}]\non_empty="e"')
    assert [r.action for r in rules["x"]] == ["remove", "match_output", "on_empty"] and "git" in rules
    assert readers.parse_user_filters('[commands.y]\nmax_lines=3')["y"].max_lines == 3
    assert readers.first_config(None, "bad = = ", "a = 1") == {"a": 1}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.py").write_text("y")
    assert readers.repository_files(spark, str(tmp_path)).count() == 1
    files = spark.createDataFrame([("a", 1)], "path string, n int")
    edges = spark.createDataFrame([("a", "b", 1)], "file_a string, file_b string, change_count long")
    sinks.write_graph(files, edges, str(tmp_path / "g"))
    assert sinks.read_graph(spark, str(tmp_path / "g"))[1].count() == 1
    assert sinks.upsert(files, spark.createDataFrame([("a", 2), ("c", 3)], "path string, n int"), ["path"]).count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    from textsluice.streaming.session import session_stream

    rows = [(s, i, "cmd", i * 50, 10, i % 2) for i in range(12) for s in (1, 2)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, cmd string, ts long, tokens long, key long")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session_id, r.turn): (r.total_tokens, r.suppressed) for r in spark.table("sessions").collect()}
    assert len(got) == 24 and got[1, 12][0] == 120
    assert got[1, 1][1] is False and got[1, 3][1] is True


@pytest.mark.parametrize("name", ["flagship", "pattern_collapse", "gain_rollup", "cochange_pairs", "text_pipeline"])
def test_catalogue_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_catalogue_names():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) > 90
