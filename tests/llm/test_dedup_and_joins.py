"""Exact dedup, the n-gram Jaccard join, components and mixing against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textsluice.llm import jaccard_join as J
from textsluice.llm.bloom_dedup import exact_dedup, exact_groups, possible_repeats
from textsluice.llm.common import Scratch
from textsluice.llm.components import components
from textsluice.llm.mixing import mix, mix_plan, water_fill

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 80, 300]))
        text = " ".join(words)
        if i % 6 == 1:
            text += " " + passage
        if i % 4 == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = "  ".join(words).upper() if i % 8 == 2 else "\n".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    base = rng.choices(vocabulary, k=200)
    for i in range(n, n + 50):  # a large group of near copies, not all like the first
        words = list(base)
        for k in range(i % 9):
            words[(17 * k + i) % 200] = f"x{i % 7}{k}"
        rows.append((i, " ".join(words), "en", "s0", 0))
    return rows + [(1000, None, None, None, None), (1001, "", None, None, 0), (1002, " \n\t ", "de", "s1", 4)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("pairs_from", [3, 32])
def test_near_groups(spark, monkeypatch, pairs_from):
    monkeypatch.setattr(J, "PAIRS_FROM", pairs_from)
    monkeypatch.setattr(J, "TRIPLES_FROM", 3 * pairs_from)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_groups(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_groups_of_odd_tables(spark):
    assert J.near_groups(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f", None, None, None, 1), (1, "a b c d e f", None, None, None, 1), (None, "a b c d e f", None, None, None, 2)]
    got = J.near_groups(docs(spark, rows, ", node int")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1)]
    kept = J.near_dedup(docs(spark, rows[1:] + [(5, "A  b c d e f", None, None, None, 3)], ", node int"))
    assert kept.columns[-1] == "node" and {r.doc_id for r in kept.collect()} == {1, None}


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    universe = np.unique(J._mix(rng.integers(0, 2**63, 4000).astype(np.uint64)))
    prints = np.unique(universe >> np.uint64(24))
    df = rng.choice([3, 10, 40, 100, 3000, 5000], len(prints)).astype(np.int32)
    linked = 0
    for _ in range(400):
        size = int(rng.choice([1, 2, 3, 5, 8, 20, 60, 64, 70, 256, 300]))
        x = np.sort(rng.choice(universe, size, replace=False))
        drop, add = int(rng.integers(0, size // 8 + 1)), int(rng.integers(0, size // 8 + 1))
        y = np.union1d(np.setdiff1d(x, rng.choice(x, min(drop, size - 1), replace=False)), rng.choice(universe, add, replace=False))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            linked += 1
            assert len(np.intersect1d(J.signatures(x, prints, df, 80), J.signatures(y, prints, df, 80)))
    assert linked > 100


@pytest.mark.parametrize("percent", [5, 10, 20, 30, 50, 60])
def test_signatures_meet_at_low_percent(percent):
    rng = np.random.default_rng(percent)
    for n in (64, 70, 256, 260, 1100):
        every = np.unique(rng.integers(1, 2**64, n, dtype=np.uint64))
        prints = np.sort(every >> np.uint64(24))
        df = rng.choice([40, 100, 3000, 5000], len(prints)).astype(np.int32)
        ordered = every[np.lexsort((every, df[np.searchsorted(prints, every >> np.uint64(24))]))]
        for m in {-(-percent * n // 100), n // 4, n // 2, n}:
            if 100 * m >= percent * n:
                part = np.sort(ordered[n - m :])  # lacks the shingles that come first in the prefix
                assert len(np.intersect1d(J.signatures(every, prints, df, percent), J.signatures(part, prints, df, percent)))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_exact_groups(spark):
    rows = corpus() + [(7, "a b", None, None, None), (8, "ab", None, None, None), (9, "a  b", None, None, None), (9, "a  b", None, None, None)]
    got = exact_groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[1], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup(docs(spark, [(*r, 1) for r in rows], ", sha int"))
    assert kept.columns == [*DOCS.replace(",", "").split()[::2], "sha"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in want.values())
    assert exact_groups(docs(spark, [])).count() == 0 and exact_dedup(docs(spark, [])).count() == 0


def test_filter_misses_no_repeat(spark):
    h = spark.range(5000).select(F.xxhash64(F.col("id") % 4000).alias("h"))
    for rows in (5000, 10, 10_000_000):
        marked = h.select("h", possible_repeats(h, rows, filter_mb=1)(F.col("h")).alias("m")).distinct()
        repeated = h.groupBy("h").count().filter("count > 1")
        assert marked.join(repeated, "h").filter("not m").count() == 0


def test_sliced_filter(spark):
    h = spark.range(3000).select(F.xxhash64(F.col("id") % 2900).alias("h"))
    marked = h.withColumn("m", possible_repeats(h, 1_200_000, filter_mb=1)(F.col("h")))
    assert marked.filter("m").count() >= 200 and marked.filter("m").count() < 300


def test_water_fill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in water_fill(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert abs(sum(got.values()) - 2010) < 1e-6 and abs(got["b"] / got["c"] - 2) < 1e-9


def test_mix(spark):
    rows = corpus(200)
    plan = mix_plan(docs(spark, rows)).collect()
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.size * r.repeats <= 3 * r.size
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    again = mix(docs(spark, [(*r, 1) for r in rows], ", size int"))
    assert again.columns[-1] == "size"
    counts = {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.repeats for r in plan if r.repeats}
    assert mix_plan(docs(spark, [])).count() == 0 and mix(docs(spark, [])).count() == 0


def test_a_pair_of_many_lists_is_made_once(spark, monkeypatch):
    """Nine long texts, three by three: two share passages, three share others, none link."""
    words = lambda name, n: [f"{name}-{i}" for i in range(n)]
    rows = []
    for i in range(9):
        t, k = divmod(i, 3)
        own = [words(f"t{t}p{min(k, j)}{max(k, j)}", 200) for j in range(3) if j != k]
        pool = [words(f"pool{(i + 2 * j) % 9}", 450) for j in range(4)]
        rows.append((i, " ".join(w for j, x in enumerate((*own, words(f"t{t}", 800), *pool)) for w in (*x, *words(f"between{i}-{j}", 5))), "en", "s", 0))
    made, real = spark.sparkContext.accumulator(0), J._pairs

    def counting(every, percent):
        run = real(every, percent)

        def pairs(batches):
            for batch in run(batches):
                if every:
                    made.add(batch.num_rows)
                yield batch

        return pairs

    monkeypatch.setattr(J, "_pairs", counting)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert {r.component_id for r in J.near_groups(docs(spark, rows)).collect()} == set(range(9))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.value == 9  # three pairs of each three
