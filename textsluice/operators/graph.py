"""Co-change graph over commits, impact of a file, and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.functions import text as T

MAX_FILES = 50
#: Runs of words, some 60 bytes each, that are sent to every executor.
BROADCAST_RUNS = 500_000


def usable_commits(changes: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """(commit, file) once each, without commits of more than ``most`` files."""
    once = changes.select("commit", "file").distinct()
    small = once.groupBy("commit").agg(F.count("*").alias("n")).filter(F.col("n") <= most)
    return once.join(small, "commit").select("commit", "file")


def cochanges(changes: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """file_a < file_b and the number of commits that changed both. Pairs come from sorted file lists of
    bounded commits, one row a commit, so no join is needed."""
    lists = usable_commits(changes, most).groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    a = lists.select("files", F.posexplode("files").alias("i", "file_a"))
    pairs = a.select("file_a", F.explode(F.slice("files", F.col("i") + 2, F.lit(most))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("change_count"))


def merge_cochanges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh).groupBy("file_a", "file_b").agg(F.sum("change_count").alias("change_count"))


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "change_count")
    return one.unionByName(edges.select(F.col("file_b").alias("file"), F.col("file_a").alias("other"), "change_count"))


def neighbours(edges: DataFrame, most: int = 20) -> DataFrame:
    """Per file its ``most`` strongest neighbours."""
    by = Window.partitionBy("file").orderBy(F.col("change_count").desc(), "other")
    return both_ways(edges).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def impact(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """(start, file, depth) of files within ``depth`` strong edges of each start, at their least depth."""
    near = neighbours(edges, most).select("file", "other")
    reached = starts.select(F.col("file").alias("start"), "file", F.lit(0).alias("depth"))
    front = reached
    for d in range(1, depth + 1):
        step = front.join(near, "file").select("start", F.col("other").alias("file"), F.lit(d).alias("depth")).distinct()
        front = step.join(reached.select("start", "file"), ["start", "file"], "left_anti")
        reached = reached.unionByName(front)
    return reached.filter("depth > 0")


def base_rank(files: DataFrame, boosted: bool = False) -> DataFrame:
    """``files`` (file, similarity, change_count, read_frequency, role) with base: similarity, reads and the
    logarithm of co-changes against the largest, times the role's weight."""
    top = F.col("_top")
    co = F.when(top > 0, F.log1p("change_count") / F.log1p(top)).otherwise(0.0)
    score = 0.5 * F.col("similarity") + 0.2 * co + 0.3 * F.col("read_frequency") if boosted else 0.7 * F.col("similarity") + 0.3 * co
    weight = F.when(F.col("role") == "entry_point", 1.5).when(F.col("role") == "state_manager", 1.2).when(F.col("role") == "persistence", 1.1).otherwise(1.0)
    most = files.agg(F.max("change_count").alias("_top"))  # one row, so that no task reads all files
    return files.crossJoin(F.broadcast(most)).withColumn("base", score * weight).drop("_top")


def hybrid_rank(ranked: DataFrame, query: str, k: int, file: str = "file", signatures: str = "signatures") -> DataFrame:
    """The best 10 k by base, scored again as 0.4 base + 0.6 lexical, the best k of these. ``file`` is a key;
    the ordering moves no signatures, only the 10 k files' are read."""
    tokens = T.query_tokens(F.lit(query))
    best = ranked.select(file, "base").orderBy(F.col("base").desc(), file).limit(10 * k)
    first = ranked.join(F.broadcast(best.select(file)), file, "left_semi")
    lexical = T.lexical_score(tokens, T.signature_tokens(F.col(signatures)), T.path_tokens(F.col(file)))
    return first.withColumn("lexical", lexical).withColumn("final", 0.40 * F.col("base") + 0.60 * F.col("lexical")).orderBy(F.col("final").desc(), file).limit(k)


def prompt_blend(prompt: Column, intent: Column) -> Column:
    """The prompt's embedding with the recent intent's; the prompt's alone where there is no intent."""
    mixed = F.zip_with(prompt, intent, lambda p, i: 0.4 * p.cast("double") + 0.6 * i.cast("double"))
    return F.coalesce(mixed, F.transform(prompt, lambda p: p.cast("double")))


def topic_skipped(prompt: Column, last: Column, files: Column) -> Column:
    """Whether guidance is left out: the topic is that of the prompts before, or the repository is small."""
    from textsluice.functions.vectors import cosine

    return F.coalesce(cosine(prompt, last) > 0.85, F.lit(False)) | (files < 25)


def guidance(ranked: DataFrame, file: str = "file", most: int = 6) -> DataFrame:
    """One text that names the best files."""
    top = ranked.orderBy(F.col("final").desc(), file).limit(most)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("final")).alias("n"), file))), lambda x: F.concat(F.lit("- "), x[file])), "\n").alias("guidance"))


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """hit@k and reciprocal rank per task: results (task, file, rank), expected (task, file); base names count."""
    want = expected.select("task", T.basename("file").alias("name")).distinct()
    hits = results.filter(F.col("rank") <= k).select("task", "rank", T.basename("file").alias("name")).join(want, ["task", "name"], "left_semi")
    best = hits.groupBy("task").agg(F.min("rank").alias("best"))
    return expected.select("task").distinct().join(best, "task", "left").select(
        "task", F.col("best").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr")
    )


def passage_matches(items: DataFrame, docs: DataFrame, run: int = 3, passage: int = 8) -> DataFrame:
    """(task, file, n_runs, contains) of files that share a run of ``run`` words with an item: how many of the item's
    runs occur, and whether ``passage`` words of it stand in the file in a row (all of them where an item is shorter).

    ``items``: task, text; ``docs``: file, text. Whole texts meet in an equi-join of runs; the items' runs are broadcast
    up to BROADCAST_RUNS of them, beyond that both sides are shuffled.
    """
    words = lambda c: F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def runs(w: Column, n: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("run")))

    asked = items.select("task", words(F.col("text")).alias("w")).withColumn("n", F.least(F.size("w"), F.lit(run))).filter("n > 0")
    sizes = {r.n: r.runs for r in asked.groupBy("n").agg(F.sum(F.size("w") - F.col("n") + 1).alias("runs")).collect()}
    widths = sorted(sizes)  # 1 to ``run``, as items shorter than a run have their own
    need = F.least(F.size("w"), F.lit(passage)) - F.col("n") + 1
    wanted = asked.select("task", need.alias("need"), F.explode(runs(F.col("w"), F.col("n"))).alias("r")).select("task", "need", F.col("r.at").alias("p"), "r.run")
    every = T.let(words(F.col("text")), lambda w: F.concat(F.array().cast("array<struct<at: int, run: string>>"), *(runs(w, F.lit(n)) for n in widths)))
    held = docs.select("file", F.explode(every).alias("r")).select("file", F.col("r.at").alias("q"), "r.run")
    near = F.broadcast(wanted) if sum(sizes.values()) <= BROADCAST_RUNS else wanted
    lines = held.join(near, "run").groupBy("task", "file", "need", (F.col("q") - F.col("p")).alias("shift")).agg(F.array_sort(F.collect_set("p")).alias("ps"))
    row = F.size(F.filter("ps", lambda x, i: F.get(F.col("ps"), i + F.col("need") - 1) == x + F.col("need") - 1)) > 0
    return lines.groupBy("task", "file").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("n_runs"), F.max(row).alias("contains"))


def top_files(matches: DataFrame, k: int = 5, parts: int = 64) -> DataFrame:
    """(task, file, rank) of the ``k`` files with most runs of each task, ties by file; first within ``parts``, so that
    no task of Spark ranks all files of a common passage."""
    order = [F.col("n_runs").desc(), "file"]
    some = Window.partitionBy("task", F.pmod(F.xxhash64("file"), F.lit(parts))).orderBy(*order)
    first = matches.select("task", "file", "n_runs", F.row_number().over(some).alias("rank")).filter(F.col("rank") <= k).drop("rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(*order))).filter(F.col("rank") <= k).select("task", "file", "rank")


def parse_git_log(lines: DataFrame, sentinel: str) -> DataFrame:
    """(commit, file) from log lines in order: a commit is what follows a line that starts with ``sentinel``."""
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").startswith(sentinel)
    marked = lines.withColumn("n", F.sum(starts.cast("int")).over(by))
    return marked.filter(~starts & (F.trim("line") != "") & (F.col("n") > 0)).select(
        F.concat_ws("#", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("commit"), F.trim("line").alias("file")
    )
