"""Session state as windows over an ordered log: caches, polling, centroids, deltas.

Entries are (session_id, turn, cmd, ts, tokens, content[, embedding]).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textsluice.functions import text as T
from textsluice.functions import vectors as V
from textsluice.functions.compaction import unified_diff

BUFFER = 30
#: Seconds that results stay valid, by first word of the command. Fixed values.
TTL = {"git": 3600, "kubectl": 60, "docker": 30, "terraform": 300}
DIFF = StructType([StructField("status", StringType()), StructField("diff", StringType())])


def _past(keys: list[str], rows: int | None = None) -> Window:
    back = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy(*keys).orderBy("turn").rowsBetween(back, -1)


def fifo_state(entries: DataFrame, size: int = BUFFER) -> DataFrame:
    """Entries with what the buffer of the last ``size`` ones holds: entries, tokens, commands."""
    held = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-(size - 1), 0)
    return entries.select(
        "session_id", "turn", "cmd",
        F.count("*").over(held).alias("held"),
        F.sum("tokens").over(held).alias("held_tokens"),
        F.size(F.collect_set("cmd").over(held)).alias("held_commands"),
    )


def ttl_of(cmd: Column, default: int = 3600) -> Column:
    first, out = F.regexp_extract(cmd, r"^(\S+)", 1), None
    for name, seconds in TTL.items():
        out = F.when(first == name, seconds) if out is None else out.when(first == name, seconds)
    return out.otherwise(default)


def result_cache(entries: DataFrame) -> DataFrame:
    """Whether each entry's command and content were seen within its time to live."""
    w = Window.partitionBy("cmd", F.xxhash64("content")).orderBy("ts", "turn")
    return entries.withColumn("cache_hit", F.coalesce(F.col("ts") - F.lag("ts").over(w) <= ttl_of(F.col("cmd")), F.lit(False)))


def exact_state(entries: DataFrame) -> DataFrame:
    """The newest earlier turn with the same command and content."""
    return entries.withColumn("same_as", F.max("turn").over(_past(["session_id", "cmd", "content"])))


def previous(entries: DataFrame, columns: list[str]) -> DataFrame:
    """As-of: ``columns`` of the newest earlier entry of the same command, as prior_*."""
    w = Window.partitionBy("session_id", "cmd").orderBy("turn")
    return entries.select("*", *(F.lag(c).over(w).alias(f"prior_{c}") for c in columns))


def similar_output(entries: DataFrame, least: float = 0.92) -> DataFrame:
    """The newest of the buffer's entries of the command whose embedding is near enough."""
    recent = F.collect_list(F.struct("turn", "embedding")).over(_past(["session_id", "cmd"], BUFFER))
    near = lambda e: V.cosine(F.col("embedding"), e["embedding"]) >= least
    return entries.withColumn("_recent", recent).withColumn(
        "similar_to", F.array_max(F.transform(F.filter("_recent", near), lambda e: e["turn"]))
    ).drop("_recent")


def suppress_polling(entries: DataFrame, seconds: int = 120) -> DataFrame:
    """Whether the command gave the same output, time stamps aside, within ``seconds`` before."""
    key = F.xxhash64(T.strip_temporal("content"))
    back = Window.partitionBy("session_id", "cmd", "_key").orderBy("ts").rangeBetween(-seconds, -1)
    return entries.withColumn("_key", key).withColumn("suppressed", F.count("*").over(back) > 0).drop("_key")


def running_centroid(entries: DataFrame, size: int = BUFFER) -> DataFrame:
    """Mean embedding of the command's entries that the session's buffer still holds before each entry."""
    recent = F.collect_list(F.struct("cmd", "embedding")).over(_past(["session_id"], size))
    own = F.transform(F.filter(recent, lambda e: e["cmd"] == F.col("cmd")), lambda e: e["embedding"])
    total = F.aggregate(
        F.slice(F.col("_own"), 2, F.greatest(F.size("_own"), F.lit(1))),
        F.transform(F.get("_own", F.lit(0)), lambda x: x.cast("double")),
        lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")),
    )
    return entries.withColumn("_own", own).withColumn("centroid", F.when(F.size("_own") > 0, V.normalize(total))).drop("_own")


def pressure(entries: DataFrame) -> DataFrame:
    """Context pressure and compression factor of the tokens so far."""
    from textsluice.operators.router import compression_factor, context_pressure

    upto = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("so_far", upto).withColumn("pressure", context_pressure(F.col("so_far"))).withColumn("factor", compression_factor(F.col("so_far")))


def staleness(entries: DataFrame) -> DataFrame:
    """Entries that a later one of the same command, or a later edit (of a build), makes stale."""
    session = Window.partitionBy("session_id")
    last_same = F.max("turn").over(Window.partitionBy("session_id", "cmd"))
    last_edit = F.max(F.when(F.col("cmd").startswith("Edit"), F.col("turn"))).over(session)
    reason = F.when(F.col("turn") < last_same, "superseded").when(
        F.col("cmd").rlike(r"^(cargo|npm|go|make|mvn|gradle|tsc)\b") & (F.col("turn") < last_edit), "edited_since"
    )
    return entries.withColumn("stale_reason", reason)


@F.arrow_udf(DIFF)
def file_diff(names: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    rows = [unified_diff(n or "", a or "", b or "") for n, a, b in zip(names.to_pylist(), old.to_pylist(), new.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["status", "diff"])


def file_deltas(versions: DataFrame) -> DataFrame:
    """Each version (session_id, path, turn, text) against the one before it."""
    before = versions.withColumn("old", F.lag("text").over(Window.partitionBy("session_id", "path").orderBy("turn")))
    changed = before.filter("old is not null").withColumn("d", file_diff(F.col("path"), F.col("old"), F.col("text")))
    return changed.select("session_id", "path", "turn", "d.status", "d.diff")


def classify_change(old: Column, new: Column) -> Column:
    """Struct (added, removed, modified): lines of equal place count as modified from half common words on."""
    return T.let(F.struct(T.lines(old).alias("a"), T.lines(new).alias("b")), lambda x: _classify(x["a"], x["b"]))


def _classify(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    changed = F.filter(pairs, lambda p: p["x"] != p["y"])
    modified = F.size(F.filter(changed, lambda p: T.jaccard(p["x"], p["y"]) >= 0.5))
    other = F.size(changed) - modified
    return F.struct(
        (other + F.size(b) - n).alias("added"), (other + F.size(a) - n).alias("removed"), modified.alias("modified")
    )


def edited_lines(lines: DataFrame, edits: DataFrame, around: int = 20) -> DataFrame:
    """Range join: lines (doc_id, line_no) within ``around`` of an edit (doc_id, first, last). Ranges of a
    document are joined by buckets of lines, so that the join is an equi-join."""
    size = 64
    spread = edits.select("doc_id", "first", "last", F.explode(F.sequence(F.floor((F.col("first") - around) / size), F.floor((F.col("last") + around) / size))).alias("bucket"))
    return (
        lines.withColumn("bucket", F.floor(F.col("line_no") / size))
        .join(spread, ["doc_id", "bucket"])
        .filter(F.col("line_no").between(F.col("first") - around, F.col("last") + around))
        .select(*lines.columns)
        .distinct()
    )


def segment_dedup(segments: DataFrame, least: float = 0.85, most: float = 0.40) -> DataFrame:
    """Segments (session_id, turn, cmd, seg_no, n_lines, embedding) that repeat one of the last five entries
    of other commands; none are dropped where more than ``most`` of an entry's lines would go."""
    early = segments.select("session_id", F.col("turn").alias("t0"), F.col("cmd").alias("c0"), F.col("embedding").alias("e0"))
    pairs = segments.join(early, "session_id").filter(
        (F.col("t0") < F.col("turn")) & (F.col("t0") >= F.col("turn") - 5) & (F.col("c0") != F.col("cmd")) & (V.cosine(F.col("embedding"), F.col("e0")) >= least)
    )
    hits = pairs.groupBy("session_id", "turn", "seg_no").agg(F.max("t0").alias("repeats"))
    whole = Window.partitionBy("session_id", "turn")
    joined = segments.drop("embedding").join(hits, ["session_id", "turn", "seg_no"], "left")
    share = F.sum(F.when(F.col("repeats").isNotNull(), F.col("n_lines")).otherwise(0)).over(whole) / F.sum("n_lines").over(whole)
    return joined.withColumn("_share", share).withColumn("repeats", F.when(F.col("_share") <= most, F.col("repeats"))).drop("_share")
