"""File reads within a session: deltas by meaning, sections read before, and the order of all steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, LongType

from textsluice.functions import text as T
from textsluice.functions import vectors as V
from textsluice.functions.compaction import rust_lines, unified_diff
from textsluice.functions.summarise import digest, focus_compress, hash_embed, keep_edited, read_level
from textsluice.operators import gates
from textsluice.operators.session import BUFFER

DELTA, LINE = 0.55, 0.88
#: Section embeddings that a session keeps.
STORED = 200
DELTA_OUT = StructType([StructField("output", StringType()), StructField("new_count", LongType()), StructField("same_count", LongType())])


def line_delta(new: str, old: str, turn: int, tokens: int, least: float = LINE) -> tuple[str, int, int] | None:
    """``new`` without the lines that ``old`` has in like words, under a note of how many; null where ``old`` has no lines."""
    a, b = rust_lines(new), rust_lines(old)
    if not b:
        return None
    best = (hash_embed(a) @ hash_embed(b).T).max(axis=1) if a else np.zeros(0)
    fresh = [x for x, s in zip(a, best, strict=True) if s < least]
    same = len(a) - len(fresh)
    mark = [f"[Δ from turn {turn}: +{len(fresh)} new, {same} repeated — ~{tokens * same // len(b)} tokens saved]"] if same else []
    return "\n".join(mark + fresh), len(fresh), same


@F.arrow_udf(DELTA_OUT)
def _line_delta(new: pa.Array, old: pa.Array, turns: pa.Array, tokens: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (new, old, turns, tokens)), strict=True)
    out = [line_delta(a, b, t, n or 0) if a is not None and b is not None else None for a, b, t, n in rows]
    return pa.array([None if r is None else dict(zip(("output", "new_count", "same_count"), r, strict=True)) for r in out], pa.struct([("output", pa.string()), ("new_count", pa.int64()), ("same_count", pa.int64())]))


def semantic_delta(entries: DataFrame) -> DataFrame:
    """Entries (session_id, turn, cmd, tokens, content, embedding) against the newest one of their command in the
    session's buffer with a cosine of DELTA or more: session_id, turn, reference_turn, output, new_count, same_count."""
    back = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-BUFFER, -1)
    held = F.filter(F.collect_list(F.struct("turn", "cmd", "embedding")).over(back), lambda e: e["cmd"] == F.col("cmd"))
    near = F.filter("_held", lambda e: V.cosine(F.col("embedding"), e["embedding"]) >= DELTA)
    known = entries.withColumn("_held", held).withColumn("reference_turn", F.array_max(F.transform(near, lambda e: e["turn"]))).drop("_held", "embedding")
    before = entries.select("session_id", F.col("turn").alias("reference_turn"), F.col("content").alias("_old"), F.col("tokens").alias("_tokens"))
    paired = known.filter("reference_turn is not null").join(before, ["session_id", "reference_turn"])
    done = paired.withColumn("_d", _line_delta(F.col("content"), F.col("_old"), F.col("reference_turn"), F.col("_tokens")))
    return done.filter("_d is not null").select("session_id", "turn", "reference_turn", "_d.output", "_d.new_count", "_d.same_count")


def cross_file_dedup(sections: DataFrame, reads: DataFrame, least: float = 0.80, most: float = 0.30, stored: int = STORED) -> DataFrame:
    """Sections (session_id, turn, seg_no, n_lines, embedding) with suppressed: whether one of the last ``stored`` sections
    before their read is as near. A read (session_id, turn, total_lines) of which more than ``most`` would go keeps all.

    Sections meet by buckets of ``stored`` places, so a section meets 2 ``stored`` others at most, however long the session.
    """
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "seg_no")) - 1
    read = Window.partitionBy("session_id", "turn")
    at = sections.withColumn("_at", place).withColumn("_first", F.min("_at").over(read)).withColumn("_b", F.floor(F.col("_first") / stored))
    early = at.select("session_id", F.explode(F.array(F.floor(F.col("_at") / stored), F.floor(F.col("_at") / stored) + 1)).alias("_b"), F.col("_at").alias("_p"), F.col("embedding").alias("_e"))
    close = (F.col("_p") < F.col("_first")) & (F.col("_p") >= F.col("_first") - stored) & (V.cosine(F.col("embedding"), F.col("_e")) >= least)
    seen = at.join(early, ["session_id", "_b"]).filter(close).select("session_id", "turn", "seg_no").distinct().withColumn("_seen", F.lit(True))
    marked = sections.drop("embedding").join(seen, ["session_id", "turn", "seg_no"], "left").join(reads, ["session_id", "turn"])
    share = F.sum(F.when(F.col("_seen"), F.col("n_lines")).otherwise(0)).over(read) / F.greatest(F.col("total_lines"), F.lit(1))
    return marked.withColumn("_share", share).withColumn("suppressed", F.coalesce(F.col("_seen") & (F.col("_share") <= most), F.lit(False))).drop("_seen", "_share", "total_lines")


@F.arrow_udf(StringType())
def _read(routes: pa.Array, paths: pa.Array, old: pa.Array, new: pa.Array, goals: pa.Array, levels: pa.Array) -> pa.Array:
    """What a read returns; null where the pipeline is to do it."""
    out = []
    for route, path, a, b, goal, level in zip(*(x.to_pylist() for x in (routes, paths, old, new, goals, levels)), strict=True):
        extension = path.rsplit(".", 1)[-1] if "." in path else ""
        result = None
        if route == "pass":
            result = b
        elif route == "level":
            result = read_level(b, level, extension)
        elif route == "digest":
            result = digest(b, extension)
        elif route == "delta":
            status, text = unified_diff(path, a, b)
            result = text if status == "diff" else digest(b, extension) if status == "unchanged" else None
        if result is None and goal and extension.lower() in gates.CODE and len(rust_lines(b)) >= 150:
            shorter, spans = focus_compress(b, extension, hash_embed([goal])[0])
            result = shorter if not all(kept for _, _, kept in spans) else None
        out.append(result)
    return pa.array(out, pa.string())


@F.arrow_udf(StringType())
def _edited(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), ranges.to_pylist(), strict=True)
    return pa.array([t if not t or not r else keep_edited(t, [(x["first"], x["last"]) for x in r]) for t, r in rows], pa.string())


def route(text: Column, before: Column, level: Column) -> Column:
    """How a read is answered: pass, level, digest (as it was), delta (changed) or new."""
    return (
        F.when(text.contains("\0") | (F.size(T.lines(text)) < 50), "pass")
        .when(level != "passthrough", "level")
        .when(before == text, "digest")
        .when(before.isNotNull(), "delta")
        .otherwise("new")
    )


def read_flow(reads: DataFrame) -> DataFrame:
    """Reads (session_id, turn, path, text, goal, level, edited: array of first, last) with route and output.

    Binary and short files pass; a level other than passthrough replaces all further steps; a file read before in the
    session becomes a digest or a diff; long code is reduced towards ``goal``; the pipeline does the rest, around edited lines.
    """
    from textsluice.plans.pipeline import process

    before = F.lag("text").over(Window.partitionBy("session_id", "path").orderBy("turn"))
    known = reads.filter("text is not null").withColumn("_before", before)
    known = known.withColumn("route", route(F.col("text"), F.col("_before"), F.col("level")))
    known = known.withColumn("_out", _read.asNondeterministic()(*map(F.col, ("route", "path", "_before", "text", "goal", "level"))))
    left = known.withColumn("_text", F.when(F.col("_out").isNull(), F.col("text"))).withColumn("_kind", T.extension("path"))
    done = process(left, text="_text", command="_kind", query="goal")
    route_done = F.when(F.col("_out").isNull(), "pipeline").when(F.col("route") == "new", "focus").otherwise(F.col("route"))
    return done.select("session_id", "turn", "path", route_done.alias("route"), F.coalesce("_out", _edited(F.col("output"), F.col("edited"))).alias("output"))


def session_log(rows: DataFrame, sessions: DataFrame | None = None, order: str = "ts") -> DataFrame:
    """Rows of the asked sessions (all by default) with place, their number in order of time."""
    own = rows if sessions is None else rows.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(order)))
