"""Exact deduplication behind a two-pass counting Bloom filter.

Pass one folds a 64-bit hash of every normalised text into saturating two-bit
counters. Pass two asks, for every row, whether all counters of its hash reached
two: a text that occurs twice always passes, a single one seldom does. Only rows
that pass are shuffled, grouped by their full SHA-256; the rest go straight
through. The filter is built in segments, on the executors, and is never larger
than ``filter_mb``, whatever the table: the fuller it is, the fewer counters a
hash has and the more single rows pass, which costs a shuffle of theirs but never
a missed repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsluice.llm.common import SPACE, Scratch, text_or_empty, tidy

SEGMENTS = 64


def positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Counter numbers of each hash, one row per hash, by double hashing."""
    u = h.astype(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + steps * b[:, None]) % np.uint64(bits)).astype(np.int64)


def _partial(bits: int, hashes: int):
    """Per task: the counters touched once and more than once, by segment."""
    seg_bits = bits // SEGMENTS

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            # a hash touches each of its counters once, however its probes fall
            p = np.sort(positions(h, bits, hashes), axis=1)
            first = np.ones(p.shape, bool)
            first[:, 1:] = p[:, 1:] != p[:, :-1]
            at, n = np.unique(p[first], return_counts=True)
            cuts = np.searchsorted(at, np.arange(SEGMENTS + 1) * seg_bits)
            seg, once, more = [], [], []
            for s in range(SEGMENTS):
                own, m = at[cuts[s] : cuts[s + 1]] - s * seg_bits, n[cuts[s] : cuts[s + 1]]
                if len(own):
                    seg.append(s)
                    once.append(own[m == 1].astype("<u4").tobytes())
                    more.append(own[m > 1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                names=["seg", "once", "more"],
            )

    return parts


def _merge(seg_bits: int, least: int):
    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(seg_bits, np.uint8)
        for batch in batches:
            for once in batch.column("once").to_pylist():
                at = np.frombuffer(once, "<u4")
                count[at] = np.minimum(count[at] + 1, 2)
            for more in batch.column("more").to_pylist():
                count[np.frombuffer(more, "<u4")] = 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(count >= least).tobytes()], pa.binary())],
            names=["seg", "bits"],
        )

    return merge


def shape(rows: int, filter_mb: int, bits_per_row: int = 16) -> tuple[int, int]:
    """Bits of a segment, and probes of a hash, of a filter for ``rows`` hashes."""
    bits = max(1024 * SEGMENTS, min(filter_mb * 8_000_000, rows * bits_per_row))
    return -(-bits // SEGMENTS // 8) * 8, max(1, min(5, round(math.log(2) * bits / max(rows, 1))))


def _filter(hashes: DataFrame, rows: int, filter_mb: int, least: int):
    """A function from a column of hashes to a boolean column: does this hash occur ``least`` times? No hash that
    does is answered with false. And the broadcast filter."""
    spark = hashes.sparkSession
    seg_bits, probes = shape(rows, filter_mb)
    bits = seg_bits * SEGMENTS
    merged = (
        hashes.mapInArrow(tidy(_partial(bits, probes)), "seg int, once binary, more binary")
        .groupBy("seg")
        .applyInArrow(_merge(seg_bits, least), "seg int, bits binary")
    )
    packed = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # filter_mb at most; a local iterator would be a job for every partition
        packed[row.seg * seg_bits // 8 : (row.seg + 1) * seg_bits // 8] = np.frombuffer(row.bits, np.uint8)
    held = spark.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        p = positions(h.to_numpy(zero_copy_only=False), bits, probes)
        return pa.array(((held.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1))

    return maybe, held


def possible_repeats(hashes: DataFrame, rows: int, filter_mb: int = 64):
    """A function from a column of hashes to a boolean column: may this hash occur twice?

    ``hashes`` has one BIGINT column. ``rows`` sizes the filter; a wrong number, or one
    beyond what ``filter_mb`` can tell apart, costs false passes, never a missed repeat.
    """
    return _filter(hashes, rows, filter_mb, 2)[0]


def members(hashes: DataFrame, rows: int, filter_mb: int = 16):
    """A function as of :func:`possible_repeats`, for the question whether a hash may be among ``hashes``, and
    the broadcast to release after use."""
    return _filter(hashes, rows, filter_mb, 1)


def text_digest(text_col: str = "text") -> Column:
    """SHA-256, lowercase hex, of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE + "+", ""), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 64) -> DataFrame:
    """Every row with the row that stays for it.

    Columns: ``id_col``, keep_id, group_size, kept, text_sha256. Of equal texts
    the one with the most code points in the original stays, then the smallest id
    (null ids last); of rows that tie in both, exactly one is kept. Null text
    equals empty text. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    spine = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            F.char_length(text_or_empty(text_col)).alias("n"),
            text_digest(text_col).alias("sha"),
        ).select("*", F.xxhash64("sha").alias("h"), F.monotonically_increasing_id().alias("rid")),
        "spine",
    )
    repeated = possible_repeats(spine.select("h"), spine.count(), filter_mb)
    tested = scratch.save(spine.select("id", "n", "sha", "rid", repeated(F.col("h")).alias("maybe")), "tested")
    scratch.drop("spine")
    single = tested.filter("not maybe").select(
        F.col("id").alias(id_col),
        F.col("id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    several = tested.filter("maybe")
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))
    # written, so that the join below has exchanges of its own and a hot group's rows can be split
    groups = scratch.save(
        several.groupBy(F.col("sha").alias("text_sha256")).agg(
            F.count("*").alias("group_size"), F.min(order).alias("first")
        ),
        "groups",
    )
    return single.unionByName(
        several.withColumnRenamed("sha", "text_sha256")
        .join(groups, "text_sha256")
        .select(
            F.col("id").alias(id_col),
            F.col("first.id").alias("keep_id"),
            "group_size",
            (F.col("rid") == F.col("first.rid")).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 64) -> DataFrame:
    """``docs`` with one row of each group of equal texts, chosen as in :func:`exact_groups`.

    All columns stay. Rows whose hash cannot repeat are not shuffled.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    hashes = scratch.save(docs.select(F.xxhash64(text_digest(text_col)).alias("h")), "hashes")
    repeated = possible_repeats(hashes, hashes.count(), filter_mb)
    scratch.drop("hashes")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    tested = docs.select(
        row.alias("row"), F.char_length(text_or_empty(text_col)).alias("n"), text_digest(text_col).alias("sha")
    ).withColumn("maybe", repeated(F.xxhash64("sha")))
    order = F.struct(
        (-F.col("n")).alias("n"), F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id")
    )
    first = tested.filter("maybe").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    return tested.filter("not maybe").select("row.*").unionByName(first.select("row.*"))
