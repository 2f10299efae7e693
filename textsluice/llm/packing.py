"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's documents form a queue of tokens. In every round, which fills one
mixture window, a source's deficit grows by its quantum (its target share of the
window, in 2**-16 tokens); it sends the whole tokens of its deficit and carries
the rest on, over window and partition borders alike. When a queue runs dry, its
share goes to the others. Rounds between two such events are alike, so what a
source has sent after any round follows from its totals alone: every task
finds the windows of its own documents from the same short schedule, without
talking to others. Windows in a row are cut into sequences of ``seq_len``, so
only the very last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsluice.llm.common import Scratch, tidy
from textsluice.llm.tokens import CACHE_WORDS, CHUNK_BYTES, chunks, default_tokenizer, encoder

SHIFT = 16


class Schedule:
    """Where each token of each source queue lies in the packed stream."""

    def __init__(self, totals: list[int], weights: list[float], window: int) -> None:
        self.phases: list[tuple[list[int], list[int], list[int], int]] = []  # sent before, quanta, carry, place
        left, sent, carry, place = list(totals), [0] * len(totals), [0] * len(totals), 0
        self.total = sum(totals)
        while any(left):
            open_weight = sum(w for w, n in zip(weights, left, strict=True) if n)
            # queues without a target wait until all others have ended, then share evenly
            share = [0.0 if not n else w / open_weight if open_weight else 1 / len(left) for w, n in zip(weights, left, strict=True)]
            q = [max(1, int(x * window * (1 << SHIFT))) if x else 0 for x in share]
            rounds = min(((n << SHIFT) - c) // x for n, x, c in zip(left, q, carry, strict=True) if x)
            grown = [c + max(1, rounds) * x for x, c in zip(q, carry, strict=True)]
            part = [min(n, g >> SHIFT) for n, g in zip(left, grown, strict=True)]
            after = [g & ((1 << SHIFT) - 1) if n > p else 0 for n, g, p in zip(left, grown, part, strict=True)]
            if rounds < 1:  # some queue ends within this round, which then is a phase of its own
                q, carry = [p << SHIFT for p in part], [0] * len(part)
            self.phases.append((sent, q, carry, place))
            sent = [a + b for a, b in zip(sent, part, strict=True)]
            left = [a - b for a, b in zip(left, part, strict=True)]
            carry, place = after, place + sum(part)
        self.last = sent
        self.held: dict[tuple[int, int], tuple[list[int], list[int], list[int]]] = {}

    def _round(self, p: int, j: int) -> tuple[list[int], list[int], list[int]]:
        """Round j of phase p: per source the queue's tokens sent before and after it, and the place they go to."""
        if (p, j) not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            sent, q, carry, place = self.phases[p]
            lo = [(c + j * x) >> SHIFT for x, c in zip(q, carry, strict=True)]
            hi = [(c + (j + 1) * x) >> SHIFT for x, c in zip(q, carry, strict=True)]
            at, places = place + sum(lo), []
            for a, b in zip(lo, hi, strict=True):
                places.append(at)
                at += b - a
            self.held[p, j] = ([s + a for s, a in zip(sent, lo, strict=True)], [s + b for s, b in zip(sent, hi, strict=True)], places)
        return self.held[p, j]

    def spans(self, source: int, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(first token, last token + 1, place) of the parts of a stretch of a source's queue."""
        p = 0
        while begin < end:
            while (self.phases[p + 1][0] if p + 1 < len(self.phases) else self.last)[source] <= begin:
                p += 1
            sent, q, carry, _ = self.phases[p]
            j = -(-(((begin - sent[source] + 1) << SHIFT) - carry[source]) // q[source]) - 1
            lo, hi, places = self._round(p, j)
            upto = min(end, hi[source])
            yield begin, upto, places[source] + begin - lo[source]
            begin = upto


def _encode(tokenizer: str, cache_words: int, chunk_bytes: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("ahead", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead, words = TaskContext.get().partitionId(), {}, encoder(tokenizer, cache_words)
        narrow = "<u2" if words.tokenizer.get_vocab_size() <= 65_536 else "<u4"
        for batch in batches:
            docs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in chunks(batch.column(2), chunk_bytes):
                ids, lengths = words.encode(texts)
                data, cut, before = ids.astype(narrow), np.cumsum(lengths), []
                for s, n in zip(sources[at : at + len(texts)], lengths.tolist(), strict=True):
                    before.append(ahead.get(s, 0))
                    ahead[s] = before[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[at : at + len(texts)], pa.int64()),
                        pa.array(sources[at : at + len(texts)], pa.string()),
                        pa.array([part] * len(texts), pa.int32()),
                        pa.array(before, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([x.tobytes() for x in np.split(data, cut[:-1])], pa.binary()),
                    ],
                    schema=schema,
                )

    return encode


def _place(schedule: Schedule, seq_len: int):
    names = ("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, source, number, begin, n, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                for a, b, at in schedule.spans(number, begin, begin + n):
                    while a < b:
                        take = min(b - a, seq_len - at % seq_len)
                        rows.append((doc, source, a - begin, take, n, at // seq_len, at % seq_len, ids[a - begin : a - begin + take].tobytes()))
                        a, at = a + take, at + take
                held += n
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return place


def pack(
    docs: DataFrame,
    targets: dict[str | None, float] | None = None,
    seq_len: int = 2048,
    window_sequences: int = 32,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cache_words: int = CACHE_WORDS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Pieces of all documents: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids.

    ``targets`` are source weights; by default every source's share of all tokens,
    so that all queues end together. Sources that ``targets`` lacks come after all
    others. Null text is empty (the end id alone), null is a source of its own,
    rows that share an id are packed each, an empty table gives no rows. ``ids``
    are little-endian unsigned 32-bit. The driver holds two numbers per source.
    Smaller ``cache_words`` and ``chunk_bytes`` take less memory and more time, with the same result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    tokens = scratch.save(
        docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(
            tidy(_encode(tokenizer or default_tokenizer(), cache_words, chunk_bytes), encodes=True), "doc_id long, source string, part int, ahead long, n long, ids binary"
        ),
        "tokens",
    )
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.save(parts.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))), "parts")
    totals = {r.source: r.n for r in parts.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weights = [float(totals[s]) if targets is None else float(targets.get(s, 0)) for s in names]
    schedule = Schedule([totals[s] for s in names], weights, seq_len * window_sequences)
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, number int")
    bases = scratch.save(
        parts.join(numbers.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
            F.col("source").alias("s"), F.col("part").alias("p"), "base", "number"
        ),
        "bases",
    )
    return (
        tokens.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .select("doc_id", "source", "number", (F.col("base") + F.col("ahead")).alias("begin"), "n", "ids")
        .mapInArrow(
            tidy(_place(schedule, seq_len)),
            "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
    )
