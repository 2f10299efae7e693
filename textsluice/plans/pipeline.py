"""The reduction pipeline: stages in fixed order, cheap native ones first, one Arrow stage at the end.

Every stage is a function of one row, so a corpus of any size needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textsluice.functions import text as T
from textsluice.functions.compaction import collapse_similar, compact_json_log, compact_ndjson, compact_traces, rust_lines
from textsluice.functions.summarise import hash_embed, entropy_budget, summarise, summarise_anchored, summarise_chunked, summarise_clusters
from textsluice.operators.gates import untouched
from textsluice.operators.lines import global_rule, input_ceiling, output_cap, removal_gate
from textsluice.operators.rules import command_rules


@dataclass(frozen=True)
class Config:
    ceiling: int = 200_000
    cap: int = 50_000
    threshold: int = 50
    head: int = 30
    tail: int = 30
    gate: float = 0.80
    budget: int = 60


def reduce_text(text: Column, drop_noise: bool = True) -> Column:
    """Lines after right-trimming, dropping repeats and blank runs, and noise rules, as an array."""
    trimmed = F.transform(T.lines(text), T.rtrim)
    x_of = lambda pairs: F.transform(pairs, lambda p: p["x"])
    single = x_of(F.filter(T.with_previous(trimmed), lambda p: p["before"].isNull() | (p["x"] != p["before"])))
    kept = x_of(F.filter(T.with_previous(single), lambda p: ~((p["x"] == "") & F.coalesce(p["before"] == "", F.lit(False)))))
    return F.filter(kept, lambda x: global_rule(x).isNull()) if drop_noise else kept


def head_tail(lines: Column, head: int, tail: int) -> Column:
    n = F.size(lines)
    mark = F.array(F.format_string("[--- %d more lines ---]", n - head - tail))
    return F.when(n > head + tail, F.concat(F.slice(lines, 1, head), mark, F.slice(lines, n - tail + 1, F.lit(tail)))).otherwise(lines)


@F.arrow_udf(StringType())
def _structured(texts: pa.Array, hints: pa.Array) -> pa.Array:
    """JSON logs and NDJSON streams; other texts pass."""
    rows = zip(texts.to_pylist(), hints.to_pylist(), strict=True)
    return pa.array([None if t is None else compact_ndjson(compact_json_log(t), h or "") for t, h in rows], pa.string())


def _semantic(config: Config):
    @F.arrow_udf(StringType())
    def run(texts: pa.Array, skip: pa.Array, hints: pa.Array, queries: pa.Array) -> pa.Array:
        out = []
        for t, gated, hint, query in zip(*(x.to_pylist() for x in (texts, skip, hints, queries)), strict=True):
            if t is None:
                out.append(None)
                continue
            t = collapse_similar(compact_traces(t), least=config.threshold)
            lines = rust_lines(t)
            if len(lines) > config.threshold and gated:
                kept = lines[: config.head] + [f"[--- {len(lines) - config.head - config.tail} more lines ---]"] + lines[-config.tail :]
                t = "\n".join(kept) if len(lines) > config.head + config.tail else t
            elif len(lines) > config.threshold:
                budget = entropy_budget(hash_embed([x for x in lines if x.strip()]), config.budget)
                if len(lines) > 2000:
                    t = summarise_chunked(t, budget, query=query)
                elif query:
                    t = summarise(t, budget, query=query, command=hint)
                else:
                    t = summarise_clusters(t, budget) if hint else summarise_anchored(t, budget)
            out.append(t)
        return pa.array(out, pa.string())

    return run


def process(docs: DataFrame, config: Config = Config(), text: str = "text", command: str = "command", query: str | None = None) -> DataFrame:  # noqa: B008
    """``docs`` with output, input_tokens, output_tokens, lines_in, lines_out and savings_pct."""
    asked = F.col(query) if query else F.lit(None).cast("string")
    raw = F.coalesce(F.col(text), F.lit(""))
    skip = untouched(F.col(command), raw)  # such outputs pass as they are, and no stage works on them
    first = F.when(~skip, F.array_join(F.transform(T.lines(T.strip_ansi(input_ceiling(raw, config.ceiling))), T.rtrim), "\n"))
    # marked as not deterministic only so that Spark runs each stage once and does not inline it
    staged = docs.withColumn("_t", _structured.asNondeterministic()(first, F.col(command)))
    staged = staged.withColumn("_k", reduce_text(F.col("_t")))
    staged = staged.withColumn("_p", command_rules(F.array_join("_k", "\n"), F.col(command)))
    gate = removal_gate(F.size(T.lines(raw)), F.size(T.lines("_p")), config.gate)
    staged = staged.withColumn("output", output_cap(_semantic(config).asNondeterministic()(F.col("_p"), gate, F.col(command), asked), config.cap))
    staged = staged.withColumn("output", F.when(skip, raw).otherwise(F.col("output")))
    tokens_in, tokens_out = T.token_estimate(raw), T.token_estimate("output")
    return (
        staged.withColumn("input_tokens", tokens_in)
        .withColumn("output_tokens", tokens_out)
        .withColumn("lines_in", F.size(T.lines(raw)))
        .withColumn("lines_out", F.size(T.lines("output")))
        .withColumn("savings_pct", F.when(tokens_in > 0, F.greatest(tokens_in - tokens_out, F.lit(0)) * 100.0 / tokens_in).otherwise(0.0))
        .drop("_t", "_k", "_p")
    )
