"""Structured Streaming forms: keyed session state, windows, and learning noise batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textsluice.operators.logs import merge_noise

BUFFER = 30
STATE = "turns long, tokens long, cmds array<string>, times array<long>, keys array<long>"
OUT = "session_id long, turn long, cmd string, ts long, held long, total_tokens long, suppressed boolean"
POLL_SECONDS = 120


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entries of a session in order of time: turn numbers, the bounded buffer, and polls that repeat a recent key."""
    turns, tokens, cmds, times, keys = state.get if state.exists else (0, 0, [], [], [])
    cmds, times, keys = list(cmds), list(times), list(keys)
    rows: list[tuple[Any, ...]] = []
    batch = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    for r in batch.itertuples():
        poll = any(c == r.cmd and k == r.key and 0 < r.ts - t <= POLL_SECONDS for c, t, k in zip(cmds, times, keys, strict=True))
        turns, tokens = turns + 1, tokens + int(r.tokens)
        cmds, times, keys = [*cmds, r.cmd][-BUFFER:], [*times, int(r.ts)][-BUFFER:], [*keys, int(r.key)][-BUFFER:]
        rows.append((key[0], turns, r.cmd, int(r.ts), len(cmds), tokens, poll))
    state.update((turns, tokens, cmds, times, keys))
    yield pd.DataFrame(rows, columns=["session_id", "turn", "cmd", "ts", "held", "total_tokens", "suppressed"])


def session_stream(entries: DataFrame) -> DataFrame:
    """entries: session_id, event_id, cmd, ts (seconds), tokens, key (hash of the output). Works on a stream; state is
    bounded by BUFFER entries a session."""
    return entries.groupBy("session_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling UTC days per command; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("runs"), F.sum("value").alias("value"))


def sliding(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Seven days, every day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), "event_type").agg(F.count("*").alias("runs"), F.sum("value").alias("value"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("runs"))


def noise_sink(load: Callable[[], DataFrame], store: Callable[[DataFrame], None], now: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges fresh pattern counts into a stored table."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        store(merge_noise(load(), batch, now()))

    return merge
