"""Analytics over a log of records: totals, breakdowns, prices, quality, missed savings, reads.

Records have: project, command, subcommand, input_tokens, output_tokens, ts (unix
seconds, 0 for undated), duration_ms, cache_hit, model, session_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.functions import text as T

#: Price per million tokens by the first part of a model's name that it contains. Fixed values.
MODEL_PRICES = (
    ("claude-opus-4-6", 5.00),
    ("claude-opus-4-5", 5.00),
    ("claude-opus-4", 15.00),
    ("claude-opus-3", 15.00),
    ("claude-sonnet-4", 3.00),
    ("claude-sonnet-3-7", 3.00),
    ("claude-sonnet-3-5", 3.00),
    ("claude-haiku-4-5", 1.00),
    ("claude-haiku-4", 0.80),
    ("claude-haiku-3", 0.25),
)
FALLBACK_PRICE = 3.00

#: Expected share saved per command where none was measured. Fixed values.
EXPECTED_SAVINGS = {
    "cargo": 0.87, "curl": 0.96, "git": 0.80, "docker": 0.85, "docker-compose": 0.85, "npm": 0.85, "pnpm": 0.85,
    "yarn": 0.85, "ls": 0.80, "cat": 0.70, "grep": 0.80, "rg": 0.80, "find": 0.78, "kubectl": 0.75,
    "terraform": 0.70, "pytest": 0.80, "jest": 0.75, "vitest": 0.75, "pip": 0.60, "pip3": 0.60, "uv": 0.60,
    "go": 0.65, "helm": 0.70, "brew": 0.65, "gh": 0.60, "make": 0.55, "tsc": 0.70, "mvn": 0.80, "python": 0.50,
    "python3": 0.50, "eslint": 0.65, "aws": 0.65, "jq": 0.60, "diff": 0.60, "journalctl": 0.75, "psql": 0.65,
    "tree": 0.70, "env": 0.50,
}
DEFAULT_SAVINGS = 0.40

DAY = 86_400
saved = lambda: F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))


def savings_pct(tokens_in: Column, tokens_out: Column) -> Column:
    """Percent saved; 0 for no input, never negative."""
    return F.when(tokens_in == 0, 0.0).otherwise(F.greatest(tokens_in - tokens_out, F.lit(0)) * 100.0 / tokens_in)


def model_price(model: Column, prices: tuple = MODEL_PRICES, fallback: float = FALLBACK_PRICE) -> Column:
    low, out = F.lower(model), None
    for name, price in prices:
        out = F.when(low.contains(name), price) if out is None else out.when(low.contains(name), price)
    return out.otherwise(fallback)


def _totals(extra: list[Column] | None = None) -> list[Column]:
    return [
        F.count("*").alias("runs"),
        F.sum("input_tokens").alias("tokens_in"),
        F.sum("output_tokens").alias("tokens_out"),
        F.sum(saved()).alias("tokens_saved"),
        *(extra or []),
    ]


def totals(records: DataFrame) -> DataFrame:
    return records.agg(*_totals([F.avg("duration_ms").alias("avg_ms")])).withColumn("pct", savings_pct(F.col("tokens_in"), F.col("tokens_out")))


def windows(records: DataFrame, now: int) -> DataFrame:
    """Tokens saved today (UTC) and in the seven days before ``now``."""
    today = now - now % DAY
    return records.agg(
        F.coalesce(F.sum(F.when(F.col("ts") >= today, saved())), F.lit(0)).alias("saved_today"),
        F.coalesce(F.sum(F.when(F.col("ts") >= now - 7 * DAY, saved())), F.lit(0)).alias("saved_7d"),
        F.count_if(F.col("ts") >= now - 7 * DAY).alias("runs_7d"),
    )


def breakdown(records: DataFrame) -> DataFrame:
    per = records.groupBy(T.command_key("command").alias("key")).agg(*_totals())
    return per.withColumn("pct", savings_pct(F.col("tokens_in"), F.col("tokens_out"))).orderBy(F.col("tokens_saved").desc(), "key")


def top_command(records: DataFrame) -> DataFrame:
    return breakdown(records).limit(1)


def daily_history(records: DataFrame, now: int, days: int = 14) -> DataFrame:
    """The last ``days`` UTC days, newest first, days without records as zero."""
    last = now - now % DAY
    span = records.sparkSession.range(1).select(F.explode(F.sequence(F.lit(last - (days - 1) * DAY), F.lit(last), F.lit(DAY))).alias("day_ts"))
    per = records.filter(F.col("ts") > 0).groupBy((F.col("ts") - F.col("ts") % DAY).alias("day_ts")).agg(*_totals())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        span.join(per, "day_ts", "left")
        .select(T.utc_day("day_ts").alias("day"), zero("runs"), zero("tokens_in"), zero("tokens_out"), zero("tokens_saved"))
        .orderBy(F.col("day").desc())
    )


def top_and_rest(records: DataFrame, most: int = 8) -> DataFrame:
    per = records.groupBy(T.command_key("command").alias("key")).agg(F.sum(saved()).alias("tokens_saved"))
    ranked = per.withColumn("n", F.row_number().over(Window.orderBy(F.col("tokens_saved").desc(), "key")))
    return ranked.groupBy(F.when(F.col("n") <= most, F.col("key")).otherwise("rest").alias("key")).agg(F.sum("tokens_saved").alias("tokens_saved"))


def blended_cost(records: DataFrame) -> DataFrame:
    """Money saved, each record at its model's price."""
    price = model_price(F.coalesce("model", F.lit("")))
    return records.agg(F.sum(saved() * price / 1e6).alias("cost_saved"))


def cost_rollup(records: DataFrame) -> DataFrame:
    """Totals per command and over all (null key)."""
    return records.rollup(T.command_key("command").alias("key")).agg(*_totals())


def biggest_save(records: DataFrame, key: str) -> DataFrame:
    """The record that saved most; ties go to the smallest ``key``. Cache hits do not count."""
    real = records.filter(~F.col("cache_hit"))
    return real.select("command", key, saved().alias("tokens_saved")).orderBy(F.col("tokens_saved").desc(), key).limit(1)


def monthly_projection(records: DataFrame) -> DataFrame:
    """Cost of the days that have records, carried on to 30."""
    price = model_price(F.coalesce("model", F.lit("")))
    return records.filter(F.col("ts") > 0).agg(
        F.sum(saved() * price / 1e6).alias("cost"), F.count_distinct(F.floor(F.col("ts") / DAY)).alias("days")
    ).withColumn("monthly", F.when(F.col("days") > 0, F.col("cost") / F.col("days") * 30).otherwise(0.0))


def quality_signals(records: DataFrame, group: str = "project") -> DataFrame:
    return records.groupBy(group).agg(
        F.count("*").alias("runs"),
        (F.sum(saved()) * 100.0 / F.sum("input_tokens")).alias("savings"),
        F.avg(F.col("cache_hit").cast("int") * 100.0).alias("cache_rate"),
        F.avg(F.when(F.col("subcommand") == "delta", 100.0).otherwise(0.0)).alias("delta_rate"),
        F.coalesce(F.stddev_pop(savings_pct(F.col("input_tokens"), F.col("output_tokens"))), F.lit(0.0)).alias("spread"),
    )


def quality_score(signals: DataFrame) -> DataFrame:
    """Score 0 to 100 and a grade: half of it savings against 90 %."""
    c = F.col
    hundred = F.lit(100.0)
    score = (
        0.50 * F.least(c("savings") / 90 * 100, hundred)
        + 0.10 * c("cache_rate")
        + 0.10 * c("delta_rate")
        + 0.15 * F.least(c("runs") / 30 * 100, hundred)
        + 0.15 * F.greatest(hundred - c("spread"), F.lit(0.0))
    )
    grade = F.when(score >= 90, "S").when(score >= 80, "A").when(score >= 70, "B").when(score >= 55, "C").otherwise("D")
    return signals.withColumn("score", score).withColumn("grade", grade)


def low_compression(records: DataFrame, most: int = 15) -> DataFrame:
    """Commands of five runs and 2000 tokens on that save less than 35 %, the largest first."""
    per = records.groupBy("command").agg(*_totals())
    ratio = F.col("tokens_saved") / F.col("tokens_in")
    found = per.filter((F.col("runs") >= 5) & (F.col("tokens_in") > 2000) & (ratio < 0.35))
    return found.withColumn("ratio", ratio).orderBy(F.col("tokens_in").desc(), "command").limit(most)


def savings_targets(spark, table: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((table or EXPECTED_SAVINGS).items()), "command string, target double")


def low_compression_potential(low: DataFrame, targets: DataFrame, default: float = 0.60) -> DataFrame:
    """What reaching the target would save beyond what is saved."""
    target = F.coalesce(F.col("target"), F.lit(default))
    return low.join(F.broadcast(targets), "command", "left").withColumn(
        "potential", F.greatest(F.floor(F.col("tokens_in") * target).cast("long") - F.col("tokens_saved"), F.lit(0))
    ).drop("target")


def measured_ratios(records: DataFrame) -> DataFrame:
    return records.groupBy("command").agg((F.sum(saved()) / F.sum("input_tokens")).alias("ratio")).filter("ratio > 0")


def opportunities(usage: DataFrame, measured: DataFrame, targets: DataFrame, most: int = 20, least: int = 500) -> DataFrame:
    """Commands run without filtering (command, tokens) by what they would have saved: measured, else the table, else 40 %."""
    ratio = F.coalesce("ratio", "target", F.lit(DEFAULT_SAVINGS))
    return (
        usage.groupBy("command").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"))
        .join(measured, "command", "left")
        .join(F.broadcast(targets), "command", "left")
        .select("command", "runs", "tokens", F.floor(F.col("tokens") * ratio).cast("long").alias("saveable"))
        .filter(F.col("saveable") >= least)
        .orderBy(F.col("saveable").desc(), "command")
        .limit(most)
    )


def tokens_per_read(reads: DataFrame) -> DataFrame:
    return reads.agg(F.greatest(F.lit(50.0), F.coalesce(F.avg("tokens"), F.lit(0.0))).alias("avg_tokens"))


def read_frequency(reads: DataFrame, since: int) -> DataFrame:
    """Reads per file against the most read one."""
    per = reads.filter(F.col("ts") >= since).groupBy("file").agg(F.count("*").alias("reads"))
    most = per.agg(F.max("reads").alias("_most"))  # one row, so that no task reads all files
    return per.crossJoin(F.broadcast(most)).withColumn("frequency", F.col("reads") / F.col("_most")).drop("_most")


def focus_precision(guidance: DataFrame, reads: DataFrame) -> DataFrame:
    """Per session the share of reads that guidance covers, where it recommended and files were read."""
    a = guidance.groupBy("session_id").agg(F.max("files_recommended").alias("recommended"))
    b = reads.groupBy("session_id").agg(F.count_distinct("file").alias("read"))
    return a.join(b, "session_id").filter("recommended > 0 and read > 0").withColumn("precision", F.least("recommended", "read") / F.col("read"))


def exclusion_ratio(guidance: DataFrame) -> DataFrame:
    return guidance.agg((F.sum(F.col("files_in_repo") - F.col("files_recommended")) / F.sum("files_in_repo")).alias("ratio"))


def focus_stats(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Sums over compression events and the share of later edits that hit a preserved section."""
    a = events.agg(*(F.sum(c).alias(c) for c in ("sections_total", "sections_preserved", "old_tokens", "new_tokens")))
    b = hits.agg(F.count("*").alias("edits"), F.avg(F.col("was_preserved").cast("int")).alias("hit_rate"))
    return a.crossJoin(b)


def attribute_edits(edits: DataFrame, events: DataFrame) -> DataFrame:
    """As-of join: each edit (session_id, file, ts, edit_line) with the newest earlier focus event of its
    file, and whether its line lies in a preserved section (half-open ranges)."""
    both = edits.select("session_id", "file", "ts", F.lit(1).alias("edit"), "edit_line", F.lit(None).cast(events.schema["sections"].dataType).alias("sections"))
    both = both.unionByName(events.select("session_id", "file", "ts", F.lit(0).alias("edit"), F.lit(None).cast("long").alias("edit_line"), "sections"))
    back = Window.partitionBy("session_id", "file").orderBy("ts", "edit").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("seen", F.last("sections", ignorenulls=True).over(back)).filter("edit = 1 and seen is not null")
    line = F.col("edit_line")
    return known.select(
        "session_id", "file", "ts", "edit_line",
        F.exists("seen", lambda s: s["preserved"] & (line >= s["begin"]) & (line < s["end"])).alias("was_preserved"),
    )


def retain(records: DataFrame, now: int, days: int = 365) -> DataFrame:
    return records.filter(F.col("ts") >= now - days * DAY)


def session_digest(entries: DataFrame, most: int = 8) -> DataFrame:
    """Per session the commands that used most tokens, as one line each."""
    per = entries.groupBy("session_id", "command").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("runs"))
    by = Window.partitionBy("session_id").orderBy(F.col("tokens").desc(), "command")
    top = per.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= most)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("n", "command", "runs", "tokens"))),
        lambda x: F.format_string("%s ×%d (%d tokens)", x["command"], x["runs"], x["tokens"]),
    )
    return top.groupBy("session_id").agg(F.array_join(lines, "\n").alias("digest"))


def digest_fingerprint(session: Column, edited: Column) -> Column:
    """What tells digests apart: the session and its five smallest edited paths."""
    return F.xxhash64(session, F.array_join(F.slice(F.array_sort(edited), 1, 5), "|"))
