"""Structured logs and errors as frames: JSON levels, repeated lines, error sets from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

import pyarrow as pa

from textsluice.functions import text as T
from textsluice.functions.compaction import ERROR_KEYS, LEVEL_KEYS, LEVELS, MESSAGE_KEYS, error_signatures
from textsluice.operators.lines import similar_runs

SIGNATURES = ArrayType(
    StructType(
        [
            StructField("code", StringType()),
            StructField("file", StringType()),
            StructField("line_no", IntegerType()),
            StructField("message", StringType()),
            StructField("severity", StringType()),
            StructField("key", StringType()),
        ]
    )
)


def _first(row: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(row, f"$.{k}") for k in keys))


def is_object(line: Column | str) -> Column:
    c = F.trim(F.col(line) if isinstance(line, str) else line)
    return c.startswith("{") & F.try_parse_json(c).isNotNull()


def json_level(line: Column | str) -> Column:
    """Normalised level of a JSON record; unknown ones are INFO."""
    c = F.col(line) if isinstance(line, str) else line
    raw = F.upper(F.coalesce(_first(c, LEVEL_KEYS), F.lit("INFO")))
    out = None
    for name, aliases in LEVELS.items():
        out = F.when(raw.isin(*aliases), name) if out is None else out.when(raw.isin(*aliases), name)
    return out.otherwise("INFO")


def json_records(lines: DataFrame) -> DataFrame:
    """Lines that are JSON objects, with level, message and error."""
    return lines.filter(is_object("line")).select(
        "*",
        json_level("line").alias("level"),
        F.coalesce(_first(F.col("line"), MESSAGE_KEYS), F.substring(F.trim("line"), 1, 80)).alias("message"),
        _first(F.col("line"), ERROR_KEYS).alias("error"),
    )


def json_log_documents(lines: DataFrame) -> DataFrame:
    """Per doc_id: full lines, objects among them, and whether it is a JSON log."""
    has_level = F.coalesce(*(F.get_json_object("line", f"$.{k}") for k in LEVEL_KEYS)).isNotNull()
    per = lines.filter(~T.is_blank("line")).groupBy("doc_id").agg(
        F.count("*").alias("full_lines"),
        F.count_if(is_object("line")).alias("objects"),
        F.bool_or(is_object("line") & has_level).alias("has_level"),
    )
    return per.withColumn("is_json_log", (F.col("full_lines") >= 3) & (2 * F.col("objects") > F.col("full_lines")) & F.col("has_level"))


def info_runs(records: DataFrame, show: int = 3) -> DataFrame:
    """Runs of info records with the same beginning: the first ``show`` and how many are left out."""
    return similar_runs(records.filter("level = 'INFO'"), F.substring("message", 1, 20), show)


def distinct_messages(records: DataFrame) -> DataFrame:
    """Per document each level and message once, at its first line."""
    turn = Window.partitionBy("doc_id", "level", "message").orderBy("line_no")
    return records.withColumn("_n", F.row_number().over(turn)).filter("_n = 1").drop("_n")


def log_counts(lines: DataFrame) -> DataFrame:
    """Per document each normalised line with its count and first line number."""
    return lines.filter(~T.is_blank("line")).groupBy("doc_id", T.normalize_log("line").alias("pattern")).agg(
        F.count("*").alias("n"), F.min("line_no").alias("first_line")
    )


@F.arrow_udf(SIGNATURES)
def signatures(texts: pa.Array) -> pa.Array:
    kind = pa.list_(
        pa.struct([(k, pa.int32() if k == "line_no" else pa.string()) for k in ("code", "file", "line_no", "message", "severity", "key")])
    )
    return pa.array([error_signatures(t) if t else [] for t in texts.to_pylist()], kind)


def error_sets(runs: DataFrame, keys: list[str], order: str, errors: str = "errors") -> DataFrame:
    """Runs with fixed, new and unchanged errors against the run before with the same ``keys``.

    ``errors`` is an array of error keys; a run without a run before has all of them new.
    """
    before = F.lag(errors).over(Window.partitionBy(*keys).orderBy(order))
    none = F.array().cast("array<string>")
    now, past = F.coalesce(F.col(errors), none), F.coalesce(F.col("_before"), none)
    return (
        runs.withColumn("_before", before)
        .withColumn("fixed", F.array_sort(F.array_except(past, now)))
        .withColumn("new", F.array_sort(F.array_except(now, past)))
        .withColumn("unchanged", F.array_sort(F.array_intersect(now, past)))
        .drop("_before")
    )


def error_report(fixed: Column, new: Column, unchanged: Column) -> Column:
    """A report of an error loop; null where nothing stayed unchanged."""

    def part(title: str, x: Column) -> Column:
        return F.when(F.size(x) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.transform(x, lambda e: F.concat(F.lit("  "), F.substring(e, 1, 100))), "\n"))).otherwise("")

    head = F.format_string("[error loop: %d unchanged, %d new, %d fixed]", F.size(unchanged), F.size(new), F.size(fixed))
    return F.when(F.size(unchanged) > 0, F.concat(head, part("unchanged", unchanged), part("new", new), part("fixed", fixed)))


def last_errors(runs: DataFrame, keys: list[str], order: str, errors: str = "errors") -> DataFrame:
    """As-of join: each run with the newest earlier run's errors, runs without any skipped."""
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.size(errors) > 0, F.col(errors))
    return runs.withColumn("last_errors", F.last(some, ignorenulls=True).over(back))


def learn_noise(before: DataFrame, after: DataFrame, group: str = "project") -> DataFrame:
    """Noise statistics per group and line key: count, suppressed, and whether it is promoted.

    ``before`` and ``after``: group, doc_id, line. A line counts as suppressed where its
    key is missing from its document's output.
    """
    kept = after.select("doc_id", T.noise_key("line").alias("pattern")).distinct()
    seen = before.select(group, "doc_id", T.noise_key("line").alias("pattern"))
    counted = seen.groupBy(group, "doc_id", "pattern").agg(F.count("*").alias("n"))
    joined = counted.join(kept.withColumn("kept", F.lit(1)), ["doc_id", "pattern"], "left")
    return promote_noise(
        joined.groupBy(group, "pattern").agg(
            F.sum("n").alias("count"), F.sum(F.when(F.col("kept").isNull(), F.col("n")).otherwise(0)).alias("suppressed")
        )
    )


def promote_noise(stats: DataFrame, least: int = 10, rate: float = 0.9) -> DataFrame:
    critical = F.col("pattern").rlike(T.NOISE_CRITICAL)
    return stats.withColumn("promoted", (F.col("count") >= least) & (F.col("suppressed") / F.col("count") >= rate) & ~critical)


def merge_noise(stored: DataFrame, fresh: DataFrame, now: int, group: str = "project", age: int = 30 * 86_400, most: int = 10_000) -> DataFrame:
    """Adds counts up, evicts patterns not seen for ``age`` seconds, and keeps the ``most`` latest of a group."""
    both = stored.select(group, "pattern", "count", "suppressed", "last_seen").unionByName(
        fresh.select(group, "pattern", "count", "suppressed", "last_seen")
    )
    merged = both.groupBy(group, "pattern").agg(F.sum("count").alias("count"), F.sum("suppressed").alias("suppressed"), F.max("last_seen").alias("last_seen"))
    turn = Window.partitionBy(group).orderBy(F.col("last_seen").desc(), "pattern")
    kept = merged.filter(F.col("last_seen") >= now - age).withColumn("_n", F.row_number().over(turn)).filter(F.col("_n") <= most).drop("_n")
    return promote_noise(kept)


def drop_promoted(lines: DataFrame, noise: DataFrame, group: str = "project") -> DataFrame:
    """Lines whose key is not promoted noise of their group; critical ones always stay."""
    known = noise.filter("promoted").select(group, F.col("pattern").alias("_key"))
    keyed = lines.withColumn("_key", F.when(F.col("line").rlike(T.NOISE_CRITICAL), None).otherwise(T.noise_key("line")))
    return keyed.join(known, [group, "_key"], "left_anti").select(*lines.columns)
