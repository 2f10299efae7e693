"""Features of a text and the experts they route it to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsluice.functions import text as T

EXPERTS = (
    "ErrorFocus", "StatExtract", "Dedup", "DeltaMode", "StructureOnly", "SemanticSummary", "TreeCompress", "PassThrough",
)
ERROR_WORDS = r"(?i)error|warn|fail|fatal|panic|exception"


def features(lines: DataFrame) -> DataFrame:
    """Per doc_id: line_count, avg_line_length, error_line_density, repetition_ratio, has_stack_trace, is_tree, is_json."""
    t = T.trim("line")
    tree = t.rlike("^[├└│]") | (t.endswith(":") & ~t.contains(" ") & t.contains("/"))
    stack = t.startswith("at ") | t.contains(" at ") | t.startswith('File "') | t.startswith("goroutine ")
    marked = lines.select(
        "doc_id",
        "line_no",
        F.octet_length("line").alias("bytes"),
        t.rlike(ERROR_WORDS).cast("int").alias("error"),
        tree.cast("int").alias("tree"),
        stack.cast("int").alias("stack"),
        F.when(F.col("line_no") < 200, F.xxhash64(t)).alias("print"),
        F.when(t != "", F.struct("line_no", t.rlike(r"^[\[{]").alias("json"))).alias("opening"),
    )
    n = F.count("*")
    sampled = F.count("print")
    return marked.groupBy("doc_id").agg(
        n.alias("line_count"),
        (F.sum("bytes") / n).alias("avg_line_length"),
        (F.sum("error") / n).alias("error_line_density"),
        ((sampled - F.count_distinct("print")) / sampled).alias("repetition_ratio"),
        (F.sum("stack") >= 3).alias("has_stack_trace"),
        (F.sum("tree") / n > 0.15).alias("is_tree"),
        F.coalesce(F.min("opening")["json"], F.lit(False)).alias("is_json"),
    )


def byte_entropy(lines: DataFrame) -> DataFrame:
    """doc_id, entropy: of the bytes of each line's first 128, over 8 bits."""
    hexed = F.hex(F.encode(F.col("line"), "UTF-8"))
    pairs = lines.select("doc_id", F.explode(F.regexp_extract_all(F.substring(hexed, 1, 256), F.lit(".."), F.lit(0))).alias("b"))
    counts = pairs.groupBy("doc_id", "b").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc_id").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("weighted")
    )
    bits = F.log2("all") - F.col("weighted") / F.col("all")
    return total.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), bits / 8)).alias("entropy"))


def scores(recent: Column | None = None, unchanged: Column | None = None) -> Column:
    """Array of the experts' scores over the feature columns."""
    c = F.col
    recent, unchanged = (F.lit(False) if x is None else x for x in (recent, unchanged))
    zero = F.lit(0.0)
    return F.array(
        c("error_line_density") * 2.0 + F.when(c("has_stack_trace"), 1.5).otherwise(zero),
        F.when((c("error_line_density") < 0.05) & (c("avg_line_length") < 80), 0.8 * (1 - c("entropy"))).otherwise(zero),
        c("repetition_ratio") * 2.5,
        F.when(recent & ~unchanged, 3.0).otherwise(zero),
        F.when(unchanged, 3.0).when(c("line_count") > 500, 1.0).otherwise(zero),
        c("entropy") * 1.5 * (1 - c("repetition_ratio")),
        F.when(c("is_tree"), 3.0).otherwise(zero),
        F.when(c("line_count") < 30, 2.0).when((c("entropy") > 0.85) & (c("error_line_density") < 0.02) & ~c("is_tree"), 1.5).otherwise(zero),
    )


def top_experts(score: Column, pressure: Column | float = 0.0) -> Column:
    """Array of (expert, weight): the two best, three under pressure, with softmax weights."""
    pressure = F.lit(pressure) if isinstance(pressure, float) else pressure
    k = F.when(pressure > 0.7, 3).otherwise(2)
    placed = F.zip_with(
        score, F.array(*(F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(EXPERTS))),
        lambda s, x: F.struct((-s).alias("n"), x["i"].alias("i"), x["e"].alias("expert"), s.alias("s")),
    )
    best = F.slice(F.array_sort(placed), F.lit(1), k)
    top = F.array_max(F.transform(best, lambda x: x["s"]))
    powers = T.let(top, lambda t: F.transform(best, lambda x: F.struct(x["expert"].alias("expert"), F.exp(x["s"] - t).alias("e"))))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x["e"])
    return T.let(total, lambda n: F.transform(powers, lambda x: F.struct(x["expert"].alias("expert"), (x["e"] / n).alias("weight"))))


def hhi(counts: list[Column]) -> Column:
    """Concentration of activations: sum of squared shares, 1/8 where there are none."""
    total = reduce(lambda a, b: a + b, counts)
    return F.when(total == 0, 1 / 8).otherwise(reduce(lambda a, b: a + b, [F.pow(c / total, F.lit(2)) for c in counts]))


def exploration_bonus(counts: list[Column]) -> list[Column]:
    """0.5 for every other expert where one has more than 70 % of activations (the last of the largest)."""
    total, top = reduce(lambda a, b: a + b, counts), F.greatest(*counts)
    order = F.array(*counts)
    lead = F.size(order) - F.array_position(F.reverse(order), top).cast("int")
    return [F.when((total > 0) & (top / total > 0.70) & (lead != i), 0.5).otherwise(0.0) for i in range(len(counts))]


def tighten(value: Column, pressure: Column, share: float, least: int) -> Column:
    """A limit under pressure: ``value * (1 - share * p)``, ``least`` at least; no change below 1 %."""
    return F.when(pressure < 0.01, value).otherwise(F.greatest(F.floor(value * (1 - share * pressure)), F.lit(least))).cast("long")


def context_pressure(tokens: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tokens - 25_000) / 55_000.0))


def stability_pressure(similarity: Column) -> Column:
    return F.when(similarity < 0.85, 0.0).otherwise(F.least((similarity - 0.85) / 0.15 * 0.8, F.lit(0.8)) * 0.4)


def staleness_pressure(stale: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(stale / total * 0.5, F.lit(0.3))).otherwise(0.0)


def compression_factor(tokens: Column) -> Column:
    """1.0 up to 50k tokens, 0.5 from 100k on."""
    return F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1.0 - (tokens - 50_000) / 50_000.0 * 0.5))
