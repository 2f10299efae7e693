"""Conversation compression: ages, tiers, sentence dedup, budget and staleness.

Messages are (conv_id, turn, role, text); every role but ``user`` follows the
assistant's rules.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textsluice.functions import text as T
from textsluice.functions.compaction import sentences as split
from textsluice.functions.summarise import summarise_message

RECENT, MIDDLE = 3, 8
#: Share of sentences kept by role and tier; 1.0 is verbatim.
RATIOS = {("user", 1): 0.55, ("user", 2): 0.20, ("other", 1): 1.0, ("other", 2): 0.60}


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


@F.arrow_udf(ArrayType(StringType()))
def sentences(texts: pa.Array) -> pa.Array:
    return pa.array([split(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))


def native_sentences(text: Column | str) -> Column:
    """The same sentences by a regular expression."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])(?=\s)|\n")
    return F.filter(F.transform(parts, T.trim), lambda s: s != "")


def ages(messages: DataFrame) -> DataFrame:
    """Messages with age (0 is the newest) and tier."""
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc())) - 1
    tier = F.when(F.col("age") < RECENT, 0).when(F.col("age") < MIDDLE, 1).otherwise(2)
    return messages.withColumn("age", age).withColumn("tier", tier)


def keep_ratio(role: Column, tier: Column) -> Column:
    out = F.when(tier == 0, 1.0)
    for (who, t), ratio in RATIOS.items():
        is_user = role == "user"
        out = out.when((is_user if who == "user" else ~is_user) & (tier == t), ratio)
    return out.otherwise(1.0)


@F.arrow_udf(StringType())
def summarised(texts: pa.Array, ratios: pa.Array, roles: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), ratios.to_pylist(), roles.to_pylist(), strict=True)
    return pa.array([t if not t or r >= 1.0 else summarise_message(t, r, who == "user") for t, r, who in rows], pa.string())


def compress(messages: DataFrame) -> DataFrame:
    """Messages with compressed: each summarised to its tier's share."""
    aged = ages(messages).withColumn("ratio", keep_ratio(F.col("role"), F.col("tier")))
    return aged.withColumn("compressed", summarised(F.col("text"), F.col("ratio"), F.col("role")))


def exact_sentence_dedup(messages: DataFrame) -> DataFrame:
    """User messages' sentences, with the earlier turn that already has the same one (null for the first)."""
    own = messages.filter("role = 'user'").select("conv_id", "turn", F.posexplode(native_sentences("text")).alias("n", "sentence"))
    first = F.min("turn").over(Window.partitionBy("conv_id", "sentence"))
    return own.withColumn("first_turn", first).select(
        "conv_id", "turn", "n", "sentence", F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn")).alias("covered_in")
    )


def near_sentence_dedup(embedded: DataFrame, least: float = 0.92) -> DataFrame:
    """Sentences (conv_id, turn, n, embedding) with the first earlier turn that has one as near. Pairs
    are joined within a conversation only, earlier against later messages."""
    from textsluice.functions.vectors import cosine

    early = embedded.select("conv_id", F.col("turn").alias("t0"), F.col("embedding").alias("e0"))
    pairs = embedded.join(early, "conv_id").filter((F.col("t0") < F.col("turn")) & (cosine(F.col("embedding"), F.col("e0")) >= least))
    found = pairs.groupBy("conv_id", "turn", "n").agg(F.min("t0").alias("covered_in"))
    return embedded.drop("embedding").join(found, ["conv_id", "turn", "n"], "left")


def mark_covered(rows: DataFrame) -> DataFrame:
    """Messages again, with ``[covered in turn N]`` in place of covered sentences."""
    shown = F.when(F.col("covered_in").isNull(), F.col("sentence")).otherwise(F.format_string("[covered in turn %d]", F.col("covered_in")))
    ordered = F.array_sort(F.collect_list(F.struct("n", shown.alias("s"))))
    return rows.groupBy("conv_id", "turn").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("text"))


def budget_pass(messages: DataFrame, most: int) -> DataFrame:
    """Which messages take a further step until their conversation fits ``most`` tokens.

    ``messages``: conv_id, turn, role, age, tokens, and tokens_less after the step. User
    messages go first, then others, oldest first, none of the newest RECENT. A step may
    add tokens, so a prefix counts as fitting once any prefix up to it fits.
    """
    order = Window.partitionBy("conv_id").orderBy((F.col("role") != "user").cast("int"), F.col("age").desc())
    whole = Window.partitionBy("conv_id")
    gain = F.when(F.col("age") >= RECENT, F.col("tokens") - F.col("tokens_less")).otherwise(0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    now = messages.withColumn("_left", F.sum("tokens").over(whole) - F.sum(gain).over(upto))
    now = now.withColumn("_least", F.min("_left").over(upto)).withColumn("_total", F.sum("tokens").over(whole))
    before = F.coalesce(F.lag("_least").over(order), F.col("_total"))
    step = (F.col("age") >= RECENT) & (F.least(before, F.col("_total")) > most)
    return now.withColumn("stepped", step).withColumn("tokens_after", F.when(step, F.col("tokens_less")).otherwise(F.col("tokens"))).drop("_left", "_least", "_total")


def cumulative_tokens(messages: DataFrame, tokens: Column | str = "tokens") -> DataFrame:
    """Per message the tokens sent so far when each turn sends all before it again."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    running = F.sum(c).over(by_turn().rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("context", running).withColumn("cumulative", F.sum("context").over(by_turn().rowsBetween(Window.unboundedPreceding, 0)))


def stale_flags(messages: DataFrame) -> DataFrame:
    """Messages that a later edit or a later read of the same kind makes stale."""
    low = F.lower("text")
    kind = (
        F.when(low.rlike(r"\b(edited|applied|wrote|updated) \S*|\+\+\+ "), "edit")
        .when(low.rlike(r"(?m)^(diff --git|@@ )"), "diff")
        .when(low.rlike(r"\b(error|failed|passed|compiling|build)\b"), "build")
    )
    known = messages.withColumn("kind", kind)
    last_edit = F.max(F.when(F.col("kind") == "edit", F.col("turn"))).over(Window.partitionBy("conv_id"))
    later = F.max("turn").over(Window.partitionBy("conv_id", "kind"))
    return known.withColumn(
        "stale", F.coalesce(F.col("kind").isin("build", "diff") & ((F.col("turn") < last_edit) | (F.col("turn") < later)), F.lit(False))
    )


def recent_intent(messages: DataFrame, newest: int = 3) -> DataFrame:
    """conv_id and intent: the first sentences of the newest assistant messages, newest first, at most 200, 150 and
    100 characters of each. Only the ``newest`` messages of a conversation are gathered."""
    said = messages.filter("role = 'assistant'").withColumn("text", T.trim("text")).filter("text <> ''")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    limit = F.when(F.col("n") == 1, 200).when(F.col("n") == 2, 150).otherwise(100)
    top = said.withColumn("n", n).filter(F.col("n") <= newest).select("conv_id", "n", T.clean_intent("text", limit).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "s")))
    return top.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " | ").alias("intent"))


def savings(before: DataFrame, text: str = "text", compressed: str = "compressed") -> DataFrame:
    a, b = T.token_estimate(text), T.token_estimate(compressed)
    return before.groupBy("conv_id").agg(F.sum(a).alias("tokens_in"), F.sum(b).alias("tokens_out"))
