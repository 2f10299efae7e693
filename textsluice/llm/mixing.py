"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: every source asks for its weight's share of all words; a
source that would pass ``max_epochs`` times its size is clamped there and the
excess goes to the others by weight, until none is above. With sources in order
of cap / weight the clamped ones are a prefix, so the level is found in one pass.
Each source is then repeated whole as often as its target allows, and the rest
of the target is filled in a seeded order of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.llm.common import WORD, Scratch, text_or_empty

#: Digits of the seeded order, hexadecimal, and how many of them each level of the search fixes.
DIGITS, STEP = 12, 3


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets of sources. ``sizes``: source, source_size. Adds weight and target.

    Sources in code-point order, null last, take ``weights`` in turn. The targets
    add up to all sizes. A source without words has target 0; no rows give none.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    own = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn(
        "cap", F.col("source_size") * max_epochs
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = own.select("*", (left / open_weight).alias("at"))
    fits = F.when(F.col("at") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "at"))
    return (
        levels.withColumn("level", F.min(fits).over(everything)["at"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))
    )


def seeded_order(id_col: str, seed: str, text_col: str) -> Column:
    """Hexadecimal digits that order documents at random, the same in every run; rows without an id go by their text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), F.xxhash64(text_col).cast("string")))
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), name)), 1, DIGITS)


def _cells(spine: DataFrame, weights: tuple[int, ...], max_epochs: int, scratch: Scratch) -> DataFrame:
    """Per source: its size, target, whole repetitions, the words still wanted, and the digits of the
    document at which these are reached with the words before it.

    Found by digits, so that no task ever sorts a whole source: words are summed by
    source and leading digits, and only the cell that holds the point is looked at
    more closely.
    """
    totals = spine.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = scratch.save(
        water_fill(totals, weights, max_epochs)
        .withColumn("whole", F.least(F.floor(epochs), F.lit(max_epochs)).cast("long"))
        .withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")),
        "plan",
    )
    cell = plan.select("source", "want", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for depth in range(STEP, DIGITS + 1, STEP):
        inside = spine.join(
            cell.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "inner"
        ).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("source", "want", "before", F.substring("key", 1, depth).alias("next")).agg(
            F.sum("size").alias("words")
        )
        ordered = Window.partitionBy("source").orderBy("next")
        run = sums.withColumn("upto", F.col("before") + F.sum("words").over(ordered))
        cell = scratch.save(
            run.filter(F.col("upto") >= F.col("want"))
            .groupBy("source", "want")
            .agg(F.min_by(F.struct("next", "upto", "words"), "next").alias("c"))
            .select("source", "want", F.col("c.next").alias("prefix"), (F.col("c.upto") - F.col("c.words")).alias("before")),
            f"cell{depth}",
        )
    return scratch.save(
        plan.join(
            cell.select(F.col("source").alias("s"), "prefix", "before"), F.col("source").eqNullSafe(F.col("s")), "left"
        ).drop("s", "weight"),
        "cells",
    )


def _repeats(rows: DataFrame, cells: DataFrame, max_epochs: int) -> DataFrame:
    """``rows`` (id, source, size, key, ...) with their source's cell and repeats."""
    placed = rows.join(cells.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_point = F.coalesce(F.col("key") == F.col("prefix"), F.lit(False))
    ties = Window.partitionBy("source", "prefix").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, 0)
    decided = placed.filter(~at_point).withColumn("extra", (F.col("want") > 0) & F.coalesce(F.col("key") < F.col("prefix"), F.lit(False)))
    point = placed.filter(at_point).withColumn(
        "extra", (F.col("want") > 0) & (F.col("before") + F.sum("size").over(ties) - F.col("size") / 2 <= F.col("want"))
    )
    repeats = F.col("whole") + F.when(F.col("extra") & (F.col("whole") < max_epochs), 1).otherwise(0)
    return decided.unionByName(point).withColumn("repeats", repeats)


def _spine(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
        seeded_order(id_col, seed, text_col).alias("key"),
        *more,
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken, repeats.

    ``taken`` is size times ``repeats``. A source's ``taken`` differs from its
    target by half of one document at most: in seeded order, a document gets one
    more repetition if its middle lies before the fractional part of the target.
    Null text has size 0; rows that share an id fall together and are taken in one
    order; no rows give none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    spine = scratch.save(_spine(docs, seed, id_col, text_col, source_col), "spine")
    cells = _cells(spine, weights, max_epochs, scratch)
    return _repeats(spine, cells, max_epochs).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).cast("long").alias("taken"),
        F.col("repeats").cast("long").alias("repeats"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with each row as often as :func:`mix_plan` takes it; all columns stay, texts are not shuffled."""
    scratch = Scratch(docs.sparkSession, "mix")
    cells = _cells(scratch.save(_spine(docs, seed, id_col, text_col, source_col), "spine"), weights, max_epochs, scratch)
    scratch.keep("cells")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    taken = _repeats(_spine(docs, seed, id_col, text_col, source_col, row), cells, max_epochs).filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats").cast("long"))).alias("turn")).select("row.*")
