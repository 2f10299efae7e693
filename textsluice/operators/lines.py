"""Line operators: documents become rows of lines, are filtered, and become documents again.

``L`` below is a frame (doc_id, line_no, line); operators keep its other columns.
Every windowed operator partitions by doc_id, so that one shuffle by document
serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.functions import text as T


def by_doc():
    return Window.partitionBy("doc_id").orderBy("line_no")


def whole():
    return Window.partitionBy("doc_id")


#: Noise predicates on trimmed lines. Fixed values.
BAR = r"^\s*(?:[\[(]\s*[=\-#*>▓░▒]{3,}[\s=\-#*>▓░▒]*[\])]|[=\-#*>]{8,})\s*\d{0,3}\.?\d*\s*%?\s*$"
DOWNLOAD = r"(?i)^\s*(downloading|fetching|pulling|pushing|receiving objects|resolving deltas|writing objects|counting objects|compressing objects|remote:)\s"
SPINNER = r"^\s*[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\\-]\s*$"
PERCENT = r"^\s*\d{1,3}(\.\d+)?\s*%\s*(done|complete|completed|of \d+)?\s*$"
RATIO = r"^\s*\d+\s*/\s*\d+\s*$"
DECORATOR = r"^(?:\s*[─═━\-=*#~+_▓░▒·•]){10,}\s*$"
#: Tested on the line as it stands.
BUILDING = r"^\s{2,}(Compiling|Checking|Fresh)\s+\S"


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line. A text without lines gives no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.lines(text_col)).alias("line_no", "line"))


def reassemble(lines: DataFrame) -> DataFrame:
    """doc_id, text of the lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def trim_right(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", T.rtrim("line"))


def dedup_consecutive(lines: DataFrame) -> DataFrame:
    """Drops lines equal to the one before; a line kept equals the last kept one exactly where its
    direct predecessor does, so one lag is enough."""
    before = F.lag("line").over(by_doc())
    return lines.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("line"))).drop("_before")


def collapse_blanks(lines: DataFrame) -> DataFrame:
    """Keeps the first line of each run of blank ones."""
    blank = T.is_blank("line")
    before = F.lag(blank.cast("int"), 1, 0).over(by_doc())
    return lines.withColumn("_before", before).filter(~(blank & (F.col("_before") == 1))).drop("_before")


def normalize_lines(lines: DataFrame) -> DataFrame:
    return collapse_blanks(dedup_consecutive(trim_right(lines)))


def global_rule(line: Column | str = "line") -> Column:
    """Name of the noise predicate that drops a line; null where none does. Blank lines stay."""
    c = F.col(line) if isinstance(line, str) else line
    t = T.trim(c)
    return (
        F.when(t == "", None)
        .when(t.rlike(BAR), "progress_bar")
        .when(t.rlike(DOWNLOAD), "download")
        .when(t.rlike(SPINNER), "spinner")
        .when(t.rlike(PERCENT), "percent")
        .when(t.rlike(RATIO), "ratio")
        .when(t.rlike(DECORATOR), "decorator")
        .when(c.rlike(BUILDING), "build_progress")
    )


def drop_global_noise(lines: DataFrame) -> DataFrame:
    return lines.filter(global_rule().isNull())


def head_tail(lines: DataFrame, head: int = 30, tail: int = 30) -> DataFrame:
    """First and last lines of longer documents with ``[--- k more lines ---]`` between them."""
    n, at = F.count("*").over(whole()), F.row_number().over(by_doc())
    placed = lines.withColumn("_n", n).withColumn("_at", at)
    long = F.col("_n") > head + tail
    kept = placed.filter(~long | (F.col("_at") <= head) | (F.col("_at") > F.col("_n") - tail) | (F.col("_at") == head + 1))
    mark = long & (F.col("_at") == head + 1) & (F.col("_at") <= F.col("_n") - tail)
    return kept.withColumn("line", F.when(mark, F.format_string("[--- %d more lines ---]", F.col("_n") - head - tail)).otherwise(F.col("line"))).drop("_n", "_at")


def input_ceiling(text: Column | str, most: int = 200_000) -> Column:
    """Texts of more than ``most`` bytes cut to as many characters, with a note."""
    c = F.col(text) if isinstance(text, str) else text
    note = F.format_string(
        "\n[--- input truncated: kept %dk of %dk chars ---]", F.lit(most // 1024), F.floor(F.octet_length(c) / 1024).cast("long")
    )
    return F.when(F.octet_length(c) > most, F.concat(F.substring(c, 1, most), note)).otherwise(c)


def output_cap(text: Column | str, most: int = 50_000) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    note = f"\n[--- output capped at {most // 1024}k chars ---]"
    return F.when(F.octet_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(note))).otherwise(c)


def removal_gate(before: Column, after: Column, most: float = 0.80) -> Column:
    """Whether so many lines went that the semantic stage is skipped."""
    return F.when(before > 0, 1 - after / before > most).otherwise(False)


def similar_runs(lines: DataFrame, key: Column, show: int = 3) -> DataFrame:
    """Runs of lines with equal keys: the first ``show`` and a count of the rest (run_no, place, omitted)."""
    changed = F.coalesce((key != F.lag(key).over(by_doc())).cast("int"), F.lit(1))
    runs = lines.withColumn("_new", changed).withColumn("run_no", F.sum("_new").over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "run_no")
    return (
        runs.withColumn("place", F.row_number().over(inside.orderBy("line_no")))
        .withColumn("omitted", F.greatest(F.count("*").over(inside) - show, F.lit(0)))
        .filter(F.col("place") <= show)
        .drop("_new")
    )
