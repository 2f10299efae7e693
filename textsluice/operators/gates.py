"""What decides whether, and how far, an output is worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.functions import text as T

MIN_TOKENS = 15
#: Commands without output of their own, and words that show there is some after all. Fixed values.
SILENT = ("sleep", "wait", "true", "false", ":")
SIGNALS = "error|Error|invalid"
#: Calls of the embedding per document, and what is shown beyond them.
CALLS, CALLS_HEAD, CALLS_TAIL = 12, 40, 20
#: Extensions of source code. Fixed values.
CODE = ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "java", "cs", "cpp", "cc", "c", "h", "hpp", "py", "pyi")


def too_small(text: Column) -> Column:
    return T.token_estimate(text) < MIN_TOKENS


def leaked(command: Column, text: Column) -> Column:
    """Output of a command that has none: it belongs to another one. False where it shows an error."""
    return F.coalesce(command.isin(*SILENT) & ~text.rlike(SIGNALS), F.lit(False))


def untouched(command: Column, text: Column) -> Column:
    """Whether an output passes as it is."""
    return too_small(text) | leaked(command, text)


def block_kind(lines: Column) -> Column:
    """What a block of lines is about; the first of the tests that holds."""
    low = F.lower(F.array_join(lines, "\n"))
    has = lambda *words: low.rlike("|".join(words))
    passing = has("passed", " ok") & ~has("failed", "error:") & has("test")
    return (
        F.when(F.size(lines) == 0, "filtered output")
        .when(F.forall(lines, lambda x: x.rlike(r"(?U)^\s*(?:Compiling|Checking|Download|Fetching|Updating)")), "build/download progress")
        .when(has("error:", r"error\["), "error details")
        .when(has("panicked", "stack backtrace"), "stack trace")
        .when(passing, "passing tests")
        .when(has("warning:"), "compiler warnings")
        .when(has("note:"), "compiler notes")
        .when(F.forall(lines, lambda x: x.rlike("^(?:  |\t)")), "indented detail")
        .otherwise("filtered output")
    )


def focus_applies(path: Column, n_lines: Column, sections: Column, compressed: Column, asked: Column) -> Column:
    """Whether a file is reduced towards the prompt: a prompt is known, it is code, long, and some section would shrink."""
    return asked & T.extension(path).isin(*CODE) & (n_lines >= 150) & (sections >= 2) & (compressed >= 1)


def within_calls(df: DataFrame, document: str, order: str, most: int = CALLS) -> DataFrame:
    """``df`` with allowed: whether the document's budget of embedding calls still covers the row."""
    return df.withColumn("allowed", F.row_number().over(Window.partitionBy(document).orderBy(order)) <= most)


def beyond_calls(lines: Column) -> Column:
    """A text whose budget is used up: its first and last lines, and how many are left out."""
    n = F.size(lines)
    mark = F.format_string("[... %d lines omitted — BERT budget exhausted ...]", n - CALLS_HEAD - CALLS_TAIL)
    cut = F.concat(F.slice(lines, 1, CALLS_HEAD), F.array(mark), F.slice(lines, n - CALLS_TAIL + 1, F.lit(CALLS_TAIL)))
    return F.array_join(F.when(n > CALLS_HEAD + CALLS_TAIL, cut).otherwise(lines), "\n")
