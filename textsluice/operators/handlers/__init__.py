"""Command handlers: (output, subcommand) to a shorter output, applied to a frame by an Arrow UDF.

Every handler is a pure function of one document, so applying them is a narrow
operation; documents of unknown commands pass unchanged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textsluice.operators.handlers import build, shell, vcs  # noqa: F401  they register themselves
from textsluice.operators.handlers.base import ALIASES, REGISTRY, Handler, handler

WRAPPERS = ("sudo", "time", "npx", "bunx", "pnpx", "nice", "env", "command")


def resolve(command: str) -> tuple[str, str] | None:
    """(handler, subcommand) of a command line: environment, wrappers and folders aside; null for unknown ones."""
    tokens = [t for t in command.split() if t]
    while len(tokens) > 1 and (("=" in tokens[0] and tokens[0].split("=")[0].isupper()) or tokens[0] in WRAPPERS):
        tokens.pop(0)
    if not tokens:
        return None
    name = tokens[0].rsplit("/", 1)[-1]
    plain = [t for t in tokens[1:] if not t.startswith("-")]
    if name in ("python", "python3") and tokens[1:2] == ["-m"] and len(tokens) > 2:
        name, plain = tokens[2], [t for t in tokens[3:] if not t.startswith("-")]
    key = ALIASES.get(name)
    if key is None:
        return None
    two = {"gh", "terraform", "kubectl", "aws", "prisma", "(websearch)", "(grep)"}
    return key, " ".join(plain[: 2 if key in two else 1])


def handle(command: str | None, output: str | None) -> str | None:
    """The output after its command's handler; a longer result is not taken."""
    if output is None or not output.strip():
        return output
    found = resolve(command or "")
    if found is None:
        return output
    result = REGISTRY[found[0]](output, found[1])
    return result if result.strip() else output


@F.arrow_udf(StringType())
def handled(commands: pa.Array, outputs: pa.Array) -> pa.Array:
    return pa.array([handle(c, o) for c, o in zip(commands.to_pylist(), outputs.to_pylist(), strict=True)], pa.string())


def apply_handlers(df: DataFrame, command: Column | str = "command", output: Column | str = "output") -> DataFrame:
    """``df`` with filtered: each output after its command's handler."""
    c, o = (F.col(x) if isinstance(x, str) else x for x in (command, output))
    return df.withColumn("filtered", handled(c, o))


__all__ = ["ALIASES", "REGISTRY", "Handler", "apply_handlers", "handle", "handled", "handler", "resolve"]
