"""Command lines as column expressions: what precedes a command, where its output goes, what it is rewritten to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsluice.functions.text import basename, trim

#: ``KEY=value`` words before a command; quoted stretches belong to their word. Possessive, so that long values need no stack.
ASSIGNMENTS = r"""(?s)^(?:\s*+[A-Za-z_][A-Za-z0-9_]*+=(?:[^\s'"]++|'[^']*+(?:'|\z)|"(?:[^"\\]++|\\.)*+(?:"|\z))*+)*+\s*+"""
QUOTED = r"""'[^']*(?:'|\z)|"[^"]*(?:"|\z)"""
_OPTION = r"(?:(?:-n|--lines)\s+\S+|--lines=\S*|-+[0-9]+)"
HEAD_TAIL = rf"^(?:head|tail)(?:\s+{_OPTION})*\s+([^-\s]\S*)(?:\s+{_OPTION})*(?:\s+(?:-n|--lines))?\s*\z"
#: Operators between commands, tried in this order. Fixed values.
OPERATORS = (" && ", " || ", "; ")


def without_assignments(command: Column) -> Column:
    return F.regexp_replace(command, ASSIGNMENTS, "")


def diverts_output(command: Column) -> Column:
    """Whether standard output goes to a file or a pipe, outside of quotes; ``||``, ``->`` and ``=>`` do neither."""
    bare = F.regexp_replace(command, QUOTED, "Q")
    return F.replace(bare, F.lit("||"), F.lit("  ")).contains("|") | bare.rlike("(?:^|[^-=])>")


def head_or_tail(command: Column) -> Column:
    """``cat FILE`` for head and tail by lines of one file; null for other commands and options."""
    file = F.regexp_extract(trim(command), HEAD_TAIL, 1)
    return F.when(file != "", F.concat(F.lit("cat "), file))


def _one(command: Column, known: Sequence[str], runner: str) -> Column:
    c = trim(command)
    prefix, bare = F.regexp_extract(c, ASSIGNMENTS, 0), without_assignments(c)
    plain = F.when(basename(F.regexp_extract(bare, r"^(\S+)", 1)).isin(*known), bare)
    fits = ~diverts_output(c) & ~c.startswith(f"{runner} ")
    return F.when(fits, F.concat(prefix, F.lit(f"{runner} "), F.coalesce(head_or_tail(bare), plain)))


def rewritten(command: Column, known: Sequence[str], runner: str = "run") -> Column:
    """The command with ``runner`` before each part whose program is known; null where there is none.

    The first of OPERATORS that gives a change splits a compound; other parts stay as they are.
    """
    tried = []
    for operator in OPERATORS:
        parts = F.transform(F.split(command, operator.replace("|", r"\|")), trim)
        own = F.transform(parts, lambda p: _one(p, known, runner))
        joined = F.array_join(F.zip_with(own, parts, lambda a, b: F.coalesce(a, b)), operator)
        tried.append(F.when(command.contains(operator) & F.exists(own, lambda x: x.isNotNull()), joined))
    return F.coalesce(*tried, _one(command, known, runner))
