"""Building blocks of command handlers: small functions over a text's lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from textsluice.functions.compaction import rust_lines

Handler = Callable[[str, str], str]  # (output, subcommand) -> shorter output
REGISTRY: dict[str, Handler] = {}
#: Names that mean another command's handler.
ALIASES: dict[str, str] = {}

ERRORS = re.compile(r"(?i)\b(?:error|fatal|failed|failure|panic|exception)\b|^E ")
#: Lines that handlers never drop. Fixed values.
HARD_KEEP = ("error", "failed", "failure", "fatal", "panic", "exception", "denied", "refused", "timeout", "not found")


def handler(*names: str) -> Callable[[Handler], Handler]:
    def register(f: Handler) -> Handler:
        REGISTRY[names[0]] = f
        ALIASES.update(dict.fromkeys(names, names[0]))
        return f

    return register


def hard_keep(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in HARD_KEEP)


def full(text: str) -> list[str]:
    return [x for x in rust_lines(text) if x.strip()]


def join(lines: Iterable[str], original: str) -> str:
    """Lines as a text; where none are left, the original."""
    out = "\n".join(lines)
    return out if out.strip() else original


def where(lines: Iterable[str], pattern: str) -> list[str]:
    p = re.compile(pattern)
    return [x for x in lines if p.search(x)]


def without(lines: Iterable[str], pattern: str) -> list[str]:
    p = re.compile(pattern)
    return [x for x in lines if not p.search(x)]


def cap(lines: list[str], most: int, note: str = "[+{} more]") -> list[str]:
    """The first ``most`` lines, and a note of how many more there are."""
    return lines if len(lines) <= most else [*lines[:most], note.format(len(lines) - most)]


def last(lines: list[str], pattern: str = r"\S") -> list[str]:
    found = where(lines, pattern)
    return found[-1:]


def first(lines: list[str], pattern: str) -> list[str]:
    return where(lines, pattern)[:1]


def groups(pairs: Iterable[tuple[str, str]], each: int, total: int | None = None, sort: bool = True, head: str = "{}: [{} matches]") -> list[str]:
    """``head`` of each key with up to ``each`` of its lines, keys in byte order or as first met."""
    by: dict[str, list[str]] = {}
    for k, v in pairs:
        by.setdefault(k, []).append(v)
    out, shown = [], 0
    for k in sorted(by, key=lambda s: s.encode()) if sort else by:
        out.append(head.format(k, len(by[k])))
        take = by[k][: each if total is None else max(0, min(each, total - shown))]
        shown += len(take)
        out += [f"  {x}" for x in take]
        if len(by[k]) > len(take):
            out.append(f"  ... and {len(by[k]) - len(take)} more")
    return out


def blocks(lines: list[str], start: str, most: int, stop: str = r"^\s*$", one_more: bool = False) -> list[str]:
    """Each line that matches ``start`` and up to ``most`` lines after it, before one that matches ``stop``."""
    begin, end, out, left = re.compile(start), re.compile(stop), [], 0
    for x in lines:
        if begin.search(x):
            out.append(x)
            left = most
        elif left and end.search(x):
            left = 0
        elif left:
            out.append(x)
            left -= 1
    return out


def number(pattern: str, text: str) -> int | None:
    m = re.search(pattern, text)
    return int(m[1].replace(",", "")) if m else None


def columns(line: str) -> list[str]:
    """Cells between two spaces or more."""
    return re.split(r"\s{2,}", line.strip())


def header_starts(header: str) -> list[int]:
    return [m.start() for m in re.finditer(r"\S+", header)]


def cells(line: str, starts: list[int]) -> list[str]:
    return [line[a:b].strip() for a, b in zip(starts, [*starts[1:], None], strict=True)]


def cut(line: str, most: int) -> str:
    return line if len(line) <= most else line[:most] + "…"
