"""Pattern rules per command, as column expressions over a text's array of lines.

A rule acts on the lines its pattern matches; the first rule that matches a line
decides. The whole engine stays inside a row: no explode, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsluice.functions import text as T

LINE_ACTIONS = ("remove", "collapse", "replace", "truncate")


@dataclass(frozen=True)
class Rule:
    """``action``: remove, collapse, replace (text), truncate (n), match_output (text), head (n), tail (n), on_empty (text)."""

    regex: str
    action: str
    arg: str | int | None = None
    unless: str | None = None
    strip_ansi: bool = False


#: Rules per command that hold where the user sets none. Fixed values.
DEFAULT_RULES: dict[str, list[Rule]] = {
    "git": [
        Rule(r"^(Counting|Compressing|Receiving|Resolving) objects:.*", "remove"),
        Rule(r"^remote: (Counting|Compressing|Enumerating).*", "remove"),
    ],
    "cargo": [
        Rule(r"^\s+Compiling \S+ v[\d.]+", "collapse"),
        Rule(r"^\s+Downloaded \S+ v[\d.]+", "remove"),
        Rule(r"^error\[E\d+\]", "truncate", 200),
    ],
    "npm": [
        Rule(r"^npm warn.*", "remove"),
        Rule(r"^added \d+ packages.*", "replace", "[npm install complete]"),
        Rule(r"^\d+ packages are looking for funding.*", "remove"),
    ],
    "docker": [Rule(r"^ ---> [a-f0-9]+$", "remove"), Rule(r"^Removing intermediate container.*", "remove")],
    "kubectl": [
        Rule(r"^[WIE]\d{4}\s+", "remove"),
        Rule(r"^Warning:.*deprecated.*", "remove"),
        Rule(r"^resource mapping not found.*", "remove"),
    ],
    "terraform": [
        Rule(r"^\s*Refreshing state\.\.\.", "collapse"),
        Rule(r"^\s*Reading\.\.\.", "collapse"),
        Rule(r"^\s*[╷╵│].*", "remove"),
    ],
    "brew": [
        Rule(r"^==> Downloading https://", "collapse"),
        Rule(r"^==> Fetching dependencies", "remove"),
        Rule(r"^Already downloaded:", "remove"),
    ],
    "go": [
        Rule(r"^go: downloading ", "collapse"),
        Rule(r"^go: finding module ", "remove"),
        Rule(r"^go: extracting ", "remove"),
    ],
    "helm": [Rule(r"^coalesce\.go:\d+", "remove")],
    "pip": [
        Rule(r"^Collecting \S+", "collapse"),
        Rule(r"^  Downloading ", "remove"),
        Rule(r"^  Using cached ", "remove"),
        Rule(r"^Installing collected packages:", "remove"),
    ],
    "make": [
        Rule(r"^make\[\d+\]: Entering directory", "remove"),
        Rule(r"^make\[\d+\]: Leaving directory", "remove"),
        Rule(r"^make\[\d+\]: Nothing to be done", "remove"),
    ],
    "tsc": [Rule(r"^TS\d+: Build info file ", "remove")],
    "gh": [Rule(r"^✓ ", "remove")],
}
DEFAULT_ON_EMPTY = {"make": "(make: nothing to be done)"}


def _matches(rule: Rule, line: Column) -> Column:
    return (T.strip_ansi(line) if rule.strip_ansi else line).rlike(rule.regex)


def _any(lines: Column, regex: str, bare: bool = False) -> Column:
    return F.exists(lines, lambda x: (T.strip_ansi(x) if bare else x).rlike(regex))


def rule_number(rules: list[Rule], line: Column) -> Column:
    """Number of the rule that decides a line; null where none does."""
    out = None
    for k, r in enumerate(rules):
        if r.action in LINE_ACTIONS:
            out = F.when(_matches(r, line), k) if out is None else out.when(_matches(r, line), k)
    return F.lit(None).cast("int") if out is None else out


def should_remove(rules: list[Rule], line: Column) -> Column:
    """Whether any remove rule matches, whatever stands before it."""
    out = F.lit(False)
    for r in rules:
        if r.action == "remove":
            out = out | _matches(r, line)
    return out


def runs(values: Column) -> Column:
    """Array of (begin, count, value) of the runs of equal neighbours, from 1."""
    pairs = T.with_previous(values)
    begins = F.filter(
        F.transform(pairs, lambda p, i: F.when((i == 0) | (p["x"] != p["before"]), F.struct((i + 1).alias("begin"), p["x"].alias("value")))),
        lambda s: s.isNotNull(),
    )
    ends = lambda b: F.concat(F.transform(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), lambda s: s["begin"]), F.array(F.size(values) + 1))
    return T.let(
        begins,
        lambda b: F.zip_with(
            b, ends(b), lambda s, e: F.struct(s["begin"].alias("begin"), (e - s["begin"]).alias("count"), s["value"].alias("value"))
        ),
    )


def line_rules(lines: Column, rules: list[Rule]) -> Column:
    """Array of lines after remove, collapse, replace and truncate."""
    return T.let(lines, lambda own: _line_rules(own, rules))


def _line_rules(lines: Column, rules: list[Rule]) -> Column:
    numbers = F.transform(lines, lambda x: F.coalesce(rule_number(rules, x), F.lit(-1)))
    collapse = [k for k, r in enumerate(rules) if r.action == "collapse"]

    def one(number: Column, line: Column) -> Column:
        out = F.when(number == -1, F.array(line))
        for k, r in enumerate(rules):
            if r.action == "remove":
                out = out.when(number == k, F.array().cast("array<string>"))
            elif r.action == "replace":
                out = out.when(number == k, F.array(F.lit(r.arg)))
            elif r.action == "truncate":
                out = out.when(number == k, F.array(T.truncate_chars(line, int(r.arg))))
        return out.otherwise(F.array(line))

    def run(x: Column) -> Column:
        number = x["value"]
        kept = F.flatten(F.transform(F.slice(lines, x["begin"], x["count"]), lambda y: one(number, y)))
        if not collapse:
            return kept
        return F.when(number.isin(collapse), F.array(F.format_string("[%d matching lines collapsed]", x["count"]))).otherwise(kept)

    return F.when(F.size(lines) == 0, lines).otherwise(F.flatten(F.transform(runs(numbers), run)))


def _last(values: Column, n: int) -> Column:
    return T.let(values, lambda v: F.slice(v, F.greatest(F.size(v) - n, F.lit(0)) + 1, F.greatest(F.size(v), F.lit(1))))


def apply_rules(text: Column | str, rules: list[Rule], on_empty: str | None = None) -> Column:
    """A text after all rules: match_output first, then lines, then head and tail in rule order, then on_empty."""
    return T.let(T.lines(text), lambda lines: _apply(lines, rules, on_empty))


def _apply(lines: Column, rules: list[Rule], on_empty: str | None) -> Column:
    kept = _line_rules(lines, rules)
    for r in rules:
        if r.action == "head":
            kept = F.slice(kept, 1, int(r.arg))
        elif r.action == "tail":
            kept = _last(kept, int(r.arg))
    out = F.array_join(kept, "\n")
    fallback = on_empty if on_empty is not None else next((r.arg for r in rules if r.action == "on_empty"), None)
    if fallback is not None:
        out = T.let(out, lambda x: F.when(T.is_blank(x), F.lit(fallback)).otherwise(x))
    for r in reversed(rules):
        if r.action == "match_output":
            hit = _any(lines, r.regex, r.strip_ansi)
            if r.unless:
                hit = hit & ~_any(lines, r.unless)
            out = F.when(hit, F.lit(r.arg)).otherwise(out)
    return out


def command_rules(text: Column | str, command: Column | str, table: dict[str, list[Rule]] | None = None) -> Column:
    """Each text after the rules of its command; texts of other commands stay."""
    t, c = (F.col(x) if isinstance(x, str) else x for x in (text, command))
    out = None
    for name, rules in (table or DEFAULT_RULES).items():
        value = apply_rules(t, rules, DEFAULT_ON_EMPTY.get(name))
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return t if out is None else out.otherwise(t)


@dataclass(frozen=True)
class UserFilter:
    strip: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    match_output: str | None = None
    message: str = ""
    unless: str | None = None
    max_lines: int | None = None
    on_empty: str = ""


def user_filter(text: Column | str, f: UserFilter) -> Column:
    """match_output, then lines to strip, lines to keep, the cap, and what stands for nothing."""
    t = F.col(text) if isinstance(text, str) else text
    lines = T.lines(t)
    if f.strip:
        lines = F.filter(lines, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in f.strip)))
    if f.keep:
        lines = F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in f.keep)))
    if f.max_lines is not None:
        lines = F.slice(lines, 1, f.max_lines)
    out = T.let(lines, lambda x: F.when(F.size(x) == 0, F.lit(f.on_empty)).otherwise(F.array_join(x, "\n")))
    if f.match_output:
        hit = t.rlike(f.match_output)
        out = F.when(hit & ~t.rlike(f.unless) if f.unless else hit, F.lit(f.message)).otherwise(out)
    return out


def merge_filters(shared: dict[str, UserFilter], local: dict[str, UserFilter]) -> dict[str, UserFilter]:
    """Filters per command; a project's own replace the shared ones."""
    return {**shared, **local}
