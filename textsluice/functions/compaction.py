"""Sequential text functions: one text in, one text out, for use in Arrow UDFs.

What a line becomes here depends on state that earlier lines left, or on a parse;
everything that does not is a column expression elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textsluice.functions.hashing import simhash64
from textsluice.functions.text import CRITICAL

critical = re.compile(CRITICAL)


def rust_lines(text: str) -> list[str]:
    """Lines between ``\\n``, without closing ``\\r`` and without an empty last one."""
    if not text:
        return []
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def per_text(f: Callable[[str], str]):
    """An Arrow UDF of a text function; null stays null."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run


def per_pair(f: Callable[[str, str], str]):
    """An Arrow UDF of a function of two strings; null is empty."""

    @F.arrow_udf(StringType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    return run


def parse_object(line: str) -> dict[str, Any] | None:
    t = line.strip()
    if not t.startswith("{"):
        return None
    try:
        found = json.loads(t)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


# --- JSON logs -------------------------------------------------------------------------------

#: Keys probed in order, and names of levels. Fixed values.
LEVEL_KEYS = ("level", "severity", "lvl", "log_level", "loglevel")
MESSAGE_KEYS = ("message", "msg", "text", "body", "log")
ERROR_KEYS = ("error", "err", "exception", "cause")
LEVELS = {
    "ERROR": ("ERROR", "ERR", "FATAL", "CRITICAL", "CRIT", "PANIC"),
    "WARN": ("WARN", "WARNING", "WRN"),
    "INFO": ("INFO", "INF", "INFORMATION"),
    "DEBUG": ("DEBUG", "DBG", "DEBU"),
    "TRACE": ("TRACE", "TRC", "VERBOSE"),
}
_LEVEL = {alias: name for name, aliases in LEVELS.items() for alias in aliases}


def first_text(row: dict[str, Any], keys: tuple[str, ...]) -> str | None:
    for key in keys:
        value = row.get(key)
        if isinstance(value, str):
            return value
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return json.dumps(value)
    return None


def is_json_log(lines: list[str]) -> bool:
    full = [x for x in lines if x.strip()]
    rows = [r for r in map(parse_object, full) if r is not None]
    return len(full) >= 3 and 2 * len(rows) > len(full) and any(k in r for r in rows for k in LEVEL_KEYS)


def compact_json_log(text: str) -> str:
    """One short line per record; debug records go, runs of similar info records are cut to three."""
    lines = rust_lines(text)
    if not is_json_log(lines):
        return text
    out: list[str] = []
    prefix, seen = None, 0

    def close() -> None:
        nonlocal prefix, seen
        if seen > 3:
            out.append(f"[{seen - 3} similar INFO lines omitted]")
        prefix, seen = None, 0

    for line in lines:
        row = parse_object(line)
        if row is None:
            close()
            if line.strip():
                out.append(line)
            continue
        level = _LEVEL.get((first_text(row, LEVEL_KEYS) or "INFO").upper(), "INFO")
        message = first_text(row, MESSAGE_KEYS) or line.strip()[:80]
        if level == "INFO":
            if message[:20] != prefix:
                close()
                prefix = message[:20]
            seen += 1
            if seen <= 3:
                out.append(f"[INFO] {message}")
        elif level in ("WARN", "ERROR"):
            close()
            out.append(f"[{level}] {message}")
            cause = first_text(row, ERROR_KEYS)
            if level == "ERROR" and cause is not None:
                out.append(f"  | error: {cause}")
    close()
    return "\n".join(out)


# --- NDJSON streams --------------------------------------------------------------------------


def is_ndjson(lines: list[str]) -> bool:
    head = [x for x in lines if x.strip()][:10]
    return sum(parse_object(x) is not None and x.strip().endswith("}") for x in head) >= 3


def _rows(text: str) -> list[dict[str, Any]]:
    return [r for r in map(parse_object, rust_lines(text)) if r is not None]


def _str(value: Any) -> str:
    return value if isinstance(value, str) else ""


def go_test_json(text: str) -> str:
    failed: dict[str, bool] = {}
    output: dict[str, list[str]] = {}
    elapsed: dict[str, float | None] = {}
    ended = bad = 0
    for r in _rows(text):
        action, package, whole = _str(r.get("Action")), _str(r.get("Package")), not isinstance(r.get("Test"), str)
        if action == "output" and isinstance(r.get("Output"), str):
            line = r["Output"].rstrip("\n")
            if line.strip() and not line.startswith(("--- PASS", "=== RUN", "=== CONT", "=== PAUSE")):
                own = output.setdefault(package, [])
                failed.setdefault(package, False)
                if len(own) < 100:
                    own.append(line)
        elif action in ("pass", "fail") and whole:
            ended += 1
            bad += action == "fail"
            failed[package] = action == "fail" or failed.get(package, False)
            elapsed[package] = r.get("Elapsed") if isinstance(r.get("Elapsed"), (int, float)) else None
            if action == "pass":
                output[package] = []
    out = []
    for package in sorted(failed, key=lambda p: p.encode()):
        if failed[package]:
            out += [f"FAIL {package}", *(f"  {x}" for x in output.get(package, []))]
        else:
            took = elapsed.get(package)
            out.append(f"ok {package}" + (f" ({took:.3f}s)" if took is not None else ""))
    if bad:
        out.append(f"FAIL: {bad}/{ended} packages failed")
    elif ended:
        out.append(f"ok {ended} package(s)")
    return "\n".join(out) if out else text


def jest_json(text: str) -> str:
    tests = [r for r in _rows(text) if isinstance(r.get("status"), str)]
    bad = [r for r in tests if r["status"] == "failed"]
    if not bad:
        return f"ok {len(tests)} tests" if tests else generic_ndjson(text)
    out = []
    for r in bad:
        above = r.get("ancestorTitles")
        parent = _str(above[-1]) if isinstance(above, list) and above else ""
        name = r["title"] if isinstance(r.get("title"), str) else "unknown"
        out.append(f"FAIL: {parent} > {name}" if parent else f"FAIL: {name}")
        messages = r.get("failureMessages")
        for m in (messages if isinstance(messages, list) else [])[:3]:
            out += [f"  {x}" for x in rust_lines(_str(m))[:5] if x.strip()]
    return "\n".join([*out, f"{len(bad)} failed, {len(tests) - len(bad)} passed"])


def cargo_json(text: str) -> str:
    out, warnings = [], 0
    for r in _rows(text):
        m = r.get("message")
        if r.get("reason") != "compiler-message" or not isinstance(m, dict):
            continue
        if m.get("level") == "warning":
            warnings += 1
        elif m.get("level") == "error":
            out.append(f"error: {_str(m.get('message'))}")
            spans = m.get("spans")
            for s in (spans if isinstance(spans, list) else [])[:2]:
                if _str(s.get("file_name")):
                    out.append(f"  --> {s['file_name']}:{s.get('line_start') or 0}")
    if warnings:
        out.append(f"[{warnings} warning(s) suppressed]")
    return "\n".join(out) if out else text


def generic_ndjson(text: str) -> str:
    """Distinct messages by level: errors, warnings, then ten others."""
    kinds: tuple[dict, dict, dict] = ({}, {}, {})
    for r in _rows(text):
        level = next((r[k] for k in ("level", "severity") if isinstance(r.get(k), str)), "info")
        message = next((r[k] for k in ("message", "msg", "error") if isinstance(r.get(k), str)), "")
        if message:
            kind = 0 if level in ("error", "fatal", "critical") else 1 if level in ("warn", "warning") else 2
            kinds[kind].setdefault(f"[{level}] {message}")
    out = [*kinds[0], *kinds[1], *list(kinds[2])[:10]]
    return "\n".join(out) if out else text


def compact_ndjson(text: str, hint: str = "") -> str:
    if not is_ndjson(rust_lines(text)):
        return text
    return {"go": go_test_json, "jest": jest_json, "vitest": jest_json, "cargo": cargo_json}.get(hint, generic_ndjson)(text)


# --- Stack traces ----------------------------------------------------------------------------

MAX_FRAMES = 5
_PY_FRAME = re.compile(r'^\s+File ".+", line \d+')
_PY_END = re.compile(r"^[A-Za-z][\w.]*(?:Error|Exception|Warning):")
_JS_FRAME = re.compile(r"^\s+at (?:.+ \(.+:\d+:\d+\)|/\S+:\d+:\d+)")
_JAVA_FRAME = re.compile(r"^\s+at [A-Za-z][\w.$]+\(")
_RUST_FRAME = re.compile(r"^\s+\d+:\s+\S")
_STARTS = (
    ("rust", re.compile(r"^thread '.+' panicked at")),
    ("python", re.compile(r"^Traceback \(most recent call last\):")),
    ("js", re.compile(r"^(?:\w+Error|Error): ")),
    ("java", re.compile(r"^(?:Exception in thread|[A-Za-z][\w.]+(?:Exception|Error)):")),
    ("go", re.compile(r"^goroutine \d+ \[")),
)
#: Frames of runtimes and libraries. Fixed values.
_LIBRARY = re.compile(
    r"node_modules/|^at internal/|^at Object\.<anonymous>|^(?:at )?(?:java|javax|sun|com\.sun|scala|kotlin|clojure|groovy)\."
    r"|/rustc/|/\.cargo/registry/|rust_begin_unwind|rust_panic|runtime/.*\.go|\.go.*runtime/|testing\.tRunner|site-packages/|/lib/python"
)


def is_library_frame(frame: str) -> bool:
    return _LIBRARY.search(frame.strip()) is not None


def _trace_kind(lines: list[str], i: int) -> str | None:
    for kind, start in _STARTS:
        if start.match(lines[i]) and (kind != "js" or (i + 1 < len(lines) and _JS_FRAME.match(lines[i + 1]))):
            return kind
    return None


def _trace(kind: str, lines: list[str], i: int) -> tuple[int, list[str], list[str], bool]:
    """Where the trace that begins before line i ends; its headers and frames; whether an empty line closes it."""
    heads, frames, deep = [], [], False
    while i < len(lines):
        x = lines[i]
        if kind == "rust":
            if x.startswith("stack backtrace:"):
                deep = True
            elif deep and _RUST_FRAME.match(x):
                frames.append(x)
            elif not (x.strip().startswith("note:") or (deep and not x.strip())):
                break
        elif kind == "python":
            if _PY_FRAME.match(x):
                frames.append(x)
                after = lines[i + 1] if i + 1 < len(lines) else None
                if after is not None and not (_PY_FRAME.match(after) or _PY_END.match(after) or after.startswith("Traceback")):
                    i += 1  # the frame's source line
            elif _PY_END.match(x):
                heads.append(x)
                i += 1
                while i < len(lines) and lines[i] and not (_STARTS[1][1].match(lines[i]) or _PY_FRAME.match(lines[i])):
                    heads.append(lines[i])
                    i += 1
                break
            else:
                return (i + 1, heads, frames, True) if x == "" else (i, heads, frames, False)
        elif kind == "js":
            if not _JS_FRAME.match(x):
                break
            frames.append(x)
        elif kind == "java":
            if _JAVA_FRAME.match(x):
                frames.append(x)
            elif x.startswith("Caused by:"):
                heads.append(x)
            elif not x.lstrip().startswith("..."):
                break
        elif x.startswith("\t"):
            frames.append(x)
        else:
            return (i + 1, heads, frames, True) if x == "" else (i, heads, frames, False)
        i += 1
    return i, heads, frames, False


def compact_traces(text: str) -> str:
    """Five frames of the user's own code per trace, the rest counted."""
    lines, out, i = rust_lines(text), [], 0
    while i < len(lines):
        kind = _trace_kind(lines, i)
        out.append(lines[i])
        i += 1
        if kind is None:
            continue
        i, heads, frames, closed = _trace(kind, lines, i)
        own = [f for f in frames if not is_library_frame(f)][:MAX_FRAMES]
        out += heads + own
        if len(frames) > len(own):
            out.append(f"  [... {len(frames) - len(own)} internal/stdlib frames omitted ...]")
        if closed:
            out.append("")
    result = "\n".join(out)
    return result + "\n" if result and text.endswith("\n") else result


# --- Near-duplicate lines --------------------------------------------------------------------


def collapse_similar(text: str, distance: int = 10, least: int = 50) -> str:
    """Each line absorbs later ones within a SimHash distance; critical lines stay. Shorter texts pass."""
    lines = rust_lines(text)
    if len(lines) < least:
        return text
    cache: dict[str, int] = {}
    hashes = [simhash64(x, cache) for x in lines]
    free = [not critical.search(x) for x in lines]
    gone, out = [False] * len(lines), []
    for i, line in enumerate(lines):
        if gone[i]:
            continue
        out.append(line)
        if not free[i]:
            continue
        near = [j for j in range(i + 1, len(lines)) if free[j] and not gone[j] and (hashes[i] ^ hashes[j]).bit_count() <= distance]
        for j in near:
            gone[j] = True
        if near:
            out.append(f"[{len(near)} similar lines omitted]")
    return "\n".join(out)


# --- Differences of two versions -------------------------------------------------------------

MAX_DIFF_LINES, MAX_DIFF_BYTES = 2000, 2000


def edits(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """Longest-common-subsequence edit script: (' ', '-' or '+', old line, new line); ties remove first."""
    m, n = len(old), len(new)
    # rows of lengths from the end; equal beginnings and ends need no table
    head = 0
    while head < m and head < n and old[head] == new[head]:
        head += 1
    width = n - head + 1
    table = [[0] * width for _ in range(m - head + 1)]
    for i in range(m - 1, head - 1, -1):
        row, below = table[i - head], table[i - head + 1]
        for j in range(n - 1, head - 1, -1):
            row[j - head] = below[j - head + 1] + 1 if old[i] == new[j] else max(below[j - head], row[j - head + 1])
    out = [(" ", k, k) for k in range(head)]
    i = j = head
    while i < m or j < n:
        if i < m and j < n and old[i] == new[j]:
            out.append((" ", i, j))
            i, j = i + 1, j + 1
        elif j >= n or (i < m and table[i - head + 1][j - head] >= table[i - head][j - head + 1]):
            out.append(("-", i, j))
            i += 1
        else:
            out.append(("+", i, j))
            j += 1
    return out


def unified_diff(name: str, old: str, new: str) -> tuple[str, str]:
    """(status, text): not_eligible, unchanged, too_large, or diff with its text."""
    a, b = rust_lines(old), rust_lines(new)
    if "\0" in old or "\0" in new or max(len(a), len(b)) > MAX_DIFF_LINES:
        return "not_eligible", ""
    if a == b:
        return "unchanged", ""
    script = edits(a, b)
    hunks: list[list[int]] = []
    for at in (k for k, e in enumerate(script) if e[0] != " "):
        lo, hi = max(at - 1, 0), min(at + 2, len(script))
        if hunks and lo <= hunks[-1][1]:
            hunks[-1][1] = hi
        else:
            hunks.append([lo, hi])
    body = []
    for lo, hi in hunks:
        part = script[lo:hi]
        olds, news = [e[1] + 1 for e in part if e[0] != "+"], [e[2] + 1 for e in part if e[0] != "-"]
        body.append(f"@@ -{olds[0] if olds else 1},{len(olds)} +{news[0] if news else 1},{len(news)} @@")
        body += [e[0] + (b[e[2]] if e[0] == "+" else a[e[1]]) for e in part]
    added, removed = (sum(x.startswith(c) for x in body) for c in "+-")
    text = f"[delta: {name.rstrip('/').rsplit('/', 1)[-1]} — +{added} / -{removed} lines]\n" + "\n".join(body) + "\n"
    return ("too_large", "") if len(text.encode()) > MAX_DIFF_BYTES else ("diff", text)


# --- Error signatures ------------------------------------------------------------------------

_RUST = re.compile(r"^(error|warning)\[([EW]\d+)\]:\s+(.+)$")
_RUST_AT = re.compile(r"-->\s+([^:]+):(\d+):\d+")
_TS = re.compile(r"^([^(]+\.tsx?)\((\d+),\d+\): (error|warning) (TS\d+):\s+(.+)$")
_PY_AT = re.compile(r'File "([^"]+)", line (\d+)')
_PY = re.compile(r"^([A-Za-z][A-Za-z0-9_]*(?:Error|Exception|Warning)):\s+(.+)$")
_GO = re.compile(r"^([^:]+\.go):(\d+):\d+:\s+(.{5,})$")
_ANY = re.compile(r"(?i)^(?:error|failed|fatal):\s+(.{10,})$")
_SUMMARY = re.compile(r"(?i)aborting due to|previous error|could not compile")


def error_signatures(text: str) -> list[dict[str, Any]]:
    """code, file, line_no, message, severity of each distinct error, first come first."""
    lines, found, i = rust_lines(text), {}, 0
    while i < len(lines):
        x, used, hit = lines[i], 1, None
        if m := _RUST.match(x):
            at = None
            if i + 1 < len(lines) and lines[i + 1].lstrip().startswith("-->"):
                at, used = _RUST_AT.search(lines[i + 1]), 2
            hit = (m[2], at and at[1], at and int(at[2]), m[3], "warning" if m[1] == "warning" else "error")
        elif m := _TS.match(x):
            hit = (m[4], m[1].strip(), int(m[2]), m[5], "warning" if m[3] == "warning" else "error")
        elif (m := _PY_AT.search(x)) and (end := next(filter(None, map(_PY.match, lines[i + 1 : i + 5])), None)):
            hit = (end[1], m[1], int(m[2]), end[2], "error")
        elif m := _GO.match(x):
            hit = (None, m[1], int(m[2]), m[3], "warning" if "warning" in m[3].lower() else "error")
        elif not _SUMMARY.search(x) and (m := _ANY.match(x.strip())):
            hit = (None, None, None, m[1].strip(), "error")
        if hit:
            key = f"{hit[0] or ''}|{hit[1] or ''}|{hit[3].strip().lower()}"
            found.setdefault(key, dict(zip(("code", "file", "line_no", "message", "severity"), hit, strict=True)) | {"key": key})
        i += used
    return list(found.values())


# --- Sentences, JSON shapes ------------------------------------------------------------------


def sentences(text: str) -> list[str]:
    """Ends at ``.``, ``!`` or ``?`` before white space or the end, and at every newline."""
    parts = re.split(r"(?<=[.!?])(?=\s)|\n", text)
    return [p.strip() for p in parts if p.strip()]


def json_shape(value: Any, depth: int = 0) -> Any:
    """Types in place of values: four levels, fifteen keys, the first element of arrays."""
    if depth >= 4:
        return "..."
    if isinstance(value, dict):
        out = {k: json_shape(v, depth + 1) for k, v in list(value.items())[:15]}
        return out | ({"...": f"+{len(value) - 15} keys"} if len(value) > 15 else {})
    if isinstance(value, list):
        return [] if not value else [json_shape(value[0], depth + 1)] + ([f"[{len(value)} items total]"] if len(value) > 1 else [])
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "int" if float(value).is_integer() else "float"
    return "string"


def json_schema(text: str) -> str:
    """Pretty shape of a JSON document; other texts stay, and so do those whose shape is not shorter."""
    try:
        shape = json.dumps(json_shape(json.loads(text)), indent=2, ensure_ascii=False)
    except ValueError:
        return text
    return shape if len(shape) < len(text) else text
