"""Queries of the command handlers: a log per user, made from events, through the subcommands of a family.

Events become lines by templates; users of even id draw from the calm ones only, so
that the paths for outputs without errors are taken too. The SQL makes the same logs
and says each filter again, over DuckDB lists of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsluice.operators.handlers import handled
from textsluice.plans.catalog import query
from textsluice.plans.tables import table

NONE = "[]::varchar[]"


# --- Logs ------------------------------------------------------------------------------------


def logs(spark: SparkSession, sf_dir: str, head: Sequence[str], lines: Sequence[str], calm: int) -> DataFrame:
    """user_id and text: ``head``, then a line per event of the user, in order of event_id."""
    kinds = F.when(F.col("user_id") % 2 == 0, calm).otherwise(len(lines))
    line = F.get(F.array(*map(F.lit, lines)), (F.col("event_id") % kinds).cast("int"))
    for mark, value in (("{e}", F.col("event_id")), ("{k}", F.expr("event_id div 7 % 5")), ("{u}", F.col("user_id"))):
        line = F.replace(line, F.lit(mark), value.cast("string"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"])
    first = F.array(*map(F.lit, head)) if head else F.array().cast("array<string>")
    return events.groupBy("user_id").agg(F.array_join(F.concat(first, body), "\n").alias("text"))


def family(name: str, lines: Sequence[str], calm: int, outputs: dict[str, str], head: Sequence[str] = (), columns: dict[str, str] | None = None) -> None:
    """Registers ``handler_<name>``: each log through each command; ``outputs`` has the list of lines that SQL expects,
    ``columns`` lists that it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = logs(spark, sf_dir, head, lines, calm).withColumn("command", F.explode(F.array(*map(F.lit, outputs))))
        return asked.select("user_id", "command", handled(F.col("command"), F.col("text")).alias("output"))

    made = f"[{', '.join(map(_q, lines))}][event_id % (case when user_id % 2 = 0 then {calm} else {len(lines)} end) + 1]"
    for mark, value in (("{e}", "event_id"), ("{k}", "event_id // 7 % 5"), ("{u}", "user_id")):
        made = f"replace({made}, '{mark}', ({value})::varchar)"
    first = f"[{', '.join(map(_q, head))}] || " if head else ""
    named = "".join(f", g{n} as (select *, {x} as {c} from g{n - 1})" for n, (c, x) in enumerate((columns or {}).items(), 1))
    each = " union all ".join(f"select user_id, T, {_q(c)} as command, array_to_string({x}, chr(10)) as output from g{len(columns or {})}" for c, x in outputs.items())
    run.__name__ = f"handler_{name}"
    query(
        f"""with w as (select user_id, {first}list(line order by event_id) as W from (select user_id, event_id, {made} as line from events) group by user_id
), g0 as (select user_id, array_to_string(W, chr(10)) as T, case when W[-1] = '' then W[:-2] else W end as L, list_filter(W, lambda x: x <> '') as N from w){named}
select user_id, command, case when regexp_matches(output, '\\S') then output else T end as output from ({each})"""
    )(run)


# --- SQL over lists of lines: L has all lines, N those that are not blank, T the text -------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _where(p: str, of: str = "L") -> str:
    return f"list_filter({of}, lambda x: regexp_matches(x, {_q(p)}))"


def _without(p: str, of: str = "L") -> str:
    return f"list_filter({of}, lambda x: not regexp_matches(x, {_q(p)}))"


def _count(p: str, of: str = "L") -> str:
    return f"len({_where(p, of)})"


def _first(x: str) -> str:
    return f"({x})[1:1]"


def _last(x: str) -> str:
    return f"({x})[-1:]"


def _cap(x: str, most: int, before: str = "[+", after: str = " more]") -> str:
    return f"(({x})[1:{most}] || case when len({x}) > {most} then [{_q(before)} || (len({x}) - {most}) || {_q(after)}] else {NONE} end)"


def _if(condition: str, x: str, y: str = NONE) -> str:
    return f"(case when {condition} then {x} else {y} end)"


def _or(*options: str) -> str:
    """The first list that is not empty."""
    out = options[-1]
    for x in reversed(options[:-1]):
        out = _if(f"len({x}) > 0", x, out)
    return out


def _map(x: str, body: str) -> str:
    return f"list_transform({x}, lambda x: {body})"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


def _blocks(start: str, most: int, stop: str = r"^\s*$", of: str = "L") -> str:
    """Lines that match ``start``, and up to ``most`` after each before one that matches ``stop``."""
    at = f"list_max(list_filter(range(greatest(1, i - {most}), i), lambda j: regexp_matches(({of})[j], {_q(start)})))"
    clear = f"len(list_filter(({of})[coalesce({at}, 0) + 1:i], lambda z: regexp_matches(z, {_q(stop)}))) = 0"
    return f"list_filter({of}, lambda x, i: regexp_matches(x, {_q(start)}) or ({at} is not null and {clear}))"


def _pairs(p: str, key: str, value: str, of: str = "L") -> str:
    """Structs (k, v) of matching lines; \\1 to \\3 stand for the pattern's groups."""
    groups = [f"regexp_extract(x, {_q(p)}, {n})" for n in (1, 2, 3)]
    for n, g in enumerate(groups, 1):
        key, value = key.replace(f"\\{n}", g), value.replace(f"\\{n}", g)
    return _map(_where(p, of), f"{{'k': {key}, 'v': {value}}}")


def _groups(pairs: str, each: int, head: str) -> str:
    """Keys in byte order, ``head`` (of key and n) and up to ``each`` values of each."""
    own = f"list_filter({pairs}, lambda p: p.k = key)"
    body = f"list_transform(({own})[1:{each}], lambda p: '  ' || p.v)"
    more = f"case when len({own}) > {each} then ['  ... and ' || (len({own}) - {each}) || ' more'] else {NONE} end"
    keys = f"list_sort(list_distinct(list_transform({pairs}, lambda p: p.k)))"
    return f"flatten(list_transform({keys}, lambda key: [{head.format(k='key', n=f'len({own})')}] || {body} || {more}))"


def _lint(issue: str, path: str, most: int) -> str:
    """Paths that have an issue right after them, and the first ``most`` issues."""
    is_issue, is_path = (lambda v: f"regexp_matches({v}, {_q(issue)})"), (lambda v: f"regexp_matches({v}, {_q(path)})")
    rank, total = f"len({_where(issue, 'L[1:i]')})", _count(issue)
    after = f"list_min(list_filter(range(i + 1, len(L) + 1), lambda j: {is_issue('L[j]')} or {is_path('L[j]')}))"
    shown = f"({is_issue('y')} and {rank} <= {most}) or ({is_path('y')} and coalesce({is_issue(f'L[{after}]')}, false) and {rank} < {most})"
    text = _map(f"list_filter(L, lambda y, i: {shown})", f"case when {is_issue('x')} then '  ' || trim(x) else trim(x) end")
    more = f"['[+' || ({total} - {most}) || ' more issues]']"
    return f"({text} || {_if(f'{total} > {most}', more)})"


# --- Version control -------------------------------------------------------------------------

_CHANGES = f"({_map(_where('^[MADRCU][ MADRCU?!] .'), '''\'  S \' || substring(x, 4)''')} || {_map(_where('^[ MADRCU?!][MADRCU] .'), '''\'  M \' || substring(x, 4)''')})"
_BAD = "(?i)error|fatal|rejected|conflict|denied"
_NEAR = f"list_filter(range(1, len(L) + 1), lambda j: {_count(_BAD, 'L[greatest(1, j - 2):j + 2]')} > 0)"
_AROUND = f"flatten(list_transform({_NEAR}, lambda j, i: case when i > 1 and ({_NEAR})[i - 1] < j - 1 then ['...', L[j]] else [L[j]] end))"
_CLONED, _SWITCHED = r"Cloning into '([^']+)'", r"(?:Switched to(?: a new)? branch|Already on) '([^']+)'"

family(
    "git",
    (
        "M  src/a{e}.rs", " M src/b{e}.rs", "?? new{e}.txt", "## main...origin/main", "abc{e} Repair the parser of case {e}", "   1111..2222  main -> main",
        " 3 files changed, {e} insertions(+)", "[main {e}] message", "Signed-off-by: a person", "Receiving objects: 10% ({e}/100)", "Fast-forward",
        "A  src/c{e}.rs", "Cloning into 'dir{u}'...", "Switched to branch 'b{e}'", "AM src/d{e}.rs",
        "error: failed to push some refs {e}", "CONFLICT (content): Merge conflict in f{e}", "remote: counting",
    ),
    15,
    {
        "git status": f"""({_where('^##|^On branch')} || [{_count('^[MADRCU][ MADRCU?!] .')} || ' staged, ' || {_count('^[ MADRCU?!][MADRCU] .')} || ' modified, ' || {_count('^[?][?] .')} || ' untracked']
            || {_cap(_CHANGES, 15, '  [+')} || {_cap(_map(_where('^[?][?] .'), "'  ? ' || substring(x, 4)"), 10, '  [+', ' more untracked]')})""",
        "git log": f"(({_map(_without(r'^\s*(?:Co-authored-by|Signed-off-by|Reviewed-by|Change-Id):'), 'x[:100]')})[1:50] || {_if('len(L) > 50', '''['[+' || (len(L) - 50) || ' more commits]']''')})",
        "git push": _if(f"{_count(_BAD)} > 0", _AROUND, _map(_or(_first(_where(" -> ")), _first(_where(r"\d+ files? changed")), _last("N")), "'ok ' || trim(x)")),
        "git commit": f"({_first(_where(r'^\['))} || {_last(_where('files? changed|insertions?|deletions?'))})",
        "git branch": _cap("L", 30),
        "git merge": _or(_where("CONFLICT|Automatic merge failed"), _where("Fast-forward|Merge made|files? changed|Updating")),
        "git rebase": _or(_where("CONFLICT|could not apply"), _first(_where("Successfully rebased")), _last("N")),
        "git clone": _or(
            _where("(?i)error|fatal", _without("^(?:remote:|Receiving|Resolving|Unpacking|Updating files)")),
            _if(f"regexp_matches(T, {_q(_CLONED)})", f"['ok — cloned ''' || regexp_extract(T, {_q(_CLONED)}, 1) || '''']"),
            _without("^(?:remote:|Receiving|Resolving|Unpacking|Updating files)", "N"),
        ),
        "git checkout": _if(
            "regexp_matches(T, '(?i)error|fatal|conflict')", "L", _or(_if(f"regexp_matches(T, {_q(_SWITCHED)})", f"['ok — ' || regexp_extract(T, {_q(_SWITCHED)}, 1)]"), _last("N"))
        ),
    },
)

_HUNK = r"^@@|^\d+(?:,\d+)?[acd]\d+"
_PLAIN = r"^[^+\-<>@]"
_SINCE = f"L[list_max(list_filter(range(1, i + 1), lambda j: regexp_matches(L[j], {_q(_HUNK)}))) + 1:i]"

family(
    "diff",
    ("@@ -{k},2 +{k},2 @@", "+added {e}", "-gone {e}", " same {e}", " like {e}", " equal {e}", " kept {e}"),
    7,
    {
        "diff": f"""(list_filter(L, lambda x, i: {_count(_HUNK, 'L[1:i]')} <= 5 and (not regexp_matches(x, {_q(_PLAIN)}) or {_count(_HUNK, 'L[1:i]')} = 0 or {_count(_PLAIN, _SINCE)} <= 2))
            || {_if(f"{_count(_HUNK)} > 5", f"['[+' || ({_count(_HUNK)} - 5) || ' more hunks]']")})"""
    },
)

_CELLS = "string_split(x, chr(9))"

family(
    "gh",
    ("{e}\tTitle of change {e}\tuser{k}\tbranch{k}\tOPEN\t2024-01-0{k}", "check{e}\tpass\t10s\thttps://ci/{e}", "completed\tsuccess\trun {e}\tmain\tpush", "plain words {e}", "lint{e}\tfail\t5s\thttps://ci/{e}"),
    4,
    {
        "gh pr list": _map(_where(r"\t.*\t.*\t"), f"'#' || {_CELLS}[1] || ' ' || {_CELLS}[2][:60] || ' [' || {_CELLS}[-2] || '] @' || {_CELLS}[3]"),
        "gh issue list": _map(_where(r"\t.*\t.*\t"), f"'#' || {_CELLS}[1] || ' ' || {_CELLS}[3][:60] || ' [' || {_CELLS}[2] || ']'"),
        "gh pr checks": f"([{_count(r'(?i)\bpass')} || ' passed, ' || {_count(r'(?i)\bfail')} || ' failed'] || {_map(_where(r'(?i)\bfail'), f'{_CELLS}[1]')})",
        "gh run list": _where("(?i)completed|failure|success|in_progress|queued|✓|X "),
        "gh repo clone": _last("N"),
    },
)

# --- Rust and Go -----------------------------------------------------------------------------

_AT = "coalesce(nullif(list_position(list_transform(L, lambda x: trim(x)), 'failures:'), 0), len(L))"

family(
    "cargo",
    (
        "test mod::case{e} ... ok", "running {k} tests", "warning: unused variable `x{k}`", "   Compiling a v{e}", "test result: ok. {e} passed; 0 failed",
        "    Summary [ {e}s] {k} tests run", "  = help: consider {k}", "warning: `a` (bin) generated {k} warnings", "",
        "test mod::case{e} ... FAILED", "failures:", "error[E0{k}]: mismatched types", "    FAIL [ 0.{k}s] a b{e}", "detail {e}",
    ),
    9,
    {
        "cargo test": _if(
            f"{_count('^test .* FAILED$')} = 0", _last(_where("^test result:")),
            f"({_where('^test .* FAILED$')} || ({_where(r'\S', f'L[{_AT} + 1:]')})[1:20] || {_last(_where('^test result:'))})",
        ),
        "cargo nextest": f"({_where(r'^\s*FAIL')} || {_last(_where(r'^\s*Summary'))})",
        "clippy": f"({_distinct(_where('^error'))} || {_cap(_distinct(_where('^warning')), 5)} || {_first(_where(r'^\s*=?\s*help:'))} || {_last(_where(r'generated \d+ warning|could not compile'))})",
    },
)

_JSON = "lambda x: json_valid(x) and json_extract_string(x, '$.message.level') = '{}'"
_ENTRY = """json_extract_string(x, '$.message.message') || ' (' || json_extract_string(x, '$.message.spans[0].file_name') || ':' || json_extract_string(x, '$.message.spans[0].line_start') || ')'"""
_RULES = f"list_transform(list_filter(L, {_JSON.format('warning')}), lambda x: {{'k': coalesce(json_extract_string(x, '$.message.code.code'), 'other'), 'v': {_ENTRY}}})"

family(
    "cargo_json",
    (
        '{"reason":"compiler-message","message":{"level":"warning","code":{"code":"rule_{k}"},"message":"unused {e}","spans":[{"file_name":"a{k}.rs","line_start":{e}}]}}',
        '{"reason":"compiler-artifact","target":{"name":"a{e}"}}',
        '{"reason":"compiler-message","message":{"level":"warning","code":null,"message":"odd {e}","spans":[{"file_name":"b.rs","line_start":{e}}]}}',
        '{"reason":"compiler-message","message":{"level":"error","code":{"code":"E0{k}"},"message":"bad {e}","spans":[{"file_name":"c.rs","line_start":{e}}]}}',
    ),
    3,
    {
        f"cargo {sub}": f"""({_cap(f"list_transform(list_filter(L, {_JSON.format('error')}), lambda x: 'error: ' || {_ENTRY})", 15)}
            || {_if(f"len({_RULES}) >= 3", _groups(_RULES, 3, "'[' || {k} || ' ×' || {n} || ']'"), f"list_transform({_RULES}, lambda p: 'warning: ' || p.v)")}
            || {_if(f"len({_RULES}) > 0", f"['[' || len({_RULES}) || ' warnings]']")} || [case when L[1] like '%true%' then 'Build OK' else 'Build FAILED' end])"""
        for sub in ("build", "check")
    },
    head=('{"reason":"build-finished","success":true}',),
)

family(
    "go",
    (
        "ok  \tpkg/{k}\t0.0{e}s", "--- PASS: TestA{e} (0.00s)", "go: downloading x v{e}", "go: added y v{e}", "=== RUN   TestA{e}",
        "--- FAIL: TestB{e} (0.01s)", "    b_test.go:{k}: got {e}", "a.go:{e}:1: undefined: z", "FAIL\tpkg/{k}", "panic: boom {e}", "    more {e}",
    ),
    5,
    {
        "go build": _where(r"\.go:\d+|^#|(?i:error)|cannot|undefined"),
        "go mod": _or(_cap(_where("(?i)error|upgraded|downgraded|added|removed|require"), 20), "['[go mod complete]']"),
        "go test": f"""({_blocks(r'^\s*--- FAIL', 10, r'^(?:---|===|ok\s|FAIL|PASS)')} || {_where(r'^(?:ok|FAIL)\s+\S|^panic:')}
            || {_if(f"{_count(r'^\s*--- PASS')} > 0", f"['[' || {_count(r'^\s*--- PASS')} || ' tests passed]']")})""",
    },
)

# --- Linters ---------------------------------------------------------------------------------

_OWN, _LEFT = "list_filter(Issues, lambda p: p.k = key)", "(40 - least(40, len(list_filter(Issues, lambda p: list_position(Files, p.k) < i))))"

family(
    "golangci",
    ("a{k}.go:{e}:2: unused thing {e} (unused)", "b{k}.go:{e}: shadowed {e} (govet)", "level=warning msg={e}", "level=error msg={e}"),
    3,
    {
        "golangci-lint run": f"""(flatten(list_transform(Files, lambda key, i: [key || ' [' || len({_OWN}) || ']'] || list_transform(({_OWN})[1:{_LEFT}], lambda p: '  ' || p.v)
            || case when len({_OWN}) > {_LEFT} then ['  ... and ' || (len({_OWN}) - {_LEFT}) || ' more'] else {NONE} end))
            || {_where('level=error')} || ({_where('level=warning')})[1:3] || ['[' || len(Issues) || ' issues]'])"""
    },
    columns={"Issues": _pairs(r"^([^:\s]+):(\d+)(?::\d+)?: (.*)$", r"\1", r"\2 || ' ' || \3", "N"), "Paths": "list_transform(Issues, lambda p: p.k)", "Files": _distinct("Paths")},
)

family(
    "mypy",
    ("m{k}.py:{e}: error: Bad type {e}  [arg-type]", "m{k}.py:{e}: note: see this", "n{k}.py:{e}:4: error: Other {e}", "Found 1{k} errors in 2 files"),
    4,
    {"mypy .": f"({_groups(_pairs(r'^([^:]+):(\d+)(?::\d+)?: (.*)$', r'\1', r"\2 || ': ' || \3", _without(': note: ')), 10, "{k} || ' [' || {n} || ']'")} || {_without(r'^[^:]+:\d+', _without(': note: '))})"},
)

family(
    "ruff",
    ("src/a{k}.py:{e}:1: F40{k} unused {e}", "src/b.py:{e}:1: E{k} long line {e}", "Found 1{k} errors.", "1{k} files left unchanged"),
    4,
    {
        "ruff check": f"({_groups(_pairs(r'^(\S+:\d+:\d+):? ([A-Z]+\d+) (.*)$', r'\2', r"\1 || ' ' || \3"), 3, "'[' || {k} || ' ×' || {n} || ']'")} || {_last(_where('^Found'))})",
        "ruff format": _last(_where("reformatted|left unchanged")),
    },
)

_PATH = r"^(?:/|\.{0,2}/|[A-Za-z]:\\|\w)\S*\.\w+\s*$"

family(
    "eslint",
    ("/src/f{e}.js", "  {e}:1  error  Bad thing {e}  rule-{k}", "  {e}:7  warning  Odd thing  rule-{k}", "", "1{k} problems (3 errors, 2 warnings)"),
    5,
    {
        "eslint .": f"({_lint(r'^\s+\d+:\d+\s+(?:error|warning)', _PATH, 30)} || {_last(_where(r'\d+ problems?'))})",
        "stylelint .": f"({_lint(r'^\s+\d+:\d+\s+[✖×⚠]?', _PATH, 40)} || {_last(_where(r'\d+ (?:problems?|errors?)'))})",
    },
)

family(
    "prettier",
    ("Checking formatting...", "[warn] src/a{e}.js", "[warn] src/b{e}.css", "src/c{e}.js {k}ms", "[error] src/d{e}.js: SyntaxError: {k}"),
    4,
    {
        "prettier --check .": _or(
            _where(r"\[error\]|SyntaxError"),
            f"""({_cap(_map(_where(r'^\[warn\] \S+\.\w+$'), "x[8:]"), 10)} || ['[' || {_count(r'^\[warn\] \S+\.\w+$')} || ' files need formatting]'])""",
        ),
        "rubocop": _where(": [CWEF]: |inspected"),
    },
)

family(
    "rubocop",
    ("a{k}.rb:{e}:1: C: Style/A: bad {e}", "Inspecting {k} files", "a{k}.rb:{e}:1: W: Lint/B: odd {e}", "1{k} files inspected, {k} offenses detected"),
    4,
    {"rubocop": _where(": [CWEF]: |inspected")},
)

_TSC = r"^(.+?)\((\d+),\d+\): (?:error|warning) (TS\d+): (.*)$"
_part = lambda x, n: f"regexp_extract({x}, {_q(_TSC)}, {n})"
_same = lambda j, n: f"({j} > 0 and regexp_matches(L[{j}], {_q(_TSC)}) and {_part(f'L[{j}]', n)} = {_part(f'L[{j} + 1]', n)})"
_new = lambda i: f"(regexp_matches(L[{i}], {_q(_TSC)}) and not ({_same(f'({i} - 1)', 1)} and {_same(f'({i} - 1)', 3)}))"
_END = f"coalesce(list_min(list_filter(range(i + 1, len(L) + 1), lambda j: not regexp_matches(L[j], {_q(_TSC)}) or {_new('j')})), len(L) + 1)"

family(
    "tsc",
    ("src/a.ts({e},1): error TS2322: Type {e} is wrong", "src/a.ts({e},9): error TS2322: Type {e} is odd", "src/b.ts({e},1): error TS7006: Implicit {e}", "Found 1{k} errors.", "src/b.ts({e},2): warning TS7006: Any {e}"),
    5,
    {
        "tsc": f"""flatten(list_transform(L, lambda x, i: case when {_new('i')} then case when {_same('(i - 1)', 1)} then {NONE} else [{_part('x', 1)}] end
            || ['  ' || {_part('x', 2)} || ' ' || {_part('x', 3)} || ' ' || {_part('x', 4)} || case when {_END} - i > 1 then ' (×' || ({_END} - i) || ')' else '' end]
            when starts_with(x, 'Found ') then [x] else {NONE} end))"""
    },
)

# --- Test runners ----------------------------------------------------------------------------

_runner = lambda names, start, most, summary: f"({_where(names)} || {_blocks(start, most)} || {_where(summary)})"

family(
    "tests",
    (
        "PASS src/a{e}.test.js", "Tests:       {k} failed, 3 passed", "Time:        {k} s", "====== {k} passed in 1s ======", "1{k} examples, {k} failures", "", "note {e}", "12 runs, {k} failures",
        "FAIL src/b{e}.test.js", "  ● suite › case {e}", "    expected {e}", "FAILED tests/a.py::t{e}", "____ test_{e} ____", " × case {e}", "  {k}) Failure: {e}", "    detail {e}",
    ),
    8,
    {
        "jest": _runner(r"^\s*FAIL", r"^\s*●", 15, "^(?:Tests|Test Suites|Snapshots|Time):"),
        "vitest": _runner(r"^\s*FAIL", r"^\s*[×✗]", 5, r"^\s*Tests? "),
        "pytest": _runner("^(?:FAILED|ERROR) ", "^_{4,}", 10, "^=+ .*(?:passed|failed|error).* =+$"),
        "rspec": f"({_blocks(r'^\s+\d+\) ', 10, r'^\s+\d+\) |^Finished')} || {_where(r'^\d+ examples?,')})",
        "rake": f"({_blocks(r'^\s*\d+\) (?:Failure|Error)', 12)} || {_where(r'^\d+ runs|rake aborted|^Tasks: TOP')})",
        "ember test": f"({_blocks('^not ok', 12, '^(?:ok|not ok)')} || {_where('^# (?:tests|pass|fail|skip)')})",
        "npm test": f"({_where(r'^\s*(?:FAIL|✕|✗|×)')} || {_blocks(r'^\s*●', 30)} || {_last(_where(r'^Tests?:|passing|failing'))})",
    },
)

_NOISE = r"^\[INFO\]\s*(?:$|-+|Download|Scanning|Building|Copying|Using|Changes detected|Compiling|---)|^Download(?:ing|ed)"
_GRADLE = f"({_where('^> Task .* FAILED|^[ew]: ')} || {_blocks('FAILED$|What went wrong', 10)})"

family(
    "jvm",
    (
        "[INFO] Building a {e}", "[INFO] Downloading from x: {e}", "[WARNING] odd {k}", "Tests run: {k}, Failures: 0", "[INFO] BUILD SUCCESS", "> Task :a{e} UP-TO-DATE", "BUILD SUCCESSFUL in {k}s", "", "w: file{e}.kt: odd",
        "[ERROR] bad {e}", "test{e} <<< FAILURE!", "  at a.b.C{e}", "> Task :b{e} FAILED", "* What went wrong:", "e: file{e}.kt: wrong",
    ),
    9,
    {
        "mvn install": _distinct("Kept"),
        "gradle build": f"""({_distinct('Failed')} || {_if(f"{_count('UP-TO-DATE|NO-SOURCE|FROM-CACHE')} > 0", f"['[' || {_count('UP-TO-DATE|NO-SOURCE|FROM-CACHE')} || ' tasks up to date]']")} || {_where('^BUILD ')})""",
    },
    columns={
        "Quiet": _without(_NOISE), "Failed": _GRADLE,
        "Kept": f"({_where(r'^\[ERROR\]|^\[WARNING\]|Tests run:|FAIL|Reactor Summary|SUCCESS|BUILD', 'Quiet')} || {_blocks('<<< (?:FAILURE|ERROR)', 15, of='Quiet')})",
    },
)

# --- Packages --------------------------------------------------------------------------------

_BOILER = _without(r"^(?:> |npm (?:notice|warn)|yarn run|\$ |Done in)", "N")
_KEYS = _where("(?i)error|warn|fail|success|built|compiled|complete|listening|ready", _BOILER)
_number = lambda p: f"coalesce(nullif(regexp_extract(T, {_q(p)}, 1), ''), '0')"
_KEPT = _without(r"^(?:Using (?:Python|CPython)|Creating virtual|Resolved \d|Audited \d)", "N")
_MARKED = _map(_KEPT, r"case when regexp_matches(x, '^\s*(?:Downloading|Downloaded|Prepared|Building|Built)') then '  [downloads omitted]' else x end")

family(
    "packages",
    (
        "added {e} packages in 2s", "{k} vulnerabilities", "> app@1.0 build", "Packages: +{e}", "Progress: resolved {e}, done", "warn deprecated x{k}", "ready in {k} ms", "ready now",
        "Successfully installed a-{e} b-{k} c-1", "Downloading a{e}.whl", "Prepared {k} packages", "Resolved {k} packages", " + a=={e}", "", "Collecting a{e}", "built {e}",
        "npm ERR! code {e}", "error bad {e}", "ERR_PNPM {e}",
    ),
    16,
    {
        "npm install": _or(_where("npm (?:ERR!|error)|(?i:error )", "N"), f"(['[' || {_number(r'added (\d+) packages?')} || ' packages installed]'] || {_last(_where('vulnerabilit', 'N'))})"),
        "npm run build": _if(f"len({_BOILER}) <= 30", _BOILER, f"(list_filter({_KEYS}, lambda y, i: i = 1 or ({_KEYS})[i - 1] <> y) || ['[' || len({_BOILER}) || ' lines]'] || ({_BOILER})[-5:])"),
        "pnpm install": _or(_where("ERR_PNPM|(?i:error)", "N"), f"({_first(_where('^Packages:', 'N'))} || {_last(_where('^Progress:', 'N'))} || {_cap(_where('(?i)warn', 'N'), 5)})"),
        "pnpm run build": _if("len(N) <= 20", "N", f"({_where('(?i)error|warn|fail|built|done', 'N')} || ['[' || len(N) || ' lines]'] || N[-5:])"),
        "pip install x": f"({_where('(?i)error|warning', 'N')} || {_if(f'''{_count('Successfully installed .')} > 0''', "['[3 packages installed]']")})",
        "pip show x": _last("N"),
        "uv sync": f"list_filter({_MARKED}, lambda y, i: i = 1 or y <> '  [downloads omitted]' or ({_MARKED})[i - 1] <> y)",
    },
)

family(
    "brew",
    ("==> Downloading https://x/{e}", "==> Pouring a--{e}.bottle.tar.gz", "==> Caveats", "note {e}", "Uninstalling /opt/a{e}... ({k} files)", "🍺  /opt/a/{e}: {k} files", "Error: bad {e}"),
    6,
    {
        "brew install a": f"({_where('^(?:==> (?:Installing|Upgrading|Pouring|Summary)|🍺|Error|Warning)')} || {_blocks('^==> Caveats', 15, '^==>')})",
        "brew uninstall a": _where("(?i)uninstalling|error"),
        "brew update": _blocks("^==> ", 30, "^==>"),
        "brew list": _cap("N", 40),
    },
)

# --- Build tools -----------------------------------------------------------------------------

_COMPILER = r"^\s*(?:(?:g?cc|g\+\+|c\+\+|clang(?:\+\+)?|ar|ld)(?:\s|$)|\[\d+/\d+\]\s|(?:CC|CXX|LD|AR)\s)"

family(
    "make",
    (
        "gcc -c a{e}.c", "g++ -c b{e}.cc", "[{k}/9] Building c{e}", "  CC d{e}.o", "a.c:{e}: warning: unused", "x.h:{k}: note: see", "echo {e}", "[ 1{k}%] Built target t{e}", "-- Build files written to: /b{e}",
        "make: *** [all] Error {k}", "CMake Error at {e}",
    ),
    9,
    {
        "make": _if(
            rf"{_count(r'(?i)\berror\b|\*\*\*', 'N')} > 0", "N",
            f"({_where('(?i)warning|note:', 'N')} || ({_where(_COMPILER, 'N')})[-5:] || ['[make: complete — ' || {_count(_COMPILER, 'N')} || ' file(s) compiled]'])",
        ),
        "cmake .": f"({_where(r'(?i)\berror\b|warning:')} || ['[' || {_count('Built target')} || ' targets built]'])",
    },
)

_ACTIONS, _TOOK = r"(\d+) (?:total )?actions?", r"Elapsed time: ([\d.]+s)"

family(
    "bazel",
    ("INFO: Analyzed target //a:{e}", "INFO: {e} total actions", "Elapsed time: {k}.5s", "Target //a:b{e} up-to-date:", "  bin/{e}", "//a:t{e}  PASSED in 1s", "", "ERROR: bad {e}", "//a:u{e}  FAILED in 2s", "  /x/{e}/test.log"),
    7,
    {
        "bazel build //...": _if(
            rf"{_count(r'^ERROR|\berror:')} = 0",
            f"['[' || {_number(_ACTIONS)} || ' actions, build OK (' || coalesce(nullif(regexp_extract(T, {_q(_TOOK)}, 1), ''), '?') || ')]']",
            rf"({_where(r'^ERROR|\berror:')} || {_blocks('^Target //', 3)} || {_where('Elapsed time|Build completed|FAILED:')})",
        ),
        "bazel test //...": rf"({_where(r'\bFAILED\b|\bTIMEOUT\b')} || {_where(r'test\.log')} || ['[' || {_count(r'\bPASSED\b')} || ' passed, ' || {_count(r'\bFAILED\b|\bTIMEOUT\b')} || ' failed]'])",
        "bazel query //...": _cap("N", 30),
    },
)

_CODE = r"\bwarning ([A-Z]+\d+)"
_CODES = _map(_where(_CODE), f"regexp_extract(x, {_q(_CODE)}, 1)")
_RANKED = f"list_sort(list_transform(list_distinct({_CODES}), lambda y: {{'n': -len(list_filter({_CODES}, lambda z: z = y)), 'c': y}}))"

family(
    "dotnet_swift",
    (
        "a.cs({e},1): warning CS0{k}: odd", "  Restored /a{e}.csproj", "Build succeeded.", "    {k} Warning(s)", "Compiling a{e}.swift", "Executed 1{k} tests, with 0 failures", "Building for debugging",
        "a.cs({e},2): error CS1{k}: bad", "/b{k}.swift:{e}:1: error: wrong", "Test case {e} failed",
    ),
    7,
    {
        "dotnet build": f"""({_distinct(_where(r'\berror [A-Z]+\d+'))} || list_transform({_RANKED}, lambda p: '[' || p.c || ' ×' || -p.n || ']') || {_where(r'Build (?:succeeded|FAILED)|\d+ (?:Warning|Error)\(s\)')})""",
        "dotnet restore": _or(_where(r"(?i)\berror\b|\bfatal\b"), f"['[' || {_count('Restored ')} || ' packages restored]']"),
        "swift build": _or(_cap(_where(r"\.swift:\d+.*(?:error|warning)"), 20), _last(_where("Compiling|Build complete|Linking"))),
        "swift test": f"({_where('error:|failed')} || {_last(_where(r'Executed \d+ tests'))})",
        "swift package resolve": _without("^(?:Fetching|Computing|Creating|Updating|Working copy)", "N"),
    },
)

_ASSETS = _where(r"\bkB\b|\bKiB\b", "N")

family(
    "web_build",
    (
        "vite v5.{k} building", "{e} modules transformed.", "dist/a{e}.js  {k}.5 kB", "dist/b{e}.css  1.{k} KiB", "built in {k}s", " ✓ Compiled successfully", "├ /page{e}", "warning: large chunk {k}", "asset main{e}.js {k} KiB", "", "webpack 5.{k} compiled in 3 ms", "  Local: http://localhost:{e}",
        "error during build {e}", "ERROR in ./a{e}.js", "Module not found {e}", "WARNING in ./b{e}.js",
    ),
    12,
    {
        "vite build": f"""({_first(_where('^vite', 'N'))} || {_where('modules transformed', 'N')} || {_blocks('(?i)^error', 8, of='N')} || ({_where(r'(?i)\bwarning\b', 'N')})[1:5]
            || {_if(f"len({_ASSETS}) <= 15", _ASSETS, f"(({_ASSETS})[1:5] || ['[... ' || (len({_ASSETS}) - 7) || ' assets ...]'] || ({_ASSETS})[-2:])")} || {_where('built in', 'N')})""",
        "next build": _or(_where(r"(?i)\berror\b|failed", "N"), f"""({_where(r'^\s*✓', 'N')} || {_if(rf"{_count(r'^[├└┌]\s', 'N')} > 0", rf"['[' || {_count(r'^[├└┌]\s', 'N')} || ' pages]']")} || ({_where(r'(?i)\bwarning\b', 'N')})[1:3])"""),
        "next dev": _where("(?i)ready|error|warn|compiled|local:", "N"),
        "next lint": rf"""({_where(r'(?i)\berror\b|failed', 'N')} || {_if(rf"{_count(r'(?i)\bwarning\b', 'N')} > 0", rf"['[' || least(10, {_count(r'(?i)\bwarning\b', 'N')}) || ' warnings]']")})""",
        "webpack": f"({_where('^asset ')} || {_blocks('^ERROR in', 10)} || ({_blocks('^WARNING in', 5)})[1:5] || {_last(_where('^webpack .*compiled'))})",
        "ember build": rf"({_cap(_where(r'(?i)\berror\b|\bfatal\b'), 40)} || {_last('N')})",
        "ember serve": _first(_where("https?://")),
    },
)

_SCOPE, _SCOPED_ERROR = r"^(\S+:\S+?): (.*)$", r"^(\S+:\S+?): .*(?i:\berror\b|\bfatal\b)"

family(
    "turbo",
    ("web:build: cache hit, replaying {e}", "api:build: cache miss, executing {e}", "web:build: done {e}", "Tasks:    {k} successful", "Cached:    {k} cached", "• Running build in {k} packages", "api:build: error TS{e}"),
    6,
    {
        "turbo run build": rf"""flatten(list_transform(L, lambda x, i: case when regexp_matches(x, {_q(_SCOPE)}) and contains(x, 'cache hit') then [regexp_extract(x, {_q(_SCOPE)}, 1) || ' cache hit']
            when regexp_matches(x, {_q(_SCOPE)}) and contains(x, 'cache miss') then [regexp_extract(x, {_q(_SCOPE)}, 1) || ' cache miss']
            when regexp_matches(x, {_q(_SCOPED_ERROR)}) and len(list_filter(L[1:i], lambda y: regexp_matches(y, {_q(_SCOPED_ERROR)}) and regexp_extract(y, {_q(_SCOPE)}, 1) = regexp_extract(x, {_q(_SCOPE)}, 1))) <= 8 then [x]
            when regexp_matches(x, '^\s*(?:Tasks|Cached|Time|Failed):|^• ') then [trim(x)] else {NONE} end))"""
    },
)

family(
    "prisma",
    ("✔ Generated client {e}", "warning: old {k}", "└─ 2024010100000{k}_init{e}", "Database is in sync {e}", "Running seed {e}", "http://localhost:{e}", "Error: P100{k} bad {e}"),
    6,
    {
        "prisma generate": _or(_where(r"(?i)error|P\d{4}", "N"), rf"({_where('✔', 'N')} || ({_where(r'(?i)\bwarning\b', 'N')})[1:3])"),
        "prisma migrate dev": _or(_where(r"(?i)error|P\d{4}", "N"), rf"({_cap(_where(r'^\s*[└├]─ |\d{14}_', 'N'), 5)} || {_last(_where('(?i)applied|in sync|success|created', 'N'))})"),
        "prisma db push": _or(_where(r"(?i)error|P\d{4}", "N"), _where("(?i)sync|push|seed|🚀|🌱", "N")),
        "prisma studio": _or(_where(r"(?i)error|P\d{4}", "N"), _first(_where("https?://", "N"))),
        "prisma validate": _or(_first(_where(r"(?i)error|P\d{4}", "N")), "['[schema valid]']"),
        "prisma format": _or(_where(r"(?i)error|P\d{4}", "N"), "['[' || len(N) || ' lines formatted]']"),
    },
)

# --- Services --------------------------------------------------------------------------------

_COLUMNS = r"string_split_regex(trim(x), '\s{2,}')"
_STATUS = f"coalesce((list_filter({_COLUMNS}, lambda y: regexp_matches(y, '^(?:Up|Exited|Created|Restarting|Paused|STATUS)')))[1], {_COLUMNS}[-2])"
_TOKENS = r"string_split_regex(trim(x), '\s+')"
_IMAGES = f"list_filter(L, lambda x: len({_TOKENS}) >= 7 and {_TOKENS}[1] <> 'REPOSITORY')"
_SIZE = f"coalesce(try_cast(regexp_extract({_TOKENS}[-1], '^([0-9.]+)MB$', 1) as double), 0)"

family(
    "docker",
    (
        "{e}abc   img{k}:1   \"run\"   2 days ago   Up 2 days   80/tcp   name{e}", "{e}def   img{k}:2   \"run\"   3 days ago   Exited (1) 1 day ago      old{e}", "repo{k} v{e} sha{e} 2 weeks ago 1{k}0MB",
        "#{k} exporting to image", "#{k} naming to docker.io/a:{e}", "Step {k}/9 : RUN x", "ERROR: failed to solve {e}",
    ),
    6,
    {
        "docker ps": _map(f"list_filter(L, lambda x: len({_COLUMNS}) >= 4)", f"{_COLUMNS}[-1] || '  ' || {_STATUS} || '  ' || {_COLUMNS}[2]"),
        "docker images": f"""({_map(_IMAGES, f"{_TOKENS}[1] || ':' || {_TOKENS}[2] || '  ' || {_TOKENS}[-1]")}
            || ['[total: ' || printf('%.2f', list_sum({_map(_IMAGES, _SIZE)}) / 1000) || ' GB across ' || len({_IMAGES}) || ' images]'])""",
        "docker build .": _or(_where(r"(?i)\berror\b|failed"), _last(_where("naming to|writing image|Successfully (?:built|tagged)|exporting to image"))),
    },
)

_at = lambda a, b=None: f"trim(substring(x, {a}{'' if b is None else f', {b - a}'}))"
_SICK = f"list_filter(N[2:], lambda x: {_at(20, 39)} not in ('Running', 'Completed', 'Succeeded') or ({_at(20, 39)} = 'Running' and regexp_extract({_at(12, 20)}, '^(\\d+)/', 1) <> regexp_extract({_at(12, 20)}, '/(\\d+)$', 1)))"
_STATES = f"list_transform(N[2:], lambda x: {_at(20, 39)})"
_TALLY = f"array_to_string(list_transform(list_sort(list_distinct({_STATES})), lambda y: y || ': ' || len(list_filter({_STATES}, lambda z: z = y))), ', ')"

family(
    "kubectl_pods",
    ("pod-{k}      1/1     Running            0          {e}m", "job-{k}      0/1     Completed          0          {e}m", "pod-{k}      0/1     CrashLoopBackOff   7          {e}m", "pod-{k}      1/2     Running            1          {e}m"),
    2,
    {
        "kubectl get pods": _if(
            f"len({_SICK}) = 0", "['[' || (len(N) - 1) || ' pods, all healthy]']",
            f"""({_map(_SICK, f"{_at(1, 12)} || '  ' || {_at(12, 20)} || '  ' || {_at(20, 39)} || '  ' || {_at(39, 50)}")} || [{_TALLY}])""",
        ),
        "kubectl get deployments": _cap(_map("N", f"{_at(1, 12)} || '  ' || {_at(12, 20)} || '  ' || {_at(20, 39)} || '  ' || {_at(39, 50)} || '  ' || {_at(50)}"), 31),
        "kubectl apply -f x": _where("(?i)created|configured|unchanged|deleted|patched|scaled|error|rolled out", "N"),
    },
    head=("NAME       READY   STATUS             RESTARTS   AGE",),
)

_WARNED = f"list_filter(N[2:], lambda x: {_at(5, 15)} = 'Warning' or regexp_matches({_at(15, 25)}, 'CrashLoop|Error|BackOff|Pending|Evicted|OOMKilled|Failed|Unhealthy|FailedScheduling|Unknown|Terminating'))"

family(
    "kubectl_events",
    ("1m  Normal    Pulled    pod/a{e}", "2m  Normal    Started   pod/b{e}", "3m  Warning   BackOff   pod/c{e}", "4m  Normal    Failed    pod/d{e}"),
    2,
    {"kubectl get events": _or(_cap(_map(_WARNED, f"{_at(1, 5)} || '  ' || {_at(5, 15)} || '  ' || {_at(15, 25)} || '  ' || {_at(25)}"), 20), "['[no warning events]']")},
    head=("AGE TYPE      REASON    OBJECT",),
)

family(
    "helm",
    ("app{e}\tdefault\t{k}\t2024-01-01\tdeployed\tchart-{k}\t1.0", "NAME: app{e}", "LAST DEPLOYED: now {e}", "STATUS: deployed", "CHART: c{e}", "+ added {e}", "line {e}", "kind: Service", "connection refused {e}"),
    8,
    {
        "helm list": _map("N", r"array_to_string(list_filter([string_split_regex(trim(x), '\t+|\s{2,}')[1], string_split_regex(trim(x), '\t+|\s{2,}')[5], string_split_regex(trim(x), '\t+|\s{2,}')[6], string_split_regex(trim(x), '\t+|\s{2,}')[2]], lambda y: y is not null), chr(9))"),
        "helm install a": _where("^(?:NAME|LAST DEPLOYED|NAMESPACE|STATUS|REVISION|Release|Rollback)|(?i:error|failed|failure|fatal|panic|exception|denied|refused|timeout|not found)"),
        "helm status a": _where("^(?:NAME|LAST DEPLOYED|NAMESPACE|STATUS|REVISION|CHART|VERSION|APP VERSION|DESCRIPTION)"),
        "helm diff a": _or(_where(r"^\s*[+-]|has (?:been|changed)"), "['[no diff]']"),
        "helm template a": _if("len(L) <= 60", "L", f"(L[1:60] || ['[... ' || len(L) || ' lines total, ' || {_count('^kind:')} || ' Kubernetes resources]'])"),
    },
)

family(
    "terraform",
    (
        "  + create r{e}", "  ~ update {e}", "Plan: {k} to add", "aws_x.a{e}: Creating...", "aws_x.a{e}: Creation complete after {k}s", "Apply complete! Resources: {k}", "Terraform has been successfully initialized!",
        "name_{e} = \"v\"", "secret_{e} = (sensitive value)", "# aws_x.a{e}:", "id   = \"i-{e}\"", "Warning: old {k}", "Error: bad {e}", "Success! {e}",
    ),
    12,
    {
        "terraform plan": _where(r"^\s*[+~-]|^Plan:|^Error"),
        "terraform apply": _where(r": (?:Creat|Modif|Destr)\w+ (?:complete|after)|: (?:Creating|Modifying|Destroying)\.\.\.|Error|^Apply complete|^Destroy complete"),
        "terraform init": _or(_where("(?i)error"), _last(_where("successfully initialized"))),
        "terraform validate": _if("contains(T, 'Success!')", "['[valid]']", _where("(?i)error|warning|on .* line")),
        "terraform output": _map(_where("="), "regexp_replace(x, '=.*sensitive.*$', '= <sensitive>')"),
        "terraform state list": _cap("N", 50),
        "terraform state show": _where(r"^#|^resource|^\s*(?:id|arn|name|type|region|status|state|tags|\w+_id|\w+_arn|\w+_name)\s*="),
    },
)

family(
    "aws_s3",
    ("2024-01-01 00:00:00    {e} file{e}.txt", "                           PRE dir{k}/", "2024-01-02 00:00:00         7 log{e}"),
    3,
    {
        "aws s3 ls": rf"""(list_sort({_map(_where(r'^\s*PRE '), 'trim(x)')}) || ['[' || {_count(r'^\S+ \S+\s+\d+ ')} || ' objects, ' || list_sum({_map(_where(r'^\S+ \S+\s+\d+ '), r"regexp_extract(x, '^\S+ \S+\s+(\d+) ', 1)::bigint")})::bigint || ' bytes]'])"""
    },
)

# --- Files and the shell ---------------------------------------------------------------------

_HITS = _pairs(r"^([^:\n]+):(\d+):(.*)$", r"\1", r"\2 || ': ' || trim(\3)")
_SHORT = _map("N", "regexp_replace(x, '^/repo/', '')")
_FOLDERS = f"list_transform({_SHORT}, lambda x: {{'k': regexp_extract(x, '^(.*)/', 1), 'v': regexp_extract(x, '([^/]*)$', 1)}})"
_PLACES = f"list_transform(N, lambda x: {{'k': regexp_extract(x, '^(.*)/', 1), 'v': regexp_extract(x, '([^/]*)$', 1)}})"

family("grep", ("src/f{k}.rs:{e}:  let needle = {e};", "src/g.rs:{e}:needle({k})", "Binary file x{e} matches"), 3, {
    "grep needle": f"({_groups(_HITS, 100, "{k} || ': [' || {n} || ' matches]'")} || ['[' || len({_HITS}) || ' matches in ' || len(list_distinct(list_transform({_HITS}, lambda p: p.k))) || ' files]'])",
})

family("find", ("/repo/src/d{k}/f{e}.rs", "/repo/docs/g{e}.md", "/repo/src/h{e}.rs"), 3, {
    "find .": _if("len(N) <= 50", "N", f"({_groups(_FOLDERS, 5, "{k} || '/ [' || {n} || ']'")} || ['[' || len(N) || ' total, ' || len(list_distinct(list_transform({_FOLDERS}, lambda p: p.k))) || ' dirs]'])"),
    "(glob)": f"({_groups(_PLACES, 10, "{k} || '/ [' || {n} || ']'")} || ['[' || len(N) || ' paths]'])",
    "tree": f"(N[1:25] || ['[... ' || (len(N) - 25) || ' more ...]'] || {_last(_where('director(?:y|ies)', 'N'))})",
})

_DIRS, _PLAIN_FILES = _without("^node_modules/$", _where("/$", "N")), _without("/$", "N")
_EXTS = f"list_transform({_where(r'\.', _PLAIN_FILES)}, lambda x: regexp_extract(x, '([^.]*)$', 1))"
_TOP = f"list_sort(list_transform(list_distinct({_EXTS}), lambda y: {{'n': -len(list_filter({_EXTS}, lambda z: z = y)), 'e': y}}))"

family("ls", ("src{k}/", "file{e}.rs", "a{e}.toml", "b{e}.md", "node_modules/", "README{e}", "c{e}.rs"), 7, {
    "ls": f"""({_cap(f'({_DIRS} || {_PLAIN_FILES})', 40)} || ['[' || len({_DIRS}) || ' dirs, ' || len({_PLAIN_FILES}) || ' files]']
        || {_if(f"len({_TOP}) >= 3", f"['top: ' || array_to_string(list_transform(({_TOP})[1:3], lambda p: '.' || p.e || ' ×' || -p.n), ', ')]")}
        || {_if(f"{_count('^node_modules/$', 'N')} > 0", f"['[hidden: ' || array_to_string({_where('^node_modules/$', 'N')}, ', ') || ']']")})""",
})

_KIND = """case when starts_with(x, 'PATH=') then 'PATH' when starts_with(x, 'AWS') then 'Cloud' when starts_with(x, 'PYTHON') then 'Language' when starts_with(x, 'EDITOR') then 'Tools'
    when starts_with(x, 'HOME') then 'System' else 'Other' end"""
_SHOWN = """case when starts_with(x, 'API_TOKEN') then 'API_TOKEN=***' when starts_with(x, 'PATH=') then 'PATH=/a:/b:/c:… [' || len(string_split(x, ':')) || ' entries]' else x end"""
_of = lambda k: f"list_transform(list_filter(N, lambda x: {_KIND} = '{k}'), lambda x: {_SHOWN})"

family("env", ("AWS_REGION=r{e}", "PYTHONPATH=/p{e}", "EDITOR=vi{k}", "HOME=/h/{e}", "FOO_{e}=x", "API_TOKEN=abc{e}", "PATH=/a:/b:/c:/d{e}:/e"), 7, {
    "env": "(" + " || ".join(_if(f"len({_of(k)}) > 0", f"(['[{k}]'] || {_cap(_of(k), 10 if k == 'Other' else 1_000_000)})") for k in ("PATH", "Cloud", "Language", "Tools", "System", "Other")) + ")",
})

_ROWS = _without(r"^\(\d+ rows?\)", _without(r"^[\s+|\-]+$", "N"))

family("psql", (" {e} | n{k} ", " {e} | m{k} ", "(1{k} rows)", "ERROR:  bad {e}"), 3, {
    "psql": _or(
        _where("^(?:ERROR|FATAL|psql: error)", "N"),
        f"({_cap(_map(_ROWS, "array_to_string(list_transform(string_split(x, '|'), lambda y: trim(y)), chr(9))"), 21, after=' more rows]')} || {_last(_where(r'^\(\d+ rows?\)', 'N'))})",
    ),
}, head=(" id | name ", "----+------"))

family("transfers", ("a{e}/file.txt", "     {e}  5{k}%  1.2MB/s", "sent {e} bytes", "  {k}50K .......... 10%", "frame= {e} fps=25", "size=  {k}kB"), 6, {
    "rsync": _without(r"^\s*[\d,]+\s+\d+%|to-chk="),
    "wget": _without(r"^\s*\d+K[ .]|\d+%\[|^\s*\d+%"),
    "ffmpeg": _without(r"^(?:frame=|size=)|^\s+(?:lib|built|configuration)"),
})
