"""Handlers of compilers, build tools and package managers."""

from __future__ import annotations

import re

from textsluice.functions.compaction import parse_object
from textsluice.operators.handlers.base import blocks, cap, cut, first, full, groups, handler, hard_keep, join, last, number, rust_lines, where, without

ERR, WARN = r"(?i)\berror\b|\bfatal\b", r"(?i)\bwarning\b"


def _cargo_build(text: str) -> str:
    errors, warnings, ended = [], [], None
    for x in rust_lines(text):
        row = parse_object(x)
        if row is None:
            if re.match(r"^(error|warning)", x):
                (errors if x.startswith("error") else warnings).append(("", x))
            continue
        if row.get("reason") == "build-finished":
            ended = bool(row.get("success"))
        m = row.get("message")
        if row.get("reason") == "compiler-message" and isinstance(m, dict):
            spans = m.get("spans") or [{}]
            at = f" ({spans[0]['file_name']}:{spans[0].get('line_start', 0)})" if spans[0].get("file_name") else ""
            rule = (m.get("code") or {}).get("code") or ""
            entry = (rule, f"{m.get('message', '')}{at}")
            (errors if m.get("level") == "error" else warnings).append(entry) if m.get("level") in ("error", "warning") else None
    out = cap([f"error: {x}" if not x.startswith("error") else x for _, x in errors], 15)
    if len(warnings) >= 3:
        out += groups(((r or "other", x) for r, x in warnings), 3, head="[{} ×{}]")
    else:
        out += [f"warning: {x}" if not x.startswith("warning") else x for _, x in warnings]
    if warnings:
        out.append(f"[{len(warnings)} warnings]")
    if ended is not None:
        out.append("Build OK" if ended else "Build FAILED")
    return join(out, text)


def _cargo_test(text: str) -> str:
    lines = rust_lines(text)
    failed = where(lines, r"^test .* FAILED$")
    summary = last(lines, r"^test result:")
    if not failed:
        return join(summary, text)
    at = next((i for i, x in enumerate(lines) if x.strip() == "failures:"), len(lines))
    return join(failed + [x for x in lines[at + 1 :] if x.strip()][:20] + summary, text)


@handler("cargo")
def cargo(text: str, sub: str) -> str:
    if sub in ("build", "check", "clippy"):
        return _cargo_build(text)
    if sub == "test":
        return _cargo_test(text)
    if sub == "nextest":
        return join(where(rust_lines(text), r"^\s*FAIL") + last(rust_lines(text), r"^\s*Summary"), text)
    return text


@handler("clippy", "cargo-clippy")
def clippy(text: str, sub: str) -> str:
    lines = rust_lines(text)
    errors, warnings = list(dict.fromkeys(where(lines, r"^error"))), list(dict.fromkeys(where(lines, r"^warning")))
    return join(errors + cap(warnings, 5) + first(lines, r"^\s*=?\s*help:") + last(lines, r"generated \d+ warning|could not compile"), text)


@handler("go")
def go(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub in ("build", "install", "vet"):
        found = where(lines, r"\.go:\d+|^#|(?i:error)|cannot|undefined")
        return join(found, text) if text.strip() else "[build OK]"
    if sub == "test":
        rows = [r for r in map(parse_object, lines) if r and "Action" in r]
        return _go_json(rows, lines, text) if rows else _go_text(lines, text)
    if sub == "mod":
        return "\n".join(cap(where(lines, r"(?i)error|upgraded|downgraded|added|removed|require"), 20)) or "[go mod complete]"
    if sub == "run" and len(lines) > 50:
        at = next((i for i, x in enumerate(lines) if x.startswith(("goroutine 1", "panic:"))), None)
        return "\n".join(lines[at:]) if at is not None else _short(text, 40)
    return text


def _short(text: str, budget: int) -> str:
    from textsluice.functions.summarise import summarise

    return summarise(text, budget)


def _go_json(rows: list[dict], lines: list[str], text: str) -> str:
    counts: dict[str, dict[str, int]] = {}
    output: dict[tuple[str, str], list[str]] = {}
    bad, out = [], []
    for r in rows:
        package, test, action = r.get("Package", ""), r.get("Test"), r["Action"]
        if action == "output":
            output.setdefault((package, test or ""), []).append(str(r.get("Output", "")).rstrip("\n"))
        elif action in ("pass", "fail", "skip"):
            own = counts.setdefault(package, {"pass": 0, "fail": 0, "skip": 0, "bad": 0})
            if test:
                own[action] += 1
                bad += [(package, test)] * (action == "fail")
            else:
                own["bad"] = int(action == "fail")
    for package, test in bad:
        own = [x for x in output.get((package, test), []) if x.strip() and not re.match(r"^\s*(?:===|---)", x)]
        out += [f"FAIL {test}", *(f"  {x.strip()}" for x in own[:10])]
    for package, c in counts.items():
        name = package.rsplit("/", 1)[-1]
        out.append(f"{'FAIL' if c['bad'] or c['fail'] else 'ok'} {name} [{c['pass']} passed, {c['fail']} failed, {c['skip']} skipped]")
    return join(out + [x for x in lines if x.strip() and parse_object(x) is None], text)


def _go_text(lines: list[str], text: str) -> str:
    out = blocks(lines, r"^\s*--- FAIL", 10, r"^(?:---|===|ok\s|FAIL|PASS)") + where(lines, r"^(?:ok|FAIL)\s+\S|^panic:")
    passed = len(where(lines, r"^\s*--- PASS"))
    return join(out + ([f"[{passed} tests passed]"] if passed else []), text)


@handler("make", "gmake", "ninja", "bmake")
def make(text: str, sub: str) -> str:
    lines = full(text)
    if lines and all(re.search(r"Nothing to be done|up to date|ninja: no work to do", x) for x in lines):
        return "[make: nothing to be done]"
    if where(lines, r"(?i)\berror\b|\*\*\*"):
        return join(lines, text)
    compiler = r"^\s*(?:(?:g?cc|g\+\+|c\+\+|clang(?:\+\+)?|ar|ld)(?:\s|$)|\[\d+/\d+\]\s|(?:CC|CXX|LD|AR)\s)"
    compiled = where(lines, compiler)
    notes = where(lines, r"(?i)warning|note:")
    return join([*notes, *compiled[-5:], f"[make: complete — {len(compiled)} file(s) compiled]"] if compiled else lines, text)


#: Steps and failures of a build, under make or ninja. Not indented: within a configure error they are.
BUILD_STEP = r"^(?:\[\s*\d+%\]|\[\d+/\d+\]\s|(?:g?cc|g\+\+|c\+\+|clang(?:\+\+)?|ar|ld)\s|g?make(?:\[\d+\])?: \*\*\*)"


@handler("cmake", "cmake3")
def cmake(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "--build" or where(lines, BUILD_STEP):
        built = len(where(lines, r"Built target"))
        return join(where(lines, r"(?i)\berror\b|warning:") + [f"[{built} targets built]"], text)
    return join(where(lines, r"CMake (?:Error|Warning)|written to|Configuring incomplete"), text)


@handler("bazel", "bazelisk", "bzl")
def bazel(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "query":
        return join(cap(full(text), 30), text)
    if sub == "test":
        passed, failed = len(where(lines, r"\bPASSED\b")), where(lines, r"\bFAILED\b|\bTIMEOUT\b")
        return join(failed + where(lines, r"test\.log") + [f"[{passed} passed, {len(failed)} failed]"], text)
    errors = where(lines, r"^ERROR|\berror:")
    actions, took = number(r"(\d+) (?:total )?actions?", text), re.search(r"Elapsed time: ([\d.]+s)", text)
    if not errors:
        return f"[{actions or 0} actions, build OK ({took[1] if took else '?'})]"
    return join(errors + blocks(lines, r"^Target //", 3) + where(lines, r"Elapsed time|Build completed|FAILED:"), text)


@handler("swift")
def swift(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "build":
        return join(cap(where(lines, r"\.swift:\d+.*(?:error|warning)"), 20) or last(lines, r"Compiling|Build complete|Linking"), text)
    if sub == "test":
        return join(where(lines, r"error:|failed") + last(lines, r"Executed \d+ tests"), text)
    if sub == "run":
        at = next((i for i, x in enumerate(lines) if re.search(r"(?i)fatal error", x)), None)
        return "\n".join(lines[at:]) if at is not None else text
    return join(without(full(text), r"^(?:Fetching|Computing|Creating|Updating|Working copy)"), text)


@handler("dotnet")
def dotnet(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "test":
        return join(blocks(lines, r"^\s*Failed ", 6) + where(lines, r"^(?:Total tests|Passed!|Failed!|\s+Passed:|\s+Failed:)"), text)
    if sub == "restore":
        errors = where(lines, ERR)
        return "\n".join(errors) if errors else f"[{len(where(lines, r'Restored '))} packages restored]"
    errors = list(dict.fromkeys(where(lines, r"\berror [A-Z]+\d+")))
    codes: dict[str, int] = {}
    for x in where(lines, r"\bwarning [A-Z]+\d+"):
        code = re.search(r"warning ([A-Z]+\d+)", x)[1]
        codes[code] = codes.get(code, 0) + 1
    if not errors and not codes and "Build succeeded" in text:
        return "[build OK]"
    top = [f"[{c} ×{n}]" for c, n in sorted(codes.items(), key=lambda x: (-x[1], x[0]))]
    return join(errors + top + where(lines, r"Build (?:succeeded|FAILED)|\d+ (?:Warning|Error)\(s\)"), text)


@handler("mvn", "maven")
def mvn(text: str, sub: str) -> str:
    noise = r"^\[INFO\]\s*(?:$|-+|Download|Scanning|Building|Copying|Using|Changes detected|Compiling|---)|^Download(?:ing|ed)"
    lines = without(rust_lines(text), noise)
    kept = where(lines, r"^\[ERROR\]|^\[WARNING\]|Tests run:|FAIL|Reactor Summary|SUCCESS|BUILD") + blocks(lines, r"<<< (?:FAILURE|ERROR)", 15)
    out = list(dict.fromkeys(kept))
    for word in ("BUILD SUCCESS", "BUILD FAILURE"):
        if word in text and not any(word in x for x in out):
            out.append(word)
    return join(out, text)


@handler("gradle", "gradlew")
def gradle(text: str, sub: str) -> str:
    lines = rust_lines(text)
    fresh = len(where(lines, r"UP-TO-DATE|NO-SOURCE|FROM-CACHE"))
    out = where(lines, r"^> Task .* FAILED|^[ew]: ") + blocks(lines, r"FAILED$|What went wrong", 10)
    return join([*dict.fromkeys(out), *([f"[{fresh} tasks up to date]"] if fresh else []), *where(lines, r"^BUILD ")], text)


def _node_run(text: str) -> str:
    lines = without(full(text), r"^(?:> |npm (?:notice|warn)|yarn run|\$ |Done in)")
    if len(lines) <= 30:
        return join(lines, text)
    keys = where(lines, r"(?i)error|warn|fail|success|built|compiled|complete|listening|ready")
    picked = [x for i, x in enumerate(keys) if i == 0 or keys[i - 1] != x]
    return join([*picked, f"[{len(lines)} lines]", *lines[-5:]], text)


def _node_test(text: str) -> str:
    lines = rust_lines(text)
    return join(where(lines, r"^\s*(?:FAIL|✕|✗|×)") + blocks(lines, r"^\s*●", 30) + last(lines, r"^Tests?:|passing|failing"), text)


@handler("npm", "yarn")
def npm(text: str, sub: str) -> str:
    if sub in ("install", "ci", "i", "add"):
        bad = where(full(text), r"npm (?:ERR!|error)|(?i:error )")
        if bad:
            return "\n".join(bad)
        count = number(r"added (\d+) packages?", text)
        return "\n".join([f"[{count if count is not None else 0} packages installed]", *last(full(text), r"vulnerabilit")])
    if sub in ("test", "t"):
        return _node_test(text)
    return _node_run(text)


@handler("pnpm")
def pnpm(text: str, sub: str) -> str:
    lines = full(text)
    if sub in ("install", "i", "add"):
        if bad := where(lines, r"ERR_PNPM|(?i:error)"):
            return "\n".join(bad)
        return join(first(lines, r"^Packages:") + last(lines, r"^Progress:") + cap(where(lines, r"(?i)warn"), 5), text)
    if sub in ("test", "t"):
        return _node_test(text)
    if len(lines) <= 20:
        return join(lines, text)
    return join([*where(lines, r"(?i)error|warn|fail|built|done"), f"[{len(lines)} lines]", *lines[-5:]], text)


@handler("pip", "pip3", "poetry", "pdm", "conda")
def pip(text: str, sub: str) -> str:
    lines = full(text)
    if sub in ("freeze", "list"):
        return text
    if sub in ("install", "add", ""):
        if not where(lines, ERR) and where(lines, r"(?i)already satisfied"):
            return "[already satisfied]"
        done = re.search(r"Successfully installed (.+)", text)
        return join(where(lines, r"(?i)error|warning") + ([f"[{len(done[1].split())} packages installed]"] if done else []), text)
    return join(last(lines), text)


@handler("uv", "uvx")
def uv(text: str, sub: str) -> str:
    if sub not in ("install", "add", "sync", "remove", "lock", "pip"):
        return text
    out: list[str] = []
    for x in without(full(text), r"^(?:Using (?:Python|CPython)|Creating virtual|Resolved \d|Audited \d)"):
        if re.match(r"^\s*(?:Downloading|Downloaded|Prepared|Building|Built)", x):
            if out[-1:] != ["  [downloads omitted]"]:
                out.append("  [downloads omitted]")
        else:
            out.append(x)
    return join(out, text)


@handler("brew")
def brew(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub in ("install", "upgrade"):
        return join(where(lines, r"^(?:==> (?:Installing|Upgrading|Pouring|Summary)|🍺|Error|Warning)") + blocks(lines, r"^==> Caveats", 15, r"^==>"), text)
    if sub in ("uninstall", "remove"):
        return join(where(lines, r"(?i)uninstalling|error"), text)
    if sub == "update":
        return join(blocks(lines, r"^==> ", 30, r"^==>"), text)
    if sub == "list":
        return join(cap(full(text), 40), text)
    at = next((i for i, x in enumerate(lines) if x.startswith("==> Analytics")), len(lines))
    return join(lines[:at][:20], text) if sub == "info" else text


@handler("next")
def next_(text: str, sub: str) -> str:
    lines = full(text)
    errors, warnings = where(lines, r"(?i)\berror\b|failed"), where(lines, WARN)
    if sub == "build":
        if errors:
            return "\n".join(errors)
        pages = len(where(lines, r"^[├└┌]\s"))
        return join(where(lines, r"^\s*✓") + ([f"[{pages} pages]"] if pages else []) + warnings[:3], text)
    if sub == "dev":
        return join(where(lines, r"(?i)ready|error|warn|compiled|local:"), text)
    if sub == "lint":
        return join(errors + ([f"[{min(len(warnings), 10)} warnings]"] if warnings else []), text)
    return text if len(lines) <= 20 else join(where(lines, r"(?i)error|warn|✓") or lines[-10:], text)


@handler("vite")
def vite(text: str, sub: str) -> str:
    lines = full(text)
    if where(lines, r"hmr update|page reload"):
        updates = where(lines, r"hmr update|page reload")
        return join([*without(lines, r"hmr update|page reload|(?i:error)"), f"[hmr ×{len(updates)}]", *where(lines, r"(?i)error")], text)
    assets = where(lines, r"\bkB\b|\bKiB\b")
    shown = assets if len(assets) <= 15 else [*assets[:5], f"[... {len(assets) - 7} assets ...]", *assets[-2:]]
    return join(first(lines, r"^vite") + where(lines, r"modules transformed") + blocks(lines, r"(?i)^error", 8) + where(lines, WARN)[:5] + shown + where(lines, r"built in"), text)


@handler("webpack", "webpack-cli")
def webpack(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return join(where(lines, r"^asset ") + blocks(lines, r"^ERROR in", 10) + blocks(lines, r"^WARNING in", 5)[:5] + last(lines, r"^webpack .*compiled"), text)


@handler("turbo")
def turbo(text: str, sub: str) -> str:
    lines, out, errors = rust_lines(text), [], {}
    for x in lines:
        m = re.match(r"^(\S+:\S+?): (.*)$", x)
        if m and re.search(r"cache (?:hit|miss)", m[2]):
            out.append(f"{m[1]} cache {'hit' if 'cache hit' in m[2] else 'miss'}")
        elif m and re.search(ERR, m[2]) and errors.setdefault(m[1], 0) < 8:
            errors[m[1]] += 1
            out.append(x)
        elif re.match(r"^\s*(?:Tasks|Cached|Time|Failed):|^• ", x):
            out.append(x.strip())
    return join(out, text)


@handler("nx")
def nx(text: str, sub: str) -> str:
    out, held, name, passed, cached = [], [], None, 0, 0
    for x in [*rust_lines(text), "> nx run :end"]:
        m = re.match(r"^\s*(?:>|✔|✖)\s+nx run (\S+)", x)
        if m:
            bad = any(re.search(r"(?i)error|failed|✖", y) for y in held)
            if name and bad:
                out += held
            elif name:
                passed += 1
                cached += any("cache" in y for y in held)
            held, name = [x], m[1]
        else:
            held.append(x)
    summary = f"[{passed} tasks passed" + (f" ({cached} cached)]" if cached else "]")
    return join([*out, summary] if passed or out else [], text)


@handler("ember")
def ember(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "test":
        return join(blocks(lines, r"^not ok", 12, r"^(?:ok|not ok)") + where(lines, r"^# (?:tests|pass|fail|skip)"), text)
    if sub in ("serve", "s"):
        return join(first(lines, r"https?://"), text)
    return join(cap(where(lines, ERR), 40) + last(full(text)), text)


@handler("prisma")
def prisma(text: str, sub: str) -> str:
    lines = full(text)
    word = sub.split(" ")[0]
    errors = where(lines, r"(?i)error|P\d{4}")
    if errors:
        return errors[0] if word == "validate" else "\n".join(errors)
    if word == "generate":
        return join(where(lines, r"✔") + where(lines, WARN)[:3], text)
    if word == "migrate":
        steps = where(lines, r"^\s*[└├]─ |\d{14}_")
        return join(cap(steps, 5) + last(lines, r"(?i)applied|in sync|success|created"), text)
    if word == "db":
        return join(where(lines, r"(?i)sync|push|seed|🚀|🌱"), text)
    if word == "studio":
        return join(first(lines, r"https?://"), text)
    if word == "validate":
        return "[schema valid]"
    if word == "format":
        return f"[{len(lines)} lines formatted]"
    return text if len(lines) <= 10 else join([*where(lines, r"(?i)✔|warn"), *lines[-5:]], text)


@handler("wget")
def wget(text: str, sub: str) -> str:
    return join(without(rust_lines(text), r"^\s*\d+K[ .]|\d+%\[|^\s*\d+%"), text)


@handler("rsync")
def rsync(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return text if len(lines) < 5 else join(without(lines, r"^\s*[\d,]+\s+\d+%|to-chk="), text)


@handler("ffmpeg")
def ffmpeg(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return text if len(lines) < 5 else join(without(lines, r"^(?:frame=|size=)|^\s+(?:lib|built|configuration)"), text)


@handler("helm")
def helm(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "list":
        rows = [re.split(r"\t+|\s{2,}", x.strip()) for x in lines if x.strip()]
        return join(["\t".join(r[i].strip() for i in (0, 4, 5, 1) if i < len(r)) for r in rows], text)
    if sub in ("install", "upgrade", "rollback"):
        return join([x for x in lines if re.match(r"^(?:NAME|LAST DEPLOYED|NAMESPACE|STATUS|REVISION|Release|Rollback)", x) or hard_keep(x)], text)
    if sub == "status":
        return join(where(lines, r"^(?:NAME|LAST DEPLOYED|NAMESPACE|STATUS|REVISION|CHART|VERSION|APP VERSION|DESCRIPTION)"), text)
    if sub == "diff":
        return join(where(lines, r"^\s*[+-]|has (?:been|changed)"), "[no diff]")
    if sub == "template":
        kinds = len(where(lines, r"^kind:"))
        return text if len(lines) <= 60 else "\n".join([*lines[:60], f"[... {len(lines)} lines total, {kinds} Kubernetes resources]"])
    return join(full(text), text)


@handler("terraform", "tofu")
def terraform(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub == "plan":
        return "[no changes]" if re.search(r"No changes\.|Infrastructure is up-to-date", text) else join(where(lines, r"^\s*[+~-]|^Plan:|^Error"), text)
    if sub in ("apply", "destroy"):
        return join(where(lines, r": (?:Creat|Modif|Destr)\w+ (?:complete|after)|: (?:Creating|Modifying|Destroying)\.\.\.|Error|^Apply complete|^Destroy complete"), text)
    if sub == "init":
        return join(where(lines, r"(?i)error") or last(lines, r"successfully initialized"), text)
    if sub == "validate":
        return "[valid]" if "Success!" in text else join(where(lines, r"(?i)error|warning|on .* line"), text)
    if sub == "output":
        return join([re.sub(r"=.*sensitive.*$", "= <sensitive>", x) for x in lines if "=" in x], text)
    if sub == "state list":
        return join(cap(full(text), 50), text)
    if sub == "state show":
        return join(where(lines, r"^#|^resource|^\s*(?:id|arn|name|type|region|status|state|tags|\w+_id|\w+_arn|\w+_name)\s*="), text)
    return text


def _lint_paths(lines: list[str], most: int, issue: str) -> list[str]:
    """Files and their issues as first met, ``most`` issues in all."""
    out, path, shown, total = [], None, 0, 0
    for x in lines:
        if re.match(issue, x):
            total += 1
            if shown < most:
                if path:
                    out.append(path)
                    path = None
                out.append("  " + cut(x.strip(), 120))
                shown += 1
        elif re.match(r"^(?:/|\.{0,2}/|[A-Za-z]:\\|\w)\S*\.\w+\s*$", x):
            path = x.strip()
    return out + ([f"[+{total - shown} more issues]"] if total > shown else [])


@handler("eslint")
def eslint(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return join(_lint_paths(lines, 30, r"^\s+\d+:\d+\s+(?:error|warning)") + last(lines, r"\d+ problems?"), text)


@handler("stylelint")
def stylelint(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return join(_lint_paths(lines, 40, r"^\s+\d+:\d+\s+[✖×⚠]?") + last(lines, r"\d+ (?:problems?|errors?)"), text)


@handler("biome")
def biome(text: str, sub: str) -> str:
    lines, out, fresh = rust_lines(text), [], False
    for x in lines:
        if re.match(r"^\S+:\d+:\d+ \S+", x):
            out.append(x.rstrip(" ━"))
            fresh = True
        elif fresh and re.match(r"^\s*[×✖!i]\s+\S", x):
            out.append("  " + x.strip())
            fresh = False
        elif re.match(r"^(?:Checked|Found|Skipped) ", x):
            out.append(x)
    return join(out, text)


@handler("tsc")
def tsc(text: str, sub: str) -> str:
    if re.search(r"Found 0 errors", text):
        return "[0 errors]"
    out, path, code, seen = [], None, None, 0
    for x in [*rust_lines(text), ""]:
        m = re.match(r"^(.+?)\((\d+),\d+\): (?:error|warning) (TS\d+): (.*)$", x)
        if m and (m[1], m[3]) == (path, code):
            seen += 1
            continue
        if seen > 1:
            out[-1] += f" (×{seen})"
        if m:
            if m[1] != path:
                out.append(m[1])
            out.append(f"  {m[2]} {m[3]} {cut(m[4], 80)}")
            path, code, seen = m[1], m[3], 1
        else:
            path, code, seen = None, None, 0
            if x.startswith("Found "):
                out.append(x)
    return join(out, text)


@handler("mypy")
def mypy(text: str, sub: str) -> str:
    if re.match(r"^Success", text):
        return last(rust_lines(text), r"^Success")[0]
    lines = without(full(text), r": note: ")
    pairs = [(m[1], f"{m[2]}: {m[3]}") for m in (re.match(r"^([^:]+):(\d+)(?::\d+)?: (.*)$", x) for x in lines) if m]
    return join(groups(pairs, 10, head="{} [{}]") + without(lines, r"^[^:]+:\d+"), text)


@handler("ruff")
def ruff(text: str, sub: str) -> str:
    lines = full(text)
    if sub == "format":
        return join(last(lines, r"reformatted|left unchanged") or [f"[{len(lines)} files]"], text)
    if re.search(r"All checks passed", text):
        return "All checks passed"
    pairs = [(m[2], f"{m[1]} {m[3]}") for m in (re.match(r"^(\S+:\d+:\d+):? ([A-Z]+\d+) (.*)$", x) for x in lines) if m]
    return join(groups(pairs, 3, head="[{} ×{}]") + last(lines, r"^Found"), text)


@handler("golangci-lint")
def golangci(text: str, sub: str) -> str:
    lines = full(text)
    row = parse_object(lines[0]) if lines and lines[0].lstrip().startswith("{") else None
    if row is not None:
        issues = [(i.get("Pos", {}).get("Filename", "?"), f"{i.get('Pos', {}).get('Line', 0)} {i.get('FromLinter', '')}: {i.get('Text', '')}") for i in row.get("Issues") or []]
    else:
        issues = [(m[1], f"{m[2]} {m[3]}") for m in (re.match(r"^([^:\s]+):(\d+)(?::\d+)?: (.*)$", x) for x in lines) if m]
    notes = where(lines, r"level=error") + where(lines, r"level=warning")[:3]
    return join(groups(issues, 40, 40, sort=False, head="{} [{}]") + notes + ([f"[{len(issues)} issues]"] if issues else []), text)


@handler("prettier")
def prettier(text: str, sub: str) -> str:
    lines = full(text)
    if bad := where(lines, r"\[error\]|SyntaxError"):
        return "\n".join(bad)
    if re.search(r"All matched files use Prettier", text):
        return "[all formatted]"
    files = [x.replace("[warn] ", "") for x in where(lines, r"^\[warn\] \S+\.\w+$")]
    if files:
        return "\n".join([*cap(files, 10), f"[{len(files)} files need formatting]"])
    written = where(lines, r"\d+ms")
    return f"[{len(written)} files written]" if written else text


@handler("rubocop")
def rubocop(text: str, sub: str) -> str:
    row = parse_object(text)
    if row is None:
        return join(where(rust_lines(text), r": [CWEF]: |inspected"), text)
    found = [(f.get("path", ""), o) for f in row.get("files", []) for o in f.get("offenses", [])]
    if not found:
        return "[no offenses]"
    of = lambda *kinds: [f"{p}:{o.get('location', {}).get('start_line', 0)} {o.get('cop_name', '')}: {o.get('message', '')}" for p, o in found if o.get("severity") in kinds]
    return "\n".join(cap(of("error", "fatal"), 10) + cap(of("warning"), 10) + cap(of("convention", "refactor", "info"), 5) + [f"[{len(found)} offenses]"])


def _test_blocks(text: str, start: str, most: int, names: str, summary: str) -> str:
    lines = rust_lines(text)
    return join(where(lines, names) + blocks(lines, start, most) + where(lines, summary), text)


@handler("jest", "bun", "deno")
def jest(text: str, sub: str) -> str:
    return _test_blocks(text, r"^\s*●", 15, r"^\s*FAIL", r"^(?:Tests|Test Suites|Snapshots|Time):")


@handler("vitest")
def vitest(text: str, sub: str) -> str:
    return _test_blocks(text, r"^\s*[×✗]", 5, r"^\s*FAIL", r"^\s*Tests? ")


@handler("pytest")
def pytest(text: str, sub: str) -> str:
    return _test_blocks(text, r"^_{4,}", 10, r"^(?:FAILED|ERROR) ", r"^=+ .*(?:passed|failed|error).* =+$")


@handler("playwright")
def playwright(text: str, sub: str) -> str:
    lines = rust_lines(text)
    count = lambda w: number(rf"(\d+) {w}", text) or 0
    heads = blocks(lines, r"^\s*\d+\) ", 30, r"^\s*\d+\) |^\s*\d+ (?:failed|passed|flaky)")
    kept, left = [], 0
    for x in heads:
        if re.match(r"^\s*\d+\) ", x):
            kept, left = [*kept, x.strip()], 8
        elif left and re.search(r"Error|[Ee]xpect|^\s+at ", x):
            kept, left = [*kept, "  " + x.strip()], left - 1
    if not kept and not count("failed"):
        return f"✓ {count('passed')} passed" if count("passed") else text
    return join([*kept, *where(lines, r"(?i)flaky"), f"{count('failed')} failed, {count('passed')} passed"], text)


@handler("rspec")
def rspec(text: str, sub: str) -> str:
    row = parse_object(text)
    if row is not None and "examples" in row:
        bad = [e for e in row["examples"] if e.get("status") == "failed"]
        out = [s for e in bad for s in [f"FAIL {e.get('full_description', '')} ({e.get('file_path', '')}:{e.get('line_number', 0)})", *(f"  {x}" for x in rust_lines((e.get("exception") or {}).get("message", ""))[:5])]]
        return "\n".join([*out, row.get("summary_line", f"{len(row['examples'])} examples, {len(bad)} failures")])
    lines = rust_lines(text)
    return join(blocks(lines, r"^\s+\d+\) ", 10, r"^\s+\d+\) |^Finished") + where(lines, r"^\d+ examples?,"), text)


@handler("rake", "bundle")
def rake(text: str, sub: str) -> str:
    lines = rust_lines(text)
    return join(blocks(lines, r"^\s*\d+\) (?:Failure|Error)", 12) + where(lines, r"^\d+ runs|rake aborted|^Tasks: TOP"), text)
