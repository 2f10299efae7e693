"""Handlers of version control and its services."""

from __future__ import annotations

import re
from itertools import groupby

from textsluice.operators.handlers.base import cap, columns, first, full, handler, join, last, rust_lines, where, without

GIT_DIFF_TOTAL, GIT_DIFF_HUNK, GIT_DIFF_CONTEXT, GIT_DIFF_WIDTH = 60, 20, 2, 120


def git_status(text: str) -> str:
    staged, changed, untracked, branch = [], [], [], []
    for x in rust_lines(text):
        m = re.match(r"^([ MADRCU?!])([ MADRCU?!]) (.+)$", x)
        if x.startswith("##") or x.startswith("On branch"):
            branch.append(x)
        elif m and m[1] + m[2] == "??":
            untracked.append(m[3])
        elif m:
            staged += [m[3]] * (m[1] not in " ?!")
            changed += [m[3]] * (m[2] not in " ?!")
        elif n := re.match(r"^\s+(?:modified|deleted|renamed|new file):\s+(.+)$", x):
            changed.append(n[1])
    if not (staged or changed or untracked):
        return text if not re.search(r"nothing to commit|^##", text) else "\n".join([*branch, "clean"])
    out = [*branch, f"{len(staged)} staged, {len(changed)} modified, {len(untracked)} untracked"]
    out += cap([f"  S {p}" for p in staged] + [f"  M {p}" for p in changed], 15, "  [+{} more]")
    return "\n".join(out + cap([f"  ? {p}" for p in untracked], 10, "  [+{} more untracked]"))


def git_log(text: str) -> str:
    lines = rust_lines(text)
    kept = [x[:100] for x in without(lines, r"^\s*(?:Co-authored-by|Signed-off-by|Reviewed-by|Change-Id):")]
    out = kept[:50]
    return join(out + ([f"[+{len(lines) - 50} more commits]"] if len(lines) > 50 else []), text)


def _diff_kind(line: str) -> str:
    if line.startswith("diff --git "):
        return "file"
    if line.startswith(("index ", "--- ", "+++ ", "\\ No newline")):
        return ""
    return "hunk" if line.startswith("@@") else {"+": "change", "-": "change", " ": "context"}.get(line[:1], "")


def _tally(lines: list[str]) -> tuple[int, int, int]:
    """(added, removed, modified) of a run of changes: lines of equal place are one modified line from half common words on."""
    old, new = ([set(x[1:].split()) for x in lines if x[0] == c] for c in "-+")
    alike = sum(not (a | b) or len(a & b) >= 0.5 * len(a | b) for a, b in zip(old, new, strict=False))
    return len(new) - alike, len(old) - alike, alike


def git_diff(text: str) -> str:
    """Files with ``[+a -r ~m]``, their changes and two lines of context on either side of each run. A hunk shows 20
    lines, all together 60; beyond these only files and their tallies follow."""
    rows = [(k, x) for k, x in ((_diff_kind(x), x) for x in rust_lines(text)) if k]
    runs = [(k, [x for _, x in own]) for k, own in groupby(rows, key=lambda r: r[0])]
    out: list[str] = []
    total = hunk = 0
    counts: dict[int, list[int]] = {}
    for at, (kind, own) in enumerate(runs):
        if kind == "file":
            names = [x.split()[-1].removeprefix("b/") for x in own]
            out += names
            counts[len(out) - 1] = [0, 0, 0]
            total, hunk = total + len(names) * (total < GIT_DIFF_TOTAL), 0
            continue
        if kind == "change" and counts:
            last_file = max(counts)
            counts[last_file] = [a + b for a, b in zip(counts[last_file], _tally(own), strict=True)]
        if kind == "hunk":
            hunk = 0
            shown = ["@@ " + x.split("@@", 2)[-1].strip() for x in own]
        elif kind == "context":
            before_change = at + 1 < len(runs) and runs[at + 1][0] == "change"
            shown = [x for i, x in enumerate(own) if i < GIT_DIFF_CONTEXT or (before_change and i >= len(own) - GIT_DIFF_CONTEXT)]
        else:
            shown = [x if len(x) <= GIT_DIFF_WIDTH else x[: GIT_DIFF_WIDTH - 1] + "…" for x in own]
        for x in shown:
            if total >= GIT_DIFF_TOTAL or hunk > GIT_DIFF_HUNK:
                break
            full_hunk = kind == "change" and hunk >= GIT_DIFF_HUNK
            out.append("  [...truncated...]" if full_hunk else x)
            total, hunk = total + 1, GIT_DIFF_HUNK + 1 if full_hunk else min(hunk + (kind != "hunk"), GIT_DIFF_HUNK)
    for at, tally in counts.items():
        parts = [f"{sign}{n}" for sign, n in zip("+-~", tally, strict=True) if n]
        out[at] += f" [{' '.join(parts)}]" if parts else ""
    return join(out + (["[... diff truncated — run `git diff` for full output]"] if total >= GIT_DIFF_TOTAL else []), text)


def git_push(text: str) -> str:
    lines = rust_lines(text)
    bad = [i for i, x in enumerate(lines) if re.search(r"(?i)error|fatal|rejected|conflict|denied", x)]
    if bad:
        near = sorted({j for i in bad for j in range(max(0, i - 2), min(len(lines), i + 3))})
        return "\n".join(s for k, j in enumerate(near) for s in ((["..."] if k and j > near[k - 1] + 1 else []) + [lines[j]]))
    if re.search(r"(?i)up[- ]to[- ]date", text):
        return "ok (up to date)"
    found = first(lines, r" -> ") or first(lines, r"\d+ files? changed") or last(lines)
    return join([f"ok {x.strip()}" for x in found], text)


def git_commit(text: str) -> str:
    lines = rust_lines(text)
    return join(first(lines, r"^\[") + last(lines, r"files? changed|insertions?|deletions?"), text)


def git_merge(text: str) -> str:
    lines = full(text)
    if conflicts := where(lines, r"CONFLICT|Automatic merge failed"):
        return "\n".join(conflicts)
    if re.search(r"Already up[- ]to[- ]date", text):
        return "ok (up to date)"
    return join(where(lines, r"Fast-forward|Merge made|files? changed|Updating"), text)


def git_rebase(text: str) -> str:
    lines = full(text)
    return join(where(lines, r"CONFLICT|could not apply") or first(lines, r"Successfully rebased") or last(lines), text)


def git_clone(text: str) -> str:
    lines = without(full(text), r"^(?:remote:|Receiving|Resolving|Unpacking|Updating files)")
    if bad := where(lines, r"(?i)error|fatal"):
        return "\n".join(bad)
    m = re.search(r"Cloning into '([^']+)'", text)
    return f"ok — cloned '{m[1]}'" if m else join(lines, text)


def git_checkout(text: str) -> str:
    lines = full(text)
    if re.search(r"(?i)error|fatal|conflict", text):
        return text
    m = re.search(r"(?:Switched to(?: a new)? branch|Already on) '([^']+)'", text)
    return f"ok — {m[1]}" if m else join(last(lines), text)


@handler("git")
def git(text: str, sub: str) -> str:
    own = {
        "status": git_status, "log": git_log, "diff": git_diff, "show": git_diff, "push": git_push, "pull": git_push, "fetch": git_push,
        "commit": git_commit, "add": git_commit, "merge": git_merge, "rebase": git_rebase, "clone": git_clone,
        "checkout": git_checkout, "switch": git_checkout,
    }
    if sub in ("branch", "stash"):
        return join(cap(rust_lines(text), 30), text)
    return own[sub](text) if sub in own else text


@handler("gh")
def gh(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub in ("pr list", "issue list"):
        rows = [x.split("\t") for x in lines if "\t" in x]
        issue = sub.startswith("issue")
        return join([f"#{r[0]} {r[1 if not issue else 2][:60]} [{r[-2] if not issue else r[1]}]" + (f" @{r[2]}" if not issue else "") for r in rows if len(r) >= 4], text)
    if sub == "pr view":
        cut_at = next((i for i, x in enumerate(lines) if x.strip() == "--"), len(lines))
        body = without(lines[cut_at + 1 :], r"^\s*(?:<!--|!\[|---+\s*$)")
        kept = [x for i, x in enumerate(body) if x.strip() or not (i > 1 and not body[i - 1].strip() and not body[i - 2].strip())]
        return join(where(lines[:cut_at], r"^(?:title|state|author|labels|number|url):") + kept[:20], text)
    if sub == "pr checks":
        failed = [columns(x.replace("\t", "  "))[0] for x in where(lines, r"(?i)\bfail")]
        return join([f"{len(where(lines, r'(?i)\bpass'))} passed, {len(failed)} failed", *failed], text)
    if sub in ("run list", "run view"):
        return join(where(lines, r"(?i)completed|failure|success|in_progress|queued|✓|X "), text)
    return join(last(lines), text) if sub in ("repo clone", "repo fork") else text


@handler("diff")
def diff(text: str, sub: str) -> str:
    out, hunks, context = [], 0, 0
    for x in rust_lines(text):
        if x.startswith("@@") or re.match(r"^\d+(?:,\d+)?[acd]\d+", x):
            hunks, context = hunks + 1, 0
            if hunks <= 5:
                out.append(x)
        elif hunks <= 5:
            plain = hunks and not x.startswith(("+", "-", "<", ">"))
            context += bool(plain)
            if not plain or context <= 2:
                out.append(x)
    return join(out + ([f"[+{hunks - 5} more hunks]"] if hunks > 5 else []), text)
