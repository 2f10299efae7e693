"""Extractive summaries of one text: which lines or sentences stay, by their embeddings.

The embedding is pluggable: any function from a list of strings to unit rows. The
default hashes words and their beginnings into DIM dimensions; it is deterministic
and needs no model.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable

import numpy as np

from textsluice.functions.compaction import critical, rust_lines, sentences

DIM = 128
Embed = Callable[[list[str]], np.ndarray]


def hash_embed(texts: list[str]) -> np.ndarray:
    """Unit rows; a text without words is the zero vector."""
    out = np.zeros((len(texts), DIM))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            for part, weight in ((w, 1.0), (w[:4], 0.5)):
                h = zlib.crc32(part.encode())
                out[i, h % DIM] += weight if h >> 31 else -weight
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norms > 1e-9, out / np.maximum(norms, 1e-9), out)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-9 else v


def centroid(rows: np.ndarray) -> np.ndarray:
    return unit(rows.mean(axis=0)) if len(rows) else np.zeros(DIM)


def entropy(rows: np.ndarray) -> float:
    """Mean distance to the centroid; 0 for one row or none."""
    return float((1 - rows @ centroid(rows)).mean()) if len(rows) > 1 else 0.0


def entropy_budget(rows: np.ndarray, most: int) -> int:
    """A share of the budget by how much the lines differ; texts under 200 lines get all of it."""
    if len(rows) < 200:
        return most
    e = entropy(rows[:: max(1, len(rows) // 100)])
    share = 0.05 if e <= 0.10 else 1.0 if e >= 0.35 else 0.05 + (e - 0.10) / 0.25 * 0.95
    return max(1, int(most * share))


def with_gaps(lines: list[str], kept: set[int]) -> str:
    """Kept lines in order with ``[... n lines omitted ...]`` for each gap."""
    out, at = [], 0
    for k in [*sorted(kept), len(lines)]:
        if k > at:
            out.append(f"[... {k - at} lines omitted ...]")
        if k < len(lines):
            out.append(lines[k])
        at = k + 1
    return "\n".join(out)


def _full(lines: list[str]) -> list[int]:
    return [i for i, x in enumerate(lines) if x.strip()]


def _fill(kept: set[int], ranked: list[tuple[int, float]], budget: int, least: float) -> list[int]:
    """Adds the best until the budget is full or scores fall below ``least``; returns what it added."""
    added = []
    for i, score in sorted(ranked, key=lambda x: -x[1]):
        if len(kept) >= budget or score < least:
            break
        if i not in kept:
            added.append(i)
        kept.add(i)
    return added


def summarise(
    text: str,
    budget: int,
    query: str | None = None,
    command: str | None = None,
    history: np.ndarray | None = None,
    embed: Embed = hash_embed,
) -> str:
    """Lines that stand out. Critical lines always stay.

    A query adds relevance (0.5 each), with a command it is blended (0.3 / 0.7);
    ``history`` measures against an earlier centroid instead of the text's own.
    """
    lines = rust_lines(text)
    at = _full(lines)
    if not at or len(lines) <= budget:
        return "\n".join(lines)
    rows = embed([lines[i] for i in at])
    past = history is not None and np.linalg.norm(history) > 1e-9 and query is None
    score = 1 - rows @ (unit(history) if past else centroid(rows))
    least = 0.40
    if query is not None:
        q = embed([query])[0]
        if command is not None:
            q = unit(0.3 * embed([command])[0] + 0.7 * q)
        score, least = 0.5 * score + 0.5 * (rows @ q), 0.30
    floor = least * max(0.0, float(score.max()))
    if past:
        floor = max(floor, 0.10)
    kept = {i for i, x in enumerate(lines) if critical.search(x)}
    _fill(kept, list(zip(at, score.tolist(), strict=True)), budget, floor)
    return with_gaps(lines, kept)


def summarise_anchored(text: str, budget: int, neighbours: int = 1, embed: Embed = hash_embed) -> str:
    """As :func:`summarise`, and for each line chosen the nearest others, in line order."""
    lines = rust_lines(text)
    at = _full(lines)
    if not at or len(lines) <= budget:
        return "\n".join(lines)
    rows = embed([lines[i] for i in at])
    score = 1 - rows @ centroid(rows)
    must = {i for i, x in enumerate(lines) if critical.search(x)}
    kept = set(must)
    chosen = sorted(_fill(kept, list(zip(at, score.tolist(), strict=True)), budget, 0.40 * max(0.0, float(score.max()))))
    place = {i: k for k, i in enumerate(at)}
    extra: set[int] = set()
    for i in chosen:
        if len(must | extra) + len(chosen) >= 2 * budget:
            break
        near = np.argsort(-(rows @ rows[place[i]]), kind="stable")
        extra |= set([at[k] for k in near.tolist() if at[k] not in kept | extra][:neighbours])
    return with_gaps(lines, kept | extra)


def clusters(rows: np.ndarray, least: float = 0.85) -> list[list[int]]:
    """Greedy online clusters: each row joins the best centroid from ``least`` on (ties: the last), or starts one."""
    members: list[list[int]] = []
    centres: list[np.ndarray] = []
    for i, row in enumerate(rows):
        best, which = -2.0, -1
        for k, c in enumerate(centres):
            s = float(row @ c)
            if s >= best:
                best, which = s, k
        if which >= 0 and best >= least:
            members[which].append(i)
            n = len(members[which])
            centres[which] = unit((centres[which] * (n - 1) + row) / n)
        else:
            members.append([i])
            centres.append(row.copy())
    return members


def summarise_clusters(text: str, budget: int, embed: Embed = hash_embed) -> str:
    """One line for each cluster of alike lines, the one farthest from its centre, with ``[n similar]``."""
    lines = rust_lines(text)
    at = _full(lines)
    if not at or len(lines) <= budget:
        return "\n".join(lines)
    rows = embed([lines[i] for i in at])
    overall = centroid(rows)
    kept = {i for i, x in enumerate(lines) if critical.search(x)}
    notes, ranked = {}, []
    for group in clusters(rows):
        centre = centroid(rows[group])
        far = max(group, key=lambda k: (1 - float(rows[k] @ centre), k))
        ranked.append((at[far], 1 - float(centre @ overall)))
        if len(group) > 1:
            notes[at[far]] = len(group) - 1
    _fill(kept, ranked, budget, -1.0)
    shown = [x + (f" [{notes[i]} similar]" if i in kept and i in notes else "") for i, x in enumerate(lines)]
    return with_gaps(shown, kept)


def head_tail(text: str, budget: int) -> str:
    """Half the budget from the top, the rest from the end."""
    lines = rust_lines(text)
    if len(lines) <= budget:
        return "\n".join(lines)
    head = budget // 2
    kept = set(range(head)) | set(range(len(lines) - (budget - head), len(lines)))
    return with_gaps(lines, kept)


def summarise_chunked(text: str, budget: int, most: int = 2000, chunk: int = 500, **how) -> str:
    """Texts over ``most`` lines by chunks, each with its share of the budget; again if too much is left."""
    lines = rust_lines(text)
    if len(lines) <= most:
        return summarise(text, budget, **how)
    parts = [lines[i : i + chunk] for i in range(0, len(lines), chunk)]
    each = max(1, budget // len(parts))
    out = [summarise("\n".join(p), each, **how) for p in parts]
    joined = "\n".join(out)
    if len(rust_lines(joined)) > 1.5 * budget:
        bare = "\n".join(x for x in rust_lines(joined) if not x.startswith("[... "))
        return summarise(bare, budget, **how)
    return joined


def strategy(query: str | None, command: str | None, history: bool) -> str:
    """Which summariser a text gets."""
    if query and command:
        return "intent"
    if query:
        return "query"
    if command:
        return "history" if history else "cluster"
    return "anchored"


#: Word lists that keep a sentence. Fixed values.
USER_WORDS = ("must", "never", "always", "ensure", "make sure", "do not", "don't", "avoid", "required", "critical")
ASSISTANT_WORDS = ("must", "never", "always", "ensure", "required", "critical")


def keep_user_sentence(s: str) -> bool:
    t = s.strip()
    snake = any("_" in w and w[:1].isalpha() for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in t.split()))
    return t.endswith("?") or "`" in t or "::" in t or snake or any(w in t.lower() for w in USER_WORDS)


def keep_assistant_sentence(s: str) -> bool:
    t = s.strip()
    return (
        "`" in t
        or "::" in t
        or t[:1] in ("-", "*")
        or re.match(r"[0-9][.)]", t) is not None
        or re.search(r"[$€£%0-9]", t) is not None
        or any(w in t.lower() for w in ASSISTANT_WORDS)
    )


def summarise_message(text: str, ratio: float, user: bool = True, embed: Embed = hash_embed) -> str:
    """The share ``ratio`` of a message's sentences (rounded up, one at least) that stand out most."""
    own = sentences(text)
    budget = max(1, math.ceil(len(own) * ratio - 1e-9))
    if len(own) <= budget:
        return text
    keep = keep_user_sentence if user else keep_assistant_sentence
    rows = embed(own)
    score = 1 - rows @ centroid(rows)
    kept = {i for i, s in enumerate(own) if keep(s)}
    _fill(kept, list(enumerate(score.tolist())), budget, 0.40 * max(0.0, float(score.max())))
    return " ".join(own[i] for i in sorted(kept))


def accept_generated(original: str, generated: str, fallback: str, least: float = 0.80, embed: Embed = hash_embed) -> str:
    """A generated summary that is close enough to its original; else the extractive one."""
    a, b = embed([original, generated])
    return generated if float(a @ b) >= least else fallback


# --- Web pages and code ----------------------------------------------------------------------

#: Words that raise and lower a section's score. Fixed values.
SECTION_WORDS = (
    "error", "warning", "usage", "example", "note", "tip", "return", "parameter", "argument", "important", "required",
    "optional", "type", "function", "method", "struct", "interface", "class", "const", "fn ", "pub ", "impl ", "```",
)
SECTION_NOISE = (
    "skip to", "copyright", "terms of", "privacy policy", "cookie", "subscribe", "newsletter", "follow us", "share this",
)


def _blocks(text: str, ends: Callable[[str, int], str]) -> list[str]:
    """Stretches of lines; ``ends`` says of a line and the blanks before it: cut, open (cut before it) or stay."""
    out, now, blanks = [], [], 0
    for line in rust_lines(text):
        blanks = blanks + 1 if not line.strip() else 0
        how = ends(line, blanks)
        if how != "stay" and "".join(now).strip():
            out.append("\n".join(now).strip())
            now = []
        if how != "cut":
            now.append(line)
    if "".join(now).strip():
        out.append("\n".join(now).strip())
    return out


def _fixed(text: str, size: int = 40) -> list[str]:
    lines = rust_lines(text)
    return [c for c in ("\n".join(lines[i : i + size]) for i in range(0, len(lines), size)) if c.strip()]


def web_sections(text: str) -> list[str]:
    """By headings and double blanks, else by blanks, else by 40 lines: the first that gives three; none over 60 lines."""
    found = _blocks(text, lambda x, blanks: "cut" if blanks >= 2 else "open" if x.strip().startswith("#") else "stay")
    if len(found) < 3:
        found = _blocks(text, lambda x, blanks: "cut" if blanks else "stay")
    if len(found) < 3:
        found = _fixed(text)
    return [p for s in found for p in (_fixed(s) if len(rust_lines(s)) > 60 else [s])]


def section_score(section: str) -> int:
    low = section.lower()
    return max(0, sum(low.count(w) for w in SECTION_WORDS) - 3 * sum(low.count(w) for w in SECTION_NOISE))


def collapse_section(section: str) -> str:
    head, *body = rust_lines(section) or [""]
    full = [x for x in body if x.strip()]
    rest = [f"[... {len(full) - 3} lines]"] if len(full) > 3 else []
    return "\n".join([head, *full[:3], *rest])


def summarise_section(section: str, embed: Embed = hash_embed) -> str:
    n = len(rust_lines(section))
    return section if n <= 5 or "```" in section else summarise(section, min(20, max(3, n // 3)), embed=embed)


_KINDS = (
    ("Import", re.compile(r"^\s*(?:pub\s+)?(?:use|import|from|extern|#include|require)\b")),
    ("TypeDef", re.compile(r"^\s*(?:export\s+)?(?:pub(?:\([^)]*\))?\s+|public\s+|private\s+)?(?:struct|enum|interface|union|type|typedef)\b")),
    ("Function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+|public\s+|private\s+|static\s+)*(?:async\s+)?(?:fn|func|function|def|class|impl|trait|mod|async)\b")),
)


def section_kind(line: str) -> str:
    return next((k for k, p in _KINDS if p.match(line)), "TopLevel")


def code_sections(text: str, extension: str) -> list[tuple[int, int, str]]:
    """Half-open line ranges (begin, end, kind) of a source file, by its family."""
    lines, cuts = rust_lines(text), [0]
    ext = extension.lower().lstrip(".")
    if ext in ("py", "pyi"):
        kind = section_kind(lines[0]) if lines else "TopLevel"
        for i, x in enumerate(lines[1:], 1):
            if not x.strip() and not lines[i - 1][:1].isspace():
                cuts.append(i + 1)
            elif x[:1].strip() and section_kind(x) != kind:
                cuts.append(i)
            if x[:1].strip():
                kind = section_kind(x)
    elif ext in ("rs", "go", "js", "ts", "tsx", "jsx", "java", "c", "h", "cpp", "cc", "hpp", "cs", "swift", "kt", "scala", "php"):
        depth = 0
        for i, x in enumerate(lines):
            before = depth
            depth = max(0, depth + x.count("{") - x.count("}"))
            if depth == 0 and (before > 0 or not x.strip()):
                cuts.append(i + 1)
    else:
        blanks = 0
        for i, x in enumerate(lines):
            blanks = blanks + 1 if not x.strip() else 0
            if blanks == 2:
                cuts.append(i + 1)
    out = []
    cuts = sorted({c for c in cuts if c <= len(lines)} | {len(lines)})
    for a, b in zip(cuts, cuts[1:], strict=False):
        first = next((x for x in lines[a:b] if x.strip()), None)
        if first is not None:
            out.append((a, b, section_kind(first)))
    return out


def focus_compress(
    text: str, extension: str, goal: np.ndarray, edited: list[tuple[int, int]] | None = None, embed: Embed = hash_embed
) -> tuple[str, list[tuple[int, int, bool]]]:
    """A file with the sections far from ``goal`` reduced to their first line, and (begin, end, preserved) of all.

    Imports, types and edited sections stay; of the rest those from the 40th
    percentile on, half of them at least.
    """
    lines, parts = rust_lines(text), code_sections(text, extension)
    if len(parts) < 2:
        return text, [(a, b, True) for a, b, _ in parts]
    hit = lambda a, b: any(x < b and y >= a for x, y in edited or [])
    open_ = [k for k, (a, b, kind) in enumerate(parts) if kind not in ("Import", "TypeDef") and not hit(a, b)]
    rows = embed(["\n".join(lines[parts[k][0] : parts[k][1]]) for k in open_])
    score = (rows @ goal).tolist() if open_ else []
    keep = set(range(len(parts))) - set(open_)
    if score:
        bound = sorted(score)[min(int(len(score) * 0.4), len(score) - 1)]
        order = sorted(range(len(open_)), key=lambda k: -score[k])
        least = math.ceil(len(open_) / 2)
        keep |= {open_[k] for n, k in enumerate(order) if n < least or score[k] >= bound}
    out, spans = [], []
    for k, (a, b, _) in enumerate(parts):
        spans.append((a, b, k in keep))
        out += lines[a:b] if k in keep else [lines[a], f"[... {b - a - 1} lines ...]"]
    return ("\n".join(out), spans) if len(keep) < len(parts) else (text, spans)


def keep_edited(text: str, edited: list[tuple[int, int]], around: int = 20) -> str:
    """Lines within ``around`` of edited ranges (1-based, inclusive); gaps are counted."""
    lines = rust_lines(text)
    kept = {i for a, b in edited for i in range(max(0, a - 1 - around), min(len(lines), b + around))}
    return with_gaps(lines, kept) if kept else text


def file_baseline(text: str) -> str:
    """Up to 100 lines whole, up to 500 the first 60 and last 20, else the first 80."""
    lines = rust_lines(text)
    if len(lines) <= 100:
        return "\n".join(lines)
    return "\n".join(lines[:60] + lines[-20:] if len(lines) <= 500 else lines[:80])


#: Signature lines per language. Fixed values of each language's syntax.
SIGNATURES = {
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|impl|mod|type|const|static|use)\b",
    "py": r"^\s*(?:async\s+)?(?:def|class)\b|^(?:import|from)\b|^\s*@",
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type|enum|import)\b",
    "go": r"^(?:func|type|package|import|var|const)\b",
    "rb": r"^\s*(?:def|class|module|require|attr_\w+)\b",
    "java": r"^\s*(?:@\w+|(?:public|private|protected|static|final|abstract|class|interface|enum|import|package)\b)",
}
FAMILIES = {
    "rs": "rs", "py": "py", "pyi": "py", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "vue": "js", "svelte": "js",
    "go": "go", "rb": "rb", "java": "java", "kt": "java", "cs": "java", "cpp": "java", "c": "java", "h": "java", "swift": "java", "scala": "java",
}


def signatures(text: str, extension: str) -> str:
    """Signature lines of a source file; function bodies become a count. Empty for data and unknown kinds."""
    ext = extension.lower().lstrip(".")
    family = FAMILIES.get(ext)
    if family is None:
        return ""
    lines = rust_lines(text)
    if ext in ("vue", "svelte"):
        inside = re.search(r"(?s)<script[^>]*>\n?(.*?)</script>", text)
        lines = rust_lines(inside[1]) if inside else []
    wanted, out, skipped = re.compile(SIGNATURES[family]), [], 0
    mark = (lambda n: f"    # ... {n} lines ...") if family in ("py", "rb") else (lambda n: f"    /* {n} lines */")
    for x in lines:
        if wanted.match(x):
            if skipped:
                out.append(mark(skipped))
            out.append(x.rstrip(" {"))
            skipped = 0
        elif x.strip():
            skipped += 1
    return "\n".join(out + ([mark(skipped)] if skipped else []))


def digest(text: str, extension: str) -> str:
    """Signatures, or the first 20 and last 10 lines where there are none."""
    found = signatures(text, extension)
    lines = rust_lines(text)
    if found:
        return found
    return text if len(lines) <= 30 else "\n".join([*lines[:20], f"[... {len(lines) - 30} lines ...]", *lines[-10:]])


def read_level(text: str, level: str, extension: str = "") -> str:
    """A file at a read level: passthrough, strip (comments and blank runs go), aggressive, structural or auto."""
    lines = rust_lines(text)
    if level == "auto":
        level = "passthrough" if len(lines) <= 100 else "strip" if len(lines) <= 500 else "structural"
    if level == "passthrough":
        return text
    if level == "structural":
        return digest(text, extension)
    comment = re.compile(r"^\s*(?:#(?!!|\[|include)|//(?!/)|--\s|;)")
    kept, block = [], False
    for x in lines:
        if block or re.match(r"^\s*/\*(?!\*)", x):
            block = "*/" not in x
            continue
        if comment.match(x):
            continue
        if x.strip() or (level == "strip" and kept and kept[-1].strip()):
            kept.append(x.rstrip())
    if level == "aggressive" and len(kept) > 200:
        return digest("\n".join(kept), extension)
    return "\n".join(kept)
