"""Handlers of files, data, services and the shell."""

from __future__ import annotations

import json
import re

from textsluice.functions.compaction import json_schema, json_shape
from textsluice.functions.summarise import summarise
from textsluice.operators.handlers.base import blocks, cap, cells, columns, cut, full, groups, handler, header_starts, join, last, rust_lines, where, without

ANSI = re.compile("\x1b\\[[0-9;]*[A-Za-z]|\x1b[()][0-9A-Za-z]|\x1b[^\x1b]")
STAMP = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*")


def _third(text: str) -> str:
    n = len(rust_lines(text))
    return summarise(text, min(200, max(20, n // 3)))


@handler("docker", "docker-compose", "podman")
def docker(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if sub in ("logs", "compose logs"):
        return _third("\n".join(STAMP.sub("", ANSI.sub("", x)) for x in lines))
    if sub in ("ps", "container ls"):
        out = []
        for x in lines:
            c = columns(x)
            if len(c) >= 4:
                status = next((y for y in c if re.match(r"(?:Up|Exited|Created|Restarting|Paused|STATUS)", y)), c[-2])
                out.append(f"{c[-1]}  {status}  {c[1]}")
        return join(out, text)
    if sub in ("images", "image ls"):
        out, total = [], 0.0
        for x in lines:
            c = x.split()
            if len(c) < 7 or c[0] == "REPOSITORY":
                continue
            m = re.match(r"([\d.]+)([KMGT]?)B$", c[-1].upper())
            total += float(m[1]) * {"": 1, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12}[m[2]] if m else 0
            out.append(f"{c[0]}:{c[1]}  {c[-1]}")
        return join([*out, f"[total: {total / 1e9:.2f} GB across {len(out)} images]"] if out else [], text)
    if sub in ("build", "buildx build", "compose build"):
        if len(lines) <= 3:
            return text
        return join(where(lines, r"(?i)\berror\b|failed") or last(lines, r"naming to|writing image|Successfully (?:built|tagged)|exporting to image"), text)
    return text


INTERESTING = ("NAME", "NAMESPACE", "STATUS", "READY", "AGE", "RESTARTS", "TYPE", "CLUSTER-IP")
PROBLEMS = r"CrashLoop|Error|BackOff|Pending|Evicted|OOMKilled|Failed|Unhealthy|FailedScheduling|Unknown|Terminating"


def _pods(rows: list[dict[str, str]]) -> list[str]:
    def well(r: dict[str, str]) -> bool:
        ready = re.match(r"^(\d+)/(\d+)$", r.get("READY", ""))
        return r.get("STATUS") in ("Running", "Completed", "Succeeded") and (not ready or ready[1] == ready[2] or r["STATUS"] != "Running")

    bad = [r for r in rows if not well(r)]
    if not bad:
        return [f"[{len(rows)} pods, all healthy]"]
    counts: dict[str, int] = {}
    for r in rows:
        counts[r.get("STATUS", "?")] = counts.get(r.get("STATUS", "?"), 0) + 1
    names = ("NAME", "READY", "STATUS", "RESTARTS")
    return ["  ".join(r.get(k, "") for k in names) for r in bad] + [", ".join(f"{k}: {counts[k]}" for k in sorted(counts))]


@handler("kubectl", "k", "minikube", "kind")
def kubectl(text: str, sub: str) -> str:
    lines = full(text)
    word, _, what = sub.partition(" ")
    if word == "get" and len(lines) > 1:
        names = lines[0].split()
        starts = header_starts(lines[0])
        rows = [dict(zip(names, cells(x, starts), strict=False)) for x in lines[1:]]
        if what.startswith("pod") and "STATUS" in names:
            return "\n".join(_pods(rows))
        if what.startswith("event"):
            return _events(rows)
        shown = [n for n in names if n in INTERESTING] or names[:3]
        return "\n".join(["  ".join(shown), *cap(["  ".join(r.get(n, "") for n in shown) for r in rows], 30)])
    if word == "events":
        names, starts = lines[0].split() if lines else [], header_starts(lines[0]) if lines else []
        return _events([dict(zip(names, cells(x, starts), strict=False)) for x in lines[1:]])
    if word == "logs":
        return _third(text)
    if word == "describe":
        raw = rust_lines(text)
        kept = where(raw, r"^(?:Name|Namespace|Status|Node|IP):")
        kept += blocks(raw, r"^Annotations:", 4, r"^\S") + blocks(raw, r"^(?:Conditions|Containers|Events):", 40, r"^\S")
        return join(dict.fromkeys(kept), text)
    if word in ("apply", "create", "delete", "scale", "rollout"):
        return join(where(lines, r"(?i)created|configured|unchanged|deleted|patched|scaled|error|rolled out"), text)
    return text


def _events(rows: list[dict[str, str]]) -> str:
    bad = [r for r in rows if r.get("TYPE") == "Warning" or re.search(PROBLEMS, r.get("REASON", ""))]
    return "\n".join(cap(["  ".join(r.values()) for r in bad], 20)) or "[no warning events]"


def _rows_of(data: object) -> list | None:
    if isinstance(data, list):
        return data
    if isinstance(data, dict) and len(data) == 1 and isinstance(next(iter(data.values())), list):
        return next(iter(data.values()))
    return None


def _get(row: object, path: str) -> str:
    for key in path.split("."):
        row = row.get(key) if isinstance(row, dict) else None
    return "-" if row in (None, "") else str(row)


#: Fields shown per service: path of the list, and columns. Fixed values.
AWS_TABLES = {
    "ec2 describe-instances": ("Instances", ("InstanceId", "InstanceType", "State.Name", "PrivateIpAddress")),
    "ec2 describe-security-groups": ("SecurityGroups", ("GroupId", "GroupName", "VpcId")),
    "iam list-users": ("Users", ("UserName", "UserId", "CreateDate")),
    "iam list-roles": ("Roles", ("RoleName", "Arn", "CreateDate")),
    "lambda list-functions": ("Functions", ("FunctionName", "Runtime", "MemorySize")),
    "ecs list-services": ("serviceArns", ()),
    "ecs list-clusters": ("clusterArns", ()),
    "s3api list-buckets": ("Buckets", ("Name", "CreationDate")),
}


def _s3_ls(lines: list[str]) -> str:
    sizes = [int(m[1]) for m in (re.match(r"^\S+ \S+\s+(\d+) ", x) for x in lines) if m]
    prefixes = sorted(x.strip() for x in lines if re.match(r"^\s*PRE ", x))
    return "\n".join([*prefixes, f"[{len(sizes)} objects, {sum(sizes)} bytes]"])


@handler("aws", "gcloud", "az")
def aws(text: str, sub: str) -> str:
    if sub == "s3 ls":
        return _s3_ls(full(text))
    if re.search(r"(?i)\berror\b|exception", text[:2000]):
        return text
    try:
        data = json.loads(text)
    except ValueError:
        return text
    if sub == "sts get-caller-identity":
        return f"{_get(data, 'Account')} {_get(data, 'Arn').rsplit('/', 1)[-1]}"
    name, fields = AWS_TABLES.get(sub, (None, ()))
    if name is not None and isinstance(data, dict):
        rows = data.get(name)
        if rows is None and "Reservations" in data:
            rows = [i for r in data["Reservations"] for i in r.get("Instances", [])]
        if rows:
            body = [str(r).rsplit("/", 1)[-1] for r in rows] if not fields else ["\t".join(_get(r, f) for f in fields) for r in rows]
            out = "\n".join((["\t".join(fields)] if fields else []) + cap(body, 25))
            return out if len(out) < len(text) else text
    rows = _rows_of(data)
    if rows and all(isinstance(r, dict) for r in rows):
        out = "\n".join(cap([" ".join(f"{k}={v}" for k, v in list(r.items())[:5] if not isinstance(v, (dict, list))) for r in rows], 25))
        return out if len(out) < len(text) else text
    return json_schema(text)


@handler("curl")
def curl(text: str, sub: str) -> str:
    body = re.split(r"\r?\n\r?\n", text, maxsplit=1)[-1] if text.startswith("HTTP/") else text
    shape = json_schema(body)
    return shape if shape != body else "\n".join(cap([cut(x, 200) for x in rust_lines(text)], 30))


@handler("jq")
def jq(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if len(lines) <= 20:
        return text
    try:
        data = json.loads(text)
    except ValueError:
        return "\n".join([*lines[:60], f"[... {len(lines) - 80} lines ...]", *lines[-20:]]) if len(lines) > 80 else summarise(text, 40)
    if isinstance(data, list):
        return json.dumps(json_shape(data[0]), indent=2) + f"\n[{len(data)} items]" if data else "[]"
    return json_schema(text)


@handler("json")
def json_(text: str, sub: str) -> str:
    return json_schema(text)


def centred(line: str, needle: str, width: int = 120) -> str:
    if len(line) <= width:
        return line
    at = max(0, line.lower().find(needle.lower())) if needle else 0
    begin = max(0, min(at - width // 2, len(line) - width))
    return ("…" if begin else "") + line[begin : begin + width] + ("…" if begin + width < len(line) else "")


@handler("grep", "rg", "ag")
def grep(text: str, sub: str) -> str:
    """``sub`` is the pattern. Matches by file, 100 a file and 200 in all."""
    pairs = [(m[1], f"{m[2]}: {centred(m[3].strip(), sub)}") for m in (re.match(r"^([^:\n]+):(\d+):(.*)$", x) for x in rust_lines(text)) if m]
    if not pairs:
        return join(cap(full(text), 50), text)
    return "\n".join([*groups(pairs, 100, 200), f"[{len(pairs)} matches in {len({p for p, _ in pairs})} files]"])


def _by_folder(paths: list[str], each: int, total: int | None = None) -> list[str]:
    return groups(((p.rsplit("/", 1)[0] if "/" in p else ".", p.rsplit("/", 1)[-1]) for p in paths), each, total, head="{}/ [{}]")


@handler("find", "fd")
def find(text: str, sub: str) -> str:
    paths = full(text)
    if len(paths) <= 50:
        return text
    low, high = min(paths), max(paths)
    n = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    root = low[: low.rfind("/", 0, n) + 1]
    short = [p[len(root) :] for p in paths]
    folders = {p.rsplit("/", 1)[0] if "/" in p else "." for p in short}
    return "\n".join([*_by_folder(short, 5, 50), f"[{len(paths)} total, {len(folders)} dirs]"])


#: Folders and files that listings hide. Fixed values.
HIDDEN = ("node_modules", ".git", "target", "dist", "build", "__pycache__", ".venv", "venv", ".next", ".cache", ".idea", ".DS_Store")


@handler("ls")
def ls(text: str, sub: str) -> str:
    folders, files, hidden = [], [], []
    for x in full(text):
        m = re.match(r"^([d\-lbcps])[rwxsStT\-@+.]{9,}\s+\d+\s+\S+\s+\S+\s+([\d.,KMGT]+)\s+\S+\s+\S+\s+\S+\s+(.+)$", x)
        if re.match(r"^total \d+", x):
            continue
        kind, name = (m[1], m[3]) if m else ("d" if x.endswith("/") else "-", x.strip())
        if name.rstrip("/") in (".", ".."):
            continue
        (hidden if name.rstrip("/") in HIDDEN else folders if kind == "d" else files).append(name.rstrip("/") + ("/" if kind == "d" else ""))
    exts: dict[str, int] = {}
    for f in files:
        if "." in f.strip("."):
            exts[f.rsplit(".", 1)[1]] = exts.get(f.rsplit(".", 1)[1], 0) + 1
    out = cap(folders + files, 40) + [f"[{len(folders)} dirs, {len(files)} files]"]
    if len(exts) >= 3:
        out.append("top: " + ", ".join(f".{e} ×{n}" for e, n in sorted(exts.items(), key=lambda x: (-x[1], x[0]))[:3]))
    return join(out + ([f"[hidden: {', '.join(hidden)}]"] if hidden else []), text)


@handler("tree")
def tree(text: str, sub: str) -> str:
    lines = full(text)
    return text if len(lines) <= 30 else "\n".join([*lines[:25], f"[... {len(lines) - 25} more ...]", *last(lines, r"director(?:y|ies)")])


#: Categories of variables, in order, and names whose values are hidden. Fixed values.
ENV_KINDS = (
    ("Cloud", r"^(?:AWS|GCP|GOOGLE|AZURE|KUBE|DOCKER)"),
    ("Language", r"^(?:PYTHON|NODE|NPM|GO|RUST|CARGO|JAVA|RUBY|GEM|VIRTUAL_ENV|NVM)"),
    ("Tools", r"^(?:EDITOR|VISUAL|PAGER|GIT|SSH|GPG|SHELL|TERM)"),
    ("System", r"^(?:HOME|USER|LOGNAME|LANG|LC_|PWD|OLDPWD|TMPDIR|HOSTNAME|DISPLAY|XDG)"),
)
SECRET = r"(?i)token|secret|passw|api_?key|credential|private|auth"


@handler("env", "printenv")
def env(text: str, sub: str) -> str:
    pairs = []
    for x in full(text):
        name, eq, value = x.partition("=")
        if not eq:
            continue
        if re.search(SECRET, name):
            value = "***"
        elif name == "PATH" and value.count(":") >= 4:
            parts = value.split(":")
            value = f"{':'.join(parts[:3])}:… [{len(parts)} entries]"
        kind = "PATH" if name == "PATH" else next((k for k, p in ENV_KINDS if re.match(p, name)), "Other")
        pairs.append((kind, f"{name}={cut(value, 100)}"))
    out = []
    for kind in ("PATH", *(k for k, _ in ENV_KINDS), "Other"):
        own = [v for k, v in pairs if k == kind]
        if own:
            out += [f"[{kind}]", *cap(own, 10 if kind == "Other" else len(own))]
    return join(out, text)


PARTS = (
    (re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), "<TS>"),
    (re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"), "<UUID>"),
    (re.compile(r"\b0x[0-9a-fA-F]{6,}\b"), "<HEX>"),
    (re.compile(r"\b\d{6,}\b"), "<NUM>"),
    (re.compile(r"(?:/[\w.\-]+){3,}"), "<PATH>"),
)


@handler("log")
def log(text: str, sub: str) -> str:
    counts: dict[str, int] = {}
    sample: dict[str, str] = {}
    for x in full(text):
        key = x
        for pattern, name in PARTS:
            key = pattern.sub(name, key)
        counts[key] = counts.get(key, 0) + 1
        sample.setdefault(key, x)
    if not counts:
        return text
    out = cap([sample[k] + (f"  [×{n}]" if n > 1 else "") for k, n in counts.items()], 200)
    for title, word, most in (("errors", r"(?i)error|fatal|panic", 10), ("warnings", r"(?i)warn", 5)):
        top = sorted((k for k in counts if re.search(word, k)), key=lambda k: -counts[k])[:most]
        if top:
            out += [f"[top {title}]", *(f"  {counts[k]}× {cut(k, 120)}" for k in top)]
    return "\n".join(out)


@handler("psql", "pgcli")
def psql(text: str, sub: str) -> str:
    lines = full(text)
    if bad := where(lines, r"^(?:ERROR|FATAL|psql: error)"):
        return "\n".join(bad)
    rows = without(lines, r"^[\s+|\-]+$")
    count, rows = last(rows, r"^\(\d+ rows?\)"), without(rows, r"^\(\d+ rows?\)")
    table = ["\t".join(c.strip() for c in x.strip("|").split("|")) for x in rows]
    return join([*table[:21], *([f"[+{len(table) - 21} more rows]"] if len(table) > 21 else []), *count], text)


@handler("journalctl")
def journalctl(text: str, sub: str) -> str:
    return _third(text)


@handler("cat", "bat")
def cat(text: str, sub: str) -> str:
    lines = rust_lines(text)
    if len(lines) <= 100:
        return text
    return "\n".join([*lines[:60], f"[... {len(lines) - 80} lines ...]", *lines[-20:]]) if len(lines) <= 500 else summarise(text, 80)


@handler("python", "python3")
def python(text: str, sub: str) -> str:
    lines = rust_lines(text)
    head = [x for x in lines if x.strip()][:10]
    if where(lines, r"^Slide \d+"):
        return join(blocks(lines, r"^Slide \d+", 10, r"^Slide \d+"), text)
    if where(head, r"^(?:Paragraph|Heading) ?\d*:"):
        return join(cap(full(text), 50), text)
    if where(head, r"^Sheet:"):
        return join(blocks(lines, r"^Sheet:", 10, r"^Sheet:"), text)
    widths = {len(columns(x)) for x in head}
    if len(head) >= 3 and len(widths) == 1 and widths.pop() >= 3:
        body = full(text)
        return "\n".join([*(cut(x, 120) for x in body[:11]), f"[{len(body) - 1} total rows × {len(columns(body[0]))} cols]"])
    if len(lines) <= 50:
        return text
    at = next((i for i, x in enumerate(lines) if x.startswith("Traceback")), None)
    return "\n".join(lines[at:]) if at is not None else summarise(text, 40)


@handler("(glob)")
def glob(text: str, sub: str) -> str:
    paths = full(text)
    return text if len(paths) <= 20 else "\n".join([*_by_folder(paths, 10), f"[{len(paths)} paths]"])


@handler("(grep)")
def grep_tool(text: str, sub: str) -> str:
    return text if len(rust_lines(text)) <= 10 else grep(text, sub)


def search_results(text: str, intent: str) -> str:
    """Results split at bullets; of more than eight those nearest the intent, in their order."""
    from textsluice.functions.summarise import hash_embed

    items = re.split(r"(?m)^(?=\s*(?:[-*•]|\d+[.)])\s)", text)
    head, items = items[0], items[1:]
    if len(items) <= 8:
        return text
    rows = hash_embed([*items, intent])
    best = sorted(range(len(items)), key=lambda i: (-float(rows[i] @ rows[-1]), i))[:8]
    return head + "".join(items[i] for i in sorted(best)) + f"[{len(items) - 8} more results]"


@handler("(websearch)")
def web_search(text: str, sub: str) -> str:
    return search_results(text, sub)


@handler("(webfetch)")
def web_fetch(text: str, sub: str) -> str:
    """The better half of a page's sections summarised, the others collapsed to their beginnings."""
    from textsluice.functions.summarise import collapse_section, section_score, summarise_section, web_sections

    parts = web_sections(text)
    if len(parts) < 3:
        return text
    scores = [section_score(p) for p in parts]
    bound = sorted(scores)[len(scores) // 2]
    return "\n\n".join(summarise_section(p) if s >= bound and s > 0 else collapse_section(p) for p, s in zip(parts, scores, strict=True))


