"""Scalar text functions as column expressions.

Character classes follow Unicode (``(?U)``), lengths in bytes and in characters
are kept apart, and lines are what ``\\n`` separates, without a closing ``\\r`` and
without an empty line after the last ``\\n``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that hold one of these are never dropped. Fixed values.
CRITICAL = r"(?i)(error|warning|warn|failed|failure|fatal|panic|exception|critical)"
#: The noise learner's own list, which lacks warn and failure. Fixed values.
NOISE_CRITICAL = r"(?i)(error|warning|failed|fatal|panic|exception|critical)"

ANSI = "\x1b\\[[0-9;]*[A-Za-z]|\x1b[()][0-9A-Za-z]|\x1b[^\x1b]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_previous(values: Column) -> Column:
    """Array of (x, before): each element and the one before it, null for the first."""
    return let(
        values,
        lambda v: F.zip_with(
            v,
            F.concat(F.array(F.lit(None)), F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))),
            lambda x, y: F.struct(x.alias("x"), y.alias("before")),
        ),
    )


def lines(text: Column | str) -> Column:
    """Array of lines; empty for null and empty text."""
    t = _c(text)
    cut = F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(
        F.transform(cut, lambda x: F.regexp_replace(x, "\r\\z", ""))
    )


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+\z", "")


def rtrim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)\s+\z", "")


def is_blank(x: Column | str) -> Column:
    return ~_c(x).rlike(r"(?U)\S")


def strip_ansi(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), ANSI, "")


def strip_docker_timestamp(x: Column | str) -> Column:
    """A leading ISO timestamp, as container logs carry it, and the white space after it."""
    return F.regexp_replace(_c(x), r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*", "")


def is_critical(x: Column | str, extra: list[str] | None = None) -> Column:
    """Whether a line must stay; ``extra`` adds patterns of the user's."""
    pattern = CRITICAL if not extra else "|".join([f"(?:{CRITICAL})", *(f"(?:{p})" for p in extra)])
    return _c(x).rlike(pattern)


def token_estimate(x: Column | str) -> Column:
    """A quarter of the bytes, rounded up: what oracle-checked queries count as tokens."""
    return F.ceil(F.octet_length(F.coalesce(_c(x), F.lit(""))) / 4).cast("long")


def truncate_chars(x: Column | str, most: int, mark: str = "…") -> Column:
    c = _c(x)
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def centred(x: Column | str, needle: Column | str, width: int = 120) -> Column:
    """About ``width`` characters around the first match, with ``…`` where text was cut."""
    c, n = _c(x), _c(needle)
    at = F.instr(F.lower(c), F.lower(n))
    begin = F.greatest(F.lit(1), F.when(at > 0, at - width // 2).otherwise(1))
    part = F.substring(c, begin, F.lit(width))
    out = F.concat(F.when(begin > 1, "…").otherwise(""), part, F.when(begin + width - 1 < F.char_length(c), "…").otherwise(""))
    return F.when(F.char_length(c) <= width, c).otherwise(out)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)/*$", 1)


def parent_dir(path: Column | str) -> Column:
    """The folder of a path; ``.`` where it has none."""
    folder = F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)
    return F.when(_c(path).contains("/"), F.when(folder == "", "/").otherwise(folder)).otherwise(".")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([A-Za-z0-9_+-]+)$", 1))


def compact_path(path: Column | str, most: int = 50) -> Column:
    """Longer paths as ``first/.../parent/name``."""
    p = _c(path)
    parts = F.split(p, "/")
    short = F.concat_ws("/", F.element_at(parts, 1), F.lit("..."), F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1))
    return F.when((F.char_length(p) > most) & (F.size(parts) > 3), short).otherwise(p)


def common_prefix_dir(paths: Column) -> Column:
    """The folder that all paths of an array share, with its closing slash; empty where none."""
    return let(F.struct(F.array_min(paths).alias("low"), F.array_max(paths).alias("high")), _shared_dir)


def _shared_dir(ends: Column) -> Column:
    low, high = ends["low"], ends["high"]
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.char_length(low), F.lit(1))),
        F.lit(0),
        lambda s, i: F.when((s == i - 1) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))) & (F.char_length(low) >= i), i).otherwise(s),
    )
    return F.regexp_extract(F.substring(low, F.lit(1), n), r"^(.*/)", 1)


def grep_fields(line: Column | str) -> Column:
    """Struct (path, line_no, match) of ``path:12:text``; null path where a line is none."""
    c = _c(line)
    ok = c.rlike(r"^[^:\n]+:\d+:")
    take = lambda k: F.when(ok, F.regexp_extract(c, r"^([^:\n]+):(\d+):(.*)$", k))
    return F.struct(take(1).alias("path"), take(2).cast("int").alias("line_no"), take(3).alias("match"))


def docker_size(x: Column | str) -> Column:
    """Bytes of ``12.3MB``; units are powers of 1000, unknown ones give null."""
    c = F.upper(trim(x))
    number = F.regexp_extract(c, r"^([\d.]+)\s*[KMGT]?B$", 1).try_cast("double")
    unit = F.regexp_extract(c, r"([KMGT]?)B$", 1)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return number * scale


def words(x: Column | str) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(trim(x), r"(?U)\s+"), lambda w: w != "")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common words; two texts without words are alike."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    all_ = F.size(F.array_union(x, y))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / all_)


#: Log line parts replaced before lines are compared, in this order. Fixed values.
LOG_PARTS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TS>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\b0x[0-9a-fA-F]{6,}\b", "<HEX>"),
    (r"\b\d{6,}\b", "<NUM>"),
    (r"(?:/[\w.\-]+){3,}", "<PATH>"),
)

#: What changes from run to run. Fixed values.
TEMPORAL = "|".join(
    (
        r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?",
        r"\d{2}:\d{2}:\d{2}(\.\d+)?",
        r"\d{2}:\d{2}",
        r"\b\d{10,13}\b",
        r"\b\d+(\.\d+)?\s*(ms|µs|ns|seconds?|mins?|hours?)",
        r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
        r"\b[0-9a-f]{40}\b",
        r"\b0x[0-9a-f]{6,}\b",
        r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    )
)


def normalize_log(line: Column | str) -> Column:
    out = _c(line)
    for pattern, name in LOG_PARTS:
        out = F.regexp_replace(out, pattern, name)
    return out


def strip_temporal(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), TEMPORAL, "")


def noise_key(line: Column | str) -> Column:
    """Trimmed, lower case, runs of four or more progress characters as one mark."""
    return F.regexp_replace(F.lower(trim(line)), r"[=>\-<|\[\] ]{4,}", "[progress]")


def command_key(raw: Column | str, wrappers: tuple[str, ...] = ()) -> Column:
    """A command for display: without environment assignments, ``wrappers`` and folder; else ``(pipeline)``."""
    c = _c(raw)
    tokens = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    bare = F.regexp_replace(F.array_join(tokens, " "), r"^(?:[A-Z_]+=\S*(?: |$))+", "")
    for name in wrappers:
        bare = F.regexp_replace(bare, rf"^{name} ", "")
    first, rest = F.regexp_extract(bare, r"^(\S*)", 1), F.regexp_extract(bare, r"^\S*(.*)$", 1)
    return (
        F.when(c.isNull() | c.isin("(read)", "(glob)", *wrappers) | (bare == ""), "(pipeline)")
        .otherwise(F.concat(basename(first), rest))
    )


def format_tokens(n: Column | str) -> Column:
    c = _c(n)
    return (
        F.when(c >= 1_000_000, F.format_string("%.1fM", c / 1_000_000))
        .when(c >= 1_000, F.format_string("%.1fk", c / 1_000))
        .otherwise(c.cast("long").cast("string"))
    )


def format_cost(x: Column | str) -> Column:
    return F.when(_c(x) < 0.01, "< $0.01").otherwise(F.format_string("$%.2f", _c(x)))


def format_duration(ms: Column | str) -> Column:
    c = _c(ms)
    return F.when(c < 1000, F.format_string("%dms", c.cast("long"))).otherwise(F.format_string("%.1fs", c / 1000))


def format_age(seconds: Column | str) -> Column:
    c = _c(seconds).cast("long")
    return (
        F.when(c < 60, F.format_string("%ds", c))
        .when(c < 3600, F.format_string("%dm", F.floor(c / 60).cast("long")))
        .when(c < 86400, F.format_string("%dh", F.floor(c / 3600).cast("long")))
        .otherwise(F.format_string("%dd", F.floor(c / 86400).cast("long")))
    )


def utc_day(seconds: Column | str) -> Column:
    """YYYY-MM-DD of unix seconds, whatever the session's time zone; years from 10000 on without Spark's plus sign."""
    return F.ltrim(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_c(seconds) / 86_400).cast("int")).cast("string"), F.lit("+"))


def clean_intent(text: Column | str, most: Column | int) -> Column:
    """First sentence of a message without markup, cut at ``most`` characters."""
    bare = trim(F.translate(_c(text), "*`#>", ""))
    return trim(F.regexp_extract(F.substring(bare, F.lit(1), most if isinstance(most, Column) else F.lit(most)), r"(?s)^([^.!?]*[.!?]?)", 1))


#: Role rules of file paths, first match wins. Fixed values.
ROLES = (
    ("entry_point", 0.9, r"^(main\.(rs|py|go|ts|js)|index\.(ts|js|tsx|jsx)|app\.(py|ts|js|rs))$|^server\.", r"/cmd/|/bin/"),
    ("test", 0.9, r"(_test\.(rs|go|py)|_spec\.(ts|js)|\.test\.(ts|js))$|^test_", r"/tests/|/test/|/spec/"),
    ("persistence", 0.8, None, r"db|migration|schema|model|repository"),
    ("state_manager", 0.7, None, r"store|state|reducer|context"),
    ("config", 0.7, r"\.(toml|yaml|yml)$|\.env|^config\.", None),
)


def file_role(path: Column | str) -> Column:
    """Struct (role, confidence) of a path."""
    low = F.lower(_c(path))
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    out = None
    for role, sure, by_name, by_path in ROLES:
        hit = F.lit(False)
        if by_name:
            hit = hit | name.rlike(by_name)
        if by_path:
            hit = hit | low.rlike(by_path)
        value = F.struct(F.lit(role).alias("role"), F.lit(sure).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("general").alias("role"), F.lit(0.5).alias("confidence")))


def is_noise_path(path: Column | str) -> Column:
    """Prose, test data, documentation and shallow example folders."""
    p = F.lower(F.regexp_replace(_c(path), r"\\", "/"))
    prose = p.rlike(r"\.(md|mdx|rst|adoc|asciidoc|txt)$")
    anywhere = p.rlike(r"/(testdata|test-data|fixtures?|docs?|documentation|docs_src|e2e|benchmarks?|website|paradox|i18n)/")
    shallow = p.rlike(r"^[^/]*/(examples?|samples?)/")
    top = p.rlike(r"^(testdata|samples|examples|docs?|docs_src|fixtures|benchmarks|website)/")
    return prose | anywhere | shallow | top | p.rlike(r"[-_]docs(/|$)")


def query_tokens(text: Column | str) -> Column:
    """Lower-case tokens of letters, digits and ``_`` with two bytes or more, in order."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) >= 2)


def camel_parts(token: Column) -> Column:
    """Lower-case parts of a camelCase token."""
    marked = F.regexp_replace(token, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), F.lower), lambda t: F.octet_length(t) >= 2)


def _with_parts(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda t: F.octet_length(t) >= 2)
    return F.array_distinct(F.concat(F.transform(kept, F.lower), F.flatten(F.transform(kept, camel_parts))))


def signature_tokens(text: Column | str) -> Column:
    return _with_parts(F.split(_c(text), r"[^\p{L}\p{N}_]+"))


def path_tokens(path: Column | str) -> Column:
    return _with_parts(F.split(_c(path), r"[/\\._-]"))


def lexical_score(tokens: Column, signatures: Column, paths: Column) -> Column:
    """Share of query tokens met in signatures (1), paths (0.8) and as beginnings (0.3), at most 1."""

    def one(t: Column, known: Column) -> Column:
        sigs, parts = known["s"], known["p"]
        begins = F.exists(sigs, lambda s: s.startswith(t)) | F.exists(parts, lambda s: s.startswith(t))
        return (
            F.when(F.array_contains(sigs, t), 1.0).otherwise(0.0)
            + F.when(F.array_contains(parts, t), 0.8).otherwise(0.0)
            + F.when((F.octet_length(t) >= 4) & begins, 0.3).otherwise(0.0)
        )

    total = let(
        F.struct(signatures.alias("s"), paths.alias("p")),
        lambda known: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + one(t, known)),
    )
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.least(F.lit(1.0), total / (F.size(tokens) * 2.1)))


def has_key_fact(answer: Column | str, facts: Column | str) -> Column:
    """Whether any fact occurs in the answer, in any case."""
    return let(F.lower(_c(answer)), lambda low: F.exists(_c(facts), lambda f: low.contains(F.lower(f))))
