"""Sources: text, hook events, conversations, transcripts, histories, files, rules and record logs."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsluice.functions import text as T
from textsluice.operators.rules import DEFAULT_RULES, Rule, UserFilter

HOOK = "tool_name string, tool_input string, tool_response struct<output: string, stdout: string, error: string>"
MESSAGE = "array<struct<role: string, content: string>>"
RECORD = (
    "project string, command string, subcommand string, input_tokens long, output_tokens long, ts long, "
    "duration_ms long, cache_hit boolean, agent string, model string"
)
#: What a repository walk leaves out. Fixed values.
SKIP_DIRS = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", "venv")
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "woff", "woff2", "ttf", "exe", "so", "dylib", "dll", "class", "jar", "lock")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: one document a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def hook_events(lines: DataFrame, json: str = "value") -> DataFrame:
    """tool_name, command, payload of JSON events; the payload is the error, else the output, else stdout."""
    row = lines.select(F.from_json(json, HOOK).alias("e")).select("e.*")
    blank = lambda c: F.when(F.trim(c) != "", c)
    r = F.col("tool_response")
    return row.filter("tool_name is not null").select(
        "tool_name",
        F.get_json_object("tool_input", "$.command").alias("command"),
        F.coalesce(blank(r["error"]), blank(r["output"]), r["stdout"]).alias("payload"),
    )


def conversations(docs: DataFrame, json: str = "value", id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a bare array or of ``{"messages": [...]}``; a missing role is user's."""
    array = F.coalesce(F.from_json(F.get_json_object(json, "$.messages"), MESSAGE), F.from_json(json, MESSAGE))
    return docs.select(id_col, F.posexplode(array).alias("turn", "m")).select(
        id_col, "turn", F.coalesce("m.role", F.lit("user")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text")
    )


def transcripts(lines: DataFrame, json: str = "value", id_col: str = "conv_id", order: str = "line_no") -> DataFrame:
    """Messages of a transcript: user and assistant lines, content as text or as the join of its text blocks."""
    kind, content = F.get_json_object(json, "$.type"), F.get_json_object(json, "$.message.content")
    parsed = F.from_json(content, "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(parsed, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return lines.filter(kind.isin("user", "assistant")).select(
        id_col, F.col(order).alias("turn"), kind.alias("role"), F.when(content.startswith("["), joined).otherwise(content).alias("text")
    )


def newest_file(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and time of the file changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("changed"))


def history(lines: DataFrame, json: str = "value", own: str | None = None) -> DataFrame:
    """command (first word), tokens of commands run, without those that start with ``own``."""
    command, output = F.get_json_object(json, "$.tool_input.command"), F.get_json_object(json, "$.tool_response.output")
    rows = lines.select(command.alias("line"), output.alias("output")).filter("line is not null")
    if own:
        rows = rows.filter(~F.col("line").startswith(f"{own} "))
    return rows.select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("command"), T.token_estimate("output").alias("tokens"))


def repository_files(spark: SparkSession, path: str, most: int = 500_000) -> DataFrame:
    """path, text of source files: no hidden, vendored, binary or large ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skipped = F.col("path").rlike(r"/(?:\.[^/]+|" + "|".join(SKIP_DIRS) + ")(?:/|$)") | T.extension("path").isin(*BINARY)
    return files.filter((F.col("length") <= most) & ~skipped).select("path", F.decode("content", "UTF-8").alias("text"))


def records(spark: SparkSession, path: str, format_: str = "parquet") -> DataFrame:
    """A record log; JSON lines of older versions lack columns, which then are null."""
    df = spark.read.schema(RECORD).json(path) if format_ == "json" else spark.read.option("mergeSchema", "true").parquet(path)
    return df.withColumn("project", F.coalesce("project", F.lit(""))).withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def merge_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both logs without repeated records."""
    return a.unionByName(b, allowMissingColumns=True).dropDuplicates(["project", "command", "ts", "input_tokens", "output_tokens"])


def newest_rows(df: DataFrame, order: str, most: int = 20, key: str | None = None) -> DataFrame:
    """Retention: the ``most`` newest rows, per ``key`` where given."""
    if key is None:
        return df.orderBy(F.col(order).desc()).limit(most)
    by = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")


def parse_rules(toml: str) -> dict[str, list[Rule]]:
    """Rules per command of a configuration text; commands it lacks have the default ones."""
    out = dict(DEFAULT_RULES)
    names = {
        "ReplaceWith": "replace", "TruncateLinesAt": "truncate", "HeadLines": "head", "TailLines": "tail", "OnEmpty": "on_empty",
        "MatchOutput": "match_output",
    }
    for command, own in tomllib.loads(toml).get("commands", {}).items():
        rules = []
        for p in own.get("patterns", []):
            action, arg, unless = p["action"], None, None
            if isinstance(action, dict):
                name, arg = next(iter(action.items()))
                if isinstance(arg, dict):
                    arg, unless = arg.get("message"), arg.get("unless")
                action = names[name]
            else:
                action = action.lower()
            rules.append(Rule(p["regex"], action, arg, unless, bool(p.get("strip_ansi", False))))
        if "on_empty" in own:
            rules.append(Rule("", "on_empty", own["on_empty"]))
        out[command] = rules
    return out


def first_config(*candidates: str | None) -> dict:
    """The first text that parses as TOML; empty where none does."""
    for text in candidates:
        if text is None:
            continue
        try:
            return tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            continue
    return {}


def parse_user_filters(toml: str) -> dict[str, UserFilter]:
    out = {}
    for command, f in tomllib.loads(toml).get("commands", {}).items():
        match = f.get("match_output") or {}
        out[command] = UserFilter(
            tuple(f.get("strip_lines_matching", ())), tuple(f.get("keep_lines_matching", ())), match.get("pattern"),
            match.get("message", ""), match.get("unless"), f.get("max_lines"), f.get("on_empty", ""),
        )
    return out


def rules_frame(spark: SparkSession, table: dict[str, list[Rule]]) -> DataFrame:
    rows = [(c, i, r.regex, r.action, None if r.arg is None else str(r.arg), r.unless, r.strip_ansi) for c, rules in table.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "command string, rule_no int, regex string, action string, arg string, unless string, strip_ansi boolean")
