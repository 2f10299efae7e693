"""The registered queries of the engine's own operators, with oracle SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsluice.functions import hashing as H
from textsluice.functions import text as T
from textsluice.functions import vectors as V
from textsluice.functions.compaction import collapse_similar, compact_traces, per_text
from textsluice.operators import analytics as A
from textsluice.operators import convo as C
from textsluice.operators import graph as G
from textsluice.operators import lines as L
from textsluice.operators import logs as J
from textsluice.operators import router as R
from textsluice.operators import semantic as M
from textsluice.operators import session as S
from textsluice.operators.handlers import handled
from textsluice.operators.rules import DEFAULT_RULES, Rule, UserFilter, apply_rules, line_rules, should_remove, user_filter
from textsluice.plans.pipeline import reduce_text
from textsluice.plans.tables import CEN, DOT, ENT, LIN, REC, entries, lines, messages, records, seconds, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


# --- Flagship --------------------------------------------------------------------------------

RTRIM = r"regexp_replace(line, '\s+$', '')"
NORM = rf"""{LIN}, tr as (select doc_id, line_no, {RTRIM} as line from lin
), dd as (select * from (select *, lag(line) over (partition by doc_id order by line_no) as b from tr) where b is null or b <> line
), nb as (select * from (select *, lag(line = '') over (partition by doc_id order by line_no) as pb from dd) where not (line = '' and coalesce(pb, false)))"""


@query(
    f"""with {NORM}, i as (select doc_id, count(*) as n from lin group by doc_id), o as (select doc_id, count(*) as n from nb group by doc_id)
select lang, count(*) as docs, sum(coalesce(i.n, 0))::bigint as lines_in, sum(coalesce(o.n, 0))::bigint as lines_out
from documents left join i using (doc_id) left join o using (doc_id) group by lang"""
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after normalisation and the default noise rules, per language."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    kept = reduce_text(F.col("text"), drop_noise=False)
    return docs.select("lang", F.size(T.lines("text")).alias("a"), F.size(kept).alias("b")).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("a").alias("lines_in"), F.sum("b").alias("lines_out")
    )


# --- Lines -----------------------------------------------------------------------------------


@query(f"with {LIN} select doc_id, count(*) as n_lines, sum(length(line))::bigint as n_chars from lin group by doc_id")
def lines_explode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


@query(rf"with {LIN} select doc_id, count(*) as n, sum(length({RTRIM}))::bigint as n_chars from lin group by doc_id")
def whitespace_rtrim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trim_right(lines(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("n_chars"))


@query(f"with {LIN}, d as (select *, lag(line) over (partition by doc_id order by line_no) as b from lin) select doc_id, line_no, line from d where b is null or b <> line")
def dedup_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dedup_consecutive(lines(spark, sf_dir))


@query(
    rf"""with {LIN}, d as (select *, not regexp_matches(line, '\S') as blank from lin), e as (select *, lag(blank) over (partition by doc_id order by line_no) as pb from d)
select doc_id, line_no, line from e where not (blank and coalesce(pb, false))"""
)
def blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapse_blanks(lines(spark, sf_dir))


@query(f"with {NORM} select doc_id, line_no, line from nb")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalize_lines(lines(spark, sf_dir))


@query(r"select doc_id, regexp_replace(chr(27) || '[31m' || text || chr(27) || '[0m', '\x1b\[[0-9;]*[A-Za-z]|\x1b[()][0-9A-Za-z]|\x1b[^\x1b]', '', 'g') as text from documents")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_ansi(coloured).alias("text"))


RULES_SQL = r"""case when trim(line) = '' then null
  when regexp_matches(t, '^\s*(?:[\[(]\s*[=\-#*>▓░▒]{3,}[\s=\-#*>▓░▒]*[\])]|[=\-#*>]{8,})\s*\d{0,3}\.?\d*\s*%?\s*$') then 'progress_bar'
  when regexp_matches(t, '(?i)^\s*(downloading|fetching|pulling|pushing|receiving objects|resolving deltas|writing objects|counting objects|compressing objects|remote:)\s') then 'download'
  when regexp_matches(t, '^\s*[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏|/\\\-]\s*$') then 'spinner'
  when regexp_matches(t, '^\s*\d{1,3}(\.\d+)?\s*%\s*(done|complete|completed|of \d+)?\s*$') then 'percent'
  when regexp_matches(t, '^\s*\d+\s*/\s*\d+\s*$') then 'ratio'
  when regexp_matches(t, '^(?:\s*[─═━\-=*#~+_▓░▒·•]){10,}\s*$') then 'decorator'
  when regexp_matches(line, '^\s{2,}(Compiling|Checking|Fresh)\s+\S') then 'build_progress' end"""
#: Lines of every kind for the noise rules, made from events. Fixed values.
NOISY = (
    "[=====>    ] 45%", "Downloading crates ...", "|", "  50% done", "3/10", "-----==========*****", "    Compiling serde v1.0", "error: real line", "",
)
_NOISY_SQL = "[" + ", ".join(f"'{x}'" for x in NOISY) + "]"
MIXED_SQL = f"mix as (select user_id as doc_id, event_id as line_no, {_NOISY_SQL}[event_id % {len(NOISY)} + 1] as line from events), mx as (select *, trim(line) as t from mix)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user with noise lines in turn."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("line_no"),
        F.get(F.array(*map(F.lit, NOISY)), (F.col("event_id") % len(NOISY)).cast("int")).alias("line"),
    )


@query(f"with {MIXED_SQL} select doc_id, line_no, line from mx where {RULES_SQL} is null")
def global_rules_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_global_noise(_mixed(spark, sf_dir))


@query(
    f"with {MIXED_SQL}, {LIN}, al as (select line, trim(line) as t from lin union all select line, t from mx), h as (select {RULES_SQL} as rule from al) "
    "select rule, count(*) as n from h where rule is not null group by rule"
)
def global_rules_hits_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lines(spark, sf_dir).select("line").unionByName(_mixed(spark, sf_dir).select("line"))
    return every.select(L.global_rule().alias("rule")).filter("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))


def _log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: per user and day the event types in order, one a line."""
    e = table(spark, sf_dir, "events")
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.array_join(F.transform(ordered, lambda x: x["event_type"]), "\n").alias("text")
    ).select("user_id", "day", "text")


LOG_SQL = "lg as (select user_id, strftime(ts::date, '%Y-%m-%d') as day, event_id, event_type as line from events)"


def _rule_query(rules: list[Rule], on_empty: str | None = None) -> Query:
    return lambda spark, sf_dir: _log_docs(spark, sf_dir).select("user_id", "day", apply_rules("text", rules, on_empty).alias("text"))


@query(f"with {LOG_SQL} select user_id, day, coalesce(string_agg(line, chr(10) order by event_id) filter (line <> 'view'), '') as text from lg group by user_id, day")
def pattern_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("^view$", "remove")])(spark, sf_dir)


@query(
    f"""with {LOG_SQL}, r as (select *, (line = 'click')::int as c, lag((line = 'click')::int) over (partition by user_id, day order by event_id) as p from lg
), g as (select *, sum(case when p is null or p <> c then 1 else 0 end) over (partition by user_id, day order by event_id) as run from r
), o as (select user_id, day, run, min(event_id) as pos, case when min(c) = 1 then '[' || count(*) || ' matching lines collapsed]' else string_agg(line, chr(10) order by event_id) end as line from g group by user_id, day, run)
select user_id, day, string_agg(line, chr(10) order by pos) as text from o group by user_id, day"""
)
def pattern_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("^click$", "collapse")])(spark, sf_dir)


@query(f"with {LOG_SQL} select user_id, day, string_agg(case when line = 'purchase' then '[bought]' else line end, chr(10) order by event_id) as text from lg group by user_id, day")
def pattern_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("^purchase$", "replace", "[bought]")])(spark, sf_dir)


@query(f"with {LOG_SQL} select user_id, day, string_agg(case when length(line) > 4 then substr(line, 1, 4) || '…' else line end, chr(10) order by event_id) as text from lg group by user_id, day")
def pattern_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule(".", "truncate", 4)])(spark, sf_dir)


_NTH = "row_number() over (partition by user_id, day order by event_id) as a, row_number() over (partition by user_id, day order by event_id desc) as z"


@query(f"with {LOG_SQL}, n as (select *, {_NTH} from lg) select user_id, day, string_agg(line, chr(10) order by event_id) as text from n where a <= 3 group by user_id, day")
def pattern_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("", "head", 3)])(spark, sf_dir)


@query(f"with {LOG_SQL}, n as (select *, {_NTH} from lg) select user_id, day, string_agg(line, chr(10) order by event_id) as text from n where z <= 3 group by user_id, day")
def pattern_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("", "tail", 3)])(spark, sf_dir)


@query(
    f"""with {LOG_SQL} select user_id, day, case when bool_or(line = 'signup') and not bool_or(line = 'error') then '[new user]'
else string_agg(line, chr(10) order by event_id) end as text from lg group by user_id, day"""
)
def pattern_match_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("^signup$", "match_output", "[new user]", unless="^error$")])(spark, sf_dir)


@query(
    f"""with {LOG_SQL}, k as (select user_id, day, coalesce(string_agg(line, chr(10) order by event_id) filter (line = 'error'), '') as text from lg group by user_id, day)
select user_id, day, case when text = '' then '(no errors)' else text end as text from k"""
)
def pattern_on_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query([Rule("^(?!error$)", "remove")], "(no errors)")(spark, sf_dir)


@query(f"with {LOG_SQL} select user_id, day, count(*) filter (line in ('view', 'click')) as n from lg group by user_id, day")
def pattern_should_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("^view$", "remove"), Rule("^click$", "remove")]
    n = F.size(F.filter(T.lines("text"), lambda x: should_remove(rules, x))).cast("long")
    return _log_docs(spark, sf_dir).select("user_id", "day", n.alias("n"))


@query(
    f"""with {LOG_SQL}, r as (select *, {_NTH}, count(*) over (partition by user_id, day) as n from lg where line <> 'view')
select user_id, day, string_agg(line, chr(10) order by event_id) as text from r where a <= 5 group by user_id, day
union all select user_id, day, '(nothing)' from lg group by user_id, day having bool_and(line = 'view')"""
)
def user_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = UserFilter(strip=("^view$",), keep=(".",), max_lines=5, on_empty="(nothing)")
    return _log_docs(spark, sf_dir).select("user_id", "day", user_filter("text", f).alias("text"))


@query(
    f"""with {LIN}, n as (select *, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by line_no) as a from lin)
select doc_id, line_no, case when n > 6 and a = 4 then '[--- ' || (n - 6) || ' more lines ---]' else line end as line from n where n <= 6 or a <= 4 or a > n - 3"""
)
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.head_tail(lines(spark, sf_dir), 3, 3)


@query(
    r"""select doc_id, case when strlen(text) > 2000 then substr(text, 1, 2000) || chr(10) || '[--- input truncated: kept 1k of ' || (strlen(text) // 1024) || 'k chars ---]' else text end as text from documents"""
)
def input_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.input_ceiling("text", 2000).alias("text"))


@query(r"select doc_id, case when strlen(text) > 5120 then substr(text, 1, 5120) || chr(10) || '[--- output capped at 5k chars ---]' else text end as text from documents")
def output_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.output_cap("text", 5120).alias("text"))


@query(f"with {MIXED_SQL} select doc_id, 1 - count(*) filter ({RULES_SQL} is null) / count(*) > 0.8 as skip_semantic from mx group by doc_id")
def removal_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _mixed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("a"), F.count_if(L.global_rule().isNull()).alias("b"))
    return per.select("doc_id", L.removal_gate(F.col("a"), F.col("b")).alias("skip_semantic"))


@query(
    r"""select page_id, case when regexp_matches(html, '^\s*(\{|\[|<\?|<!DOCTYPE|<!--|#!/)') then true else false end as passthrough from pages"""
)
def web_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.filter(F.transform(T.lines("html"), T.trim), lambda x: x != ""), F.lit(0))
    hit = first.rlike(r"^(\{|\[|<\?|<!DOCTYPE|<!--|#!/)")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(hit, F.lit(False)).alias("passthrough"))


@query()
def rules_default_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default rules of every command over the same noisy logs."""
    logs = _mixed(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return logs.select("doc_id", *(F.size(line_rules(T.lines("text"), r)).alias(c) for c, r in DEFAULT_RULES.items()))


# --- JSON logs and errors --------------------------------------------------------------------


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON log lines, one log a user."""
    level = F.when(F.col("event_type") == "error", "ERR").when(F.col("event_type") == "purchase", "warning").when(F.col("event_type") == "view", "debug").otherwise("info")
    row = F.to_json(F.struct(level.alias("level"), F.concat(F.col("event_type"), F.lit(" by user")).alias("msg"), F.col("props").alias("err")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), row.alias("line"))


JSN = """jsn as (select user_id as doc_id, event_id as line_no, event_type || ' by user' as message, props as error,
  case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'view' then 'DEBUG' else 'INFO' end as level from events)"""


@query(f"with {JSN} select doc_id, count(*) as full_lines, count(*) as objects, true as has_level, count(*) >= 3 as is_json_log from jsn group by doc_id")
def jsonlog_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.json_log_documents(_json_lines(spark, sf_dir))


@query(f"with {JSN} select doc_id, level, count(*) as n, count(distinct message) as messages, min(error) as first_error from jsn group by doc_id, level")
def jsonlog_compact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.json_records(_json_lines(spark, sf_dir)).groupBy("doc_id", "level").agg(
        F.count("*").alias("n"), F.count_distinct("message").alias("messages"), F.min("error").alias("first_error")
    )


@query(
    f"""with {JSN}, i as (select *, substr(message, 1, 20) as k from jsn where level = 'INFO'), c as (select *, lag(k) over (partition by doc_id order by line_no) as p from i
), g as (select *, sum(case when p is null or p <> k then 1 else 0 end) over (partition by doc_id order by line_no) as run_no from c
), n as (select *, row_number() over (partition by doc_id, run_no order by line_no) as place, greatest(count(*) over (partition by doc_id, run_no) - 3, 0) as omitted from g)
select doc_id, line_no, run_no::bigint as run_no, place, omitted from n where place <= 3"""
)
def jsonlog_info_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.info_runs(J.json_records(_json_lines(spark, sf_dir))).select("doc_id", "line_no", "run_no", "place", "omitted")


@query(f"with {JSN} select doc_id, level, message, min(line_no) as line_no from jsn group by doc_id, level, message")
def ndjson_generic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.distinct_messages(J.json_records(_json_lines(spark, sf_dir))).select("doc_id", "level", "message", "line_no")


@query(
    """select event_type as package, bool_or(value > 100) as failed, count(*) as n, arg_max(event_id, event_id) as last_event from events group by event_type"""
)
def ndjson_group_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("package")).agg(
        F.bool_or(F.col("value") > 100).alias("failed"), F.count("*").alias("n"), F.max_by("event_id", "event_id").alias("last_event")
    )


def _error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the error keys, made from the events' props."""
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'view')")
    return e.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_set(F.when(F.col("event_type") == "error", F.col("props")))).alias("errors"))


ERR = """err as (select user_id, strftime(ts::date, '%Y-%m-%d') as day, coalesce(list_sort(list(distinct props) filter (event_type = 'error')), []) as errors
  from events where event_type in ('error', 'view') group by 1, 2
), prv as (select *, coalesce(lag(errors) over (partition by user_id order by day), []) as b from err)"""


@query(
    f"""with {ERR} select user_id, day, len(list_filter(b, lambda x: not list_contains(errors, x))) as n_fixed,
len(list_filter(errors, lambda x: not list_contains(b, x))) as n_new, len(list_filter(errors, lambda x: list_contains(b, x))) as n_unchanged from prv"""
)
def error_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.error_sets(_error_runs(spark, sf_dir), ["user_id"], "day").select(
        "user_id", "day", *(F.size(c).cast("long").alias(f"n_{c}") for c in ("fixed", "new", "unchanged"))
    )


@query(
    f"""with {ERR}, s as (select *, case when len(errors) > 0 then array_to_string(errors, ';') end as k from err)
select user_id, day, last_value(k ignore nulls) over (partition by user_id order by day rows between unbounded preceding and 1 preceding) as last_errors from s"""
)
def error_loop_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.last_errors(_error_runs(spark, sf_dir), ["user_id"], "day").select("user_id", "day", F.array_join("last_errors", ";").alias("last_errors"))


def _compiler_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.concat(F.lit("error[E"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "0"), F.lit("]: value "), F.col("event_type"), F.lit("\n --> src/a.rs:"), (F.col("event_id") % 50).cast("string"), F.lit(":1")))
        .otherwise(F.concat(F.lit("ok "), F.col("event_type"))).alias("text"),
    )


@query("""select event_id, 'E' || lpad((event_id % 1000)::varchar, 4, '0') as code, 'src/a.rs' as file, (event_id % 50)::int as line_no, 'value error' as message from events where event_type = 'error'""")
def error_signature_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _compiler_lines(spark, sf_dir).select("event_id", F.explode(J.signatures(F.col("text"))).alias("s"))
    return found.select("event_id", "s.code", "s.file", "s.line_no", "s.message")


@query()
def stacktrace_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = F.concat(F.lit("Traceback (most recent call last):\n"), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("event_id") % 9 + 1).cast("int")), lambda i: F.concat(F.lit('  File "/app/m'), i.cast("string"), F.lit('.py", line 3\n    call()'))), "\n"), F.lit("\nValueError: bad\n"))
    return table(spark, sf_dir, "events").select("event_id", per_text(compact_traces)(trace).alias("text"))


# --- Near duplicates, noise, deltas ----------------------------------------------------------


@query(
    """select a.n_nationkey as a, b.n_nationkey as b, bit_count(xor(a.n_nationkey, b.n_nationkey))::int as distance
from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"""
)
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("b"))
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", H.hamming(F.col("a"), F.col("b")).alias("distance"))


@query()
def simhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", H.simhash(F.col("text")).alias("simhash"), H.fnv1a(F.col("text")).alias("fnv"))


@query()
def near_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near documents by SimHash bands, verified by distance: equal hashes are one node first, its members come at distance 0."""
    from textsluice.operators.near_dup import simhash_members, simhash_pairs

    # hashed once, read three times: no filter moves below the explode, and Spark reuses the one shuffle
    hashes = simhash_docs(spark, sf_dir).select(F.explode(F.array(F.struct("doc_id", "simhash"))).alias("h")).select("h.*")
    hashes = hashes.filter("doc_id is not null and simhash is not null").repartition("doc_id")
    return simhash_pairs(hashes, 3).unionByName(simhash_members(hashes))


@query()
def near_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", per_text(collapse_similar)(F.col("text")).alias("text"))


_LOGNORM = "line"
for _pattern, _name in T.LOG_PARTS:
    _LOGNORM = f"regexp_replace({_LOGNORM}, '{_pattern}', '{_name}', 'g')"


@query(rf"with {LIN} select doc_id, {_LOGNORM} as pattern, count(*) as n, min(line_no)::int as first_line from lin where regexp_matches(line, '\S') group by 1, 2")
def log_normalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.log_counts(lines(spark, sf_dir))


@query(f"select doc_id, regexp_replace(text, '{T.TEMPORAL}', '', 'g') as text from documents")
def temporal_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_temporal("text").alias("text"))


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _mixed(spark, sf_dir).withColumn("project", F.lit("p"))
    return J.learn_noise(before, L.drop_global_noise(before))


NOISE_SQL = rf"""{MIXED_SQL}, ky as (select *, regexp_replace(lower(trim(line)), '[=>\-<|\[\] ]{{4,}}', '[progress]', 'g') as pattern from mx
), kp as (select distinct doc_id, pattern from ky where {RULES_SQL} is null
), st as (select 'p' as project, pattern, count(*) as count, count(*) filter (kp.doc_id is null) as suppressed from ky left join kp using (doc_id, pattern) group by pattern
), pr as (select *, count >= 10 and suppressed / count >= 0.9 and not regexp_matches(pattern, '(?i)(error|warning|failed|fatal|panic|exception|critical)') as promoted from st)"""


@query(f"with {NOISE_SQL} select project, pattern, count, suppressed, promoted from pr")
def noise_learn_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noise(spark, sf_dir)


@query(f"with {NOISE_SQL} select doc_id, line_no, line from ky where pattern not in (select pattern from pr where promoted)")
def noise_prefilter_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _mixed(spark, sf_dir).withColumn("project", F.lit("p"))
    return J.drop_promoted(own, _noise(spark, sf_dir)).select("doc_id", "line_no", "line")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: w <> ''))"


@query(
    f"""with w as (select conv_id, turn, {_WORDS.format(x='text')} as w from conversations), p as (select *, lag(w) over (partition by conv_id order by turn) as b from w)
select conv_id, turn, round(case when len(w) + len(b) = 0 then 1.0 else len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) end, 4) as jaccard from p where b is not null"""
)
def jaccard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("b", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return m.filter("b is not null").select("conv_id", "turn", _r(T.jaccard("text", "b")).alias("jaccard"))


_LINES_SQL = "case when coalesce({t}, '') = '' then []::varchar[] else list_transform(string_split(regexp_replace({t}, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) end"
_WORDS_SQL = r"list_distinct(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"
_ALIKE = f"case when len(list_distinct({_WORDS_SQL.format(x='a[i]')} || {_WORDS_SQL.format(x='b[i]')})) = 0 then true else 2 * len(list_intersect({_WORDS_SQL.format(x='a[i]')}, {_WORDS_SQL.format(x='b[i]')})) >= len(list_distinct({_WORDS_SQL.format(x='a[i]')} || {_WORDS_SQL.format(x='b[i]')})) end"


@query(
    f"""with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations
), l as (select conv_id, turn, {_LINES_SQL.format(t='before')} as a, {_LINES_SQL.format(t='text')} as b from t where before is not null
), c as (select *, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) as changed from l
), m as (select *, len(list_filter(changed, lambda i: {_ALIKE})) as modified, least(len(a), len(b)) as n from c)
select conv_id, turn, (len(changed) - modified + len(b) - n)::int as added, (len(changed) - modified + len(a) - n)::int as removed, modified::int as modified from m"""
)
def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).withColumn("b", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return m.filter("b is not null").select("conv_id", "turn", S.classify_change(F.col("b"), F.col("text")).alias("c")).select("conv_id", "turn", "c.*")


@query()
def file_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).select(F.col("conv_id").alias("session_id"), F.col("role").alias("path"), "turn", "text")
    return S.file_deltas(m)


# --- Session state ---------------------------------------------------------------------------


@query(
    f"""with {ENT} select session_id, turn, cmd, count(*) over w > 0 as suppressed from ent
window w as (partition by session_id, cmd, content order by ts range between 120 preceding and 1 preceding)"""
)
def polling_suppress_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppress_polling(entries(spark, sf_dir)).select("session_id", "turn", "cmd", "suppressed")


@query(f"with {ENT} select session_id, turn, cmd, lag(tokens) over w as prior_tokens, lag(content) over w as prior_content from ent window w as (partition by session_id, cmd order by turn)")
def similar_output_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.previous(entries(spark, sf_dir), ["tokens", "content"]).select("session_id", "turn", "cmd", "prior_tokens", "prior_content")


@query(f"with {ENT} select session_id, turn, cmd, max(turn) over (partition by session_id, cmd, content order by turn rows between unbounded preceding and 1 preceding) as same_as from ent")
def exact_state_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_state(entries(spark, sf_dir)).select("session_id", "turn", "cmd", "same_as")


@query(
    f"""with {ENT} select session_id, turn, cmd, count(*) over w as held, (sum(tokens) over w)::bigint as held_tokens, list_unique(list(cmd) over w)::int as held_commands from ent
window w as (partition by session_id order by turn rows between 29 preceding and current row)"""
)
def session_fifo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fifo_state(entries(spark, sf_dir))


@query(
    f"""with {ENT} select session_id, turn, coalesce(ts - lag(ts) over (partition by cmd, content order by ts, turn) <= 3600, false) as cache_hit from ent"""
)
def result_cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.result_cache(entries(spark, sf_dir)).select("session_id", "turn", "cache_hit")


@query("select strftime(ts::date, '%Y-%m-%d') as day, event_type, count(*) as runs, round(sum(value), 2) as value from events group by 1, 2")
def tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("runs"), F.sum("value").alias("value"))
    return per.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "runs", _r("value", 2).alias("value"))


@query(
    """with d as (select unnest(generate_series(ts::date - 6, ts::date, interval 1 day))::date as day, event_type from events)
select strftime(day, '%Y-%m-%d') as day, event_type, count(*) as runs from d group by 1, 2"""
)
def sliding_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    spread = table(spark, sf_dir, "events").select("event_type", F.explode(F.sequence(F.date_sub(day, 6), day)).alias("day"))
    return spread.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("runs"))


@query(
    f"""with {ENT}, s as (select session_id, turn, sum(tokens) over (partition by session_id order by turn) as so_far from ent)
select session_id, turn, so_far::bigint as so_far, round(greatest(0, least(1, (so_far - 25000) / 55000.0)), 4) as pressure,
round(greatest(0.5, least(1.0, 1.0 - (so_far - 50000) / 50000.0 * 0.5)), 4) as factor from s"""
)
def pressure_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pressure(entries(spark, sf_dir)).select("session_id", "turn", "so_far", _r("pressure").alias("pressure"), _r("factor").alias("factor"))


@query(f"with {ENT}, s as (select *, max(turn) over (partition by session_id, cmd) as l from ent) select session_id, turn, case when turn < l then 'superseded' end as stale_reason from s")
def staleness_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.staleness(entries(spark, sf_dir)).select("session_id", "turn", "stale_reason")


@query(
    f"""with {ENT}, p as (select session_id, turn, least(tokens / 500.0, 1.0) as p from ent)
select session_id, turn, case when p < 0.01 then 200 else greatest(floor(200 * (1 - 0.75 * p)), 30) end::bigint as threshold,
case when p < 0.01 then 30 else greatest(floor(30 * (1 - 0.6 * p)), 4) end::bigint as head from p"""
)
def config_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.col("tokens") / 500.0, F.lit(1.0))
    return entries(spark, sf_dir).select(
        "session_id", "turn", R.tighten(F.lit(200), p, 0.75, 30).alias("threshold"), R.tighten(F.lit(30), p, 0.6, 4).alias("head")
    )


# --- Vectors ---------------------------------------------------------------------------------


_COS = DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + "))"


@query(
    f"""with s as (select b.vec_id as query_id, a.vec_id, {_COS} as c from embeddings a join embeddings b on b.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s)
select query_id, vec_id, round(c, 4) as cosine, rank::int as rank from r where rank <= 10"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vec_id divisible by 20, itself included."""
    v = vectors(spark, sf_dir)
    asked = v.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return M.nearest_blocks(v, asked, 10).select("query_id", "vec_id", _r("cosine").alias("cosine"), "rank")


@query(f"with {CEN} select label, round(list_sum(centroid), 4) as total, round(centroid[1], 4) as first, len(centroid)::int as dims from cen")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(vectors(spark, sf_dir), ["label"])
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return c.select("label", _r(total).alias("total"), _r(F.get("centroid", F.lit(0))).alias("first"), F.size("centroid").alias("dims"))


ANO = f"""{CEN}, ano as (select e.vec_id, e.label, 1 - {DOT.format(a='e.embedding', b='c.centroid')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')}) as score
  from embeddings e join cen c using (label)
), rkd as (select *, row_number() over (partition by label order by score desc, vec_id) as rank, max(score) over (partition by label) as best from ano)"""


@query(f"with {ANO} select vec_id, label, round(score, 4) as score, rank::int as rank from rkd")
def anomaly_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return M.anomaly(vectors(spark, sf_dir), "label").select("vec_id", "label", _r("score").alias("score"), F.row_number().over(by).alias("rank"))


@query(f"with {ANO} select label, vec_id from rkd where rank <= 10 and score >= 0.4 * best")
def anomaly_select_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.select_budget(M.anomaly(vectors(spark, sf_dir), "label"), "label", 10, "vec_id").select("label", "vec_id")


@query(
    f"""with {ANO}, q as (select embedding as qv from embeddings where vec_id = 0), b as (
  select a.vec_id, a.label, 0.5 * a.score + 0.5 * ({DOT.format(a='e.embedding', b='q.qv')} / (sqrt({DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({DOT.format(a='q.qv', b='q.qv')}))) as score
  from ano a join embeddings e using (vec_id) cross join q)
select vec_id, round(score, 4) as score from b"""
)
def query_blend_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return M.relevance(M.anomaly(vectors(spark, sf_dir), "label"), q).select("vec_id", _r("score").alias("score"))


@query(f"with {ANO}, s as (select label, list(score order by score) as s from ano group by label) select label, round(s[least(greatest(floor(len(s) * 0.4)::int, 0), len(s) - 1) + 1], 4) as threshold from s")
def percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.anomaly(vectors(spark, sf_dir), "label").groupBy("label").agg(F.collect_list("score").alias("s"))
    return per.select("label", _r(V.percentile_index(F.col("s"), 0.4)).alias("threshold"))


@query(f"with {ANO} select label, count(*) as n, round(avg(score), 4) as entropy from ano group by label")
def semantic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entropy(vectors(spark, sf_dir), "label").select("label", "n", _r("entropy").alias("entropy"))


@query(
    f"""with {ANO}, e as (select label, count(*) as n, avg(score) as e from ano group by label)
select label, case when n < 200 then 60 else greatest(floor(60 * (case when e <= 0.10 then 0.05 when e >= 0.35 then 1.0 else 0.05 + (e - 0.10) / 0.25 * 0.95 end)), 1) end::bigint as budget from e"""
)
def entropy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entropy(vectors(spark, sf_dir), "label").select("label", M.entropy_budget(F.col("n"), F.col("entropy"), 60).alias("budget"))


@query(
    f"""with {CEN}, u as (select centroid as c from cen where label = 0), n as (select centroid as c from cen where label = 1), s as (
  select vec_id, ({DOT.format(a='embedding', b='u.c')} - {DOT.format(a='embedding', b='n.c')}) / sqrt({DOT.format(a='embedding', b='embedding')}) as noise_score from embeddings cross join u cross join n)
select vec_id, round(noise_score, 4) as noise_score from s where noise_score >= -0.05"""
)
def noise_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.centroids(vectors(spark, sf_dir), ["label"])
    proto = lambda k: c.filter(F.col("label") == k).select(F.col("centroid").alias("p"))
    return M.drop_noise(M.noise_score(vectors(spark, sf_dir), proto(0), proto(1))).select("vec_id", _r("noise_score").alias("noise_score"))


@query(
    f"""with {CEN}, s as (select e.vec_id, e.label, 1 - {DOT.format(a='e.embedding', b='c.centroid')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')}) as score
  from embeddings e join cen c on c.label = (e.label + 1) % 10
), r as (select *, row_number() over (partition by label order by score desc, vec_id) as rank, max(score) over (partition by label) as best from s)
select label, vec_id from r where rank <= 5 and score >= greatest(0.4 * best, 0.1)"""
)
def historical_centroid_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = V.centroids(vectors(spark, sf_dir), ["label"]).select(((F.col("label") + 9) % 10).cast("int").alias("label"), "centroid")
    return M.select_budget(M.anomaly(vectors(spark, sf_dir), "label", history=past), "label", 5, "vec_id", floor=0.10).select("label", "vec_id")


@query()
def cluster_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textsluice.operators.near_dup import greedy_clusters

    return greedy_clusters(vectors(spark, sf_dir), "label", "vec_id", 0.85)


@query()
def anchored_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textsluice.functions.summarise import summarise_anchored

    return table(spark, sf_dir, "documents").select("doc_id", per_text(_Budget(summarise_anchored, 10))(F.col("text")).alias("text"))


class _Budget:
    """A summariser with its budget fixed."""

    def __init__(self, f: Callable[..., str], budget: int) -> None:
        self.f, self.budget = f, budget

    def __call__(self, text: str) -> str:
        return self.f(text, self.budget)


# --- Conversations ---------------------------------------------------------------------------

_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\x01|\n'), lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> '')"


@query(f"select conv_id, turn, len({_SENT}) as sentences from conversations")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", "turn", F.size(C.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(
    """with a as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) - 1 as age from conversations),
t as (select *, case when age < 3 then 0 when age < 8 then 1 else 2 end::int as tier from a)
select conv_id, turn, age::int as age, tier, case when tier = 0 then 1.0 when role = 'user' and tier = 1 then 0.55 when role = 'user' then 0.2 when tier = 2 then 0.6 else 1.0 end::double as ratio from t"""
)
def convo_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ages(messages(spark, sf_dir)).select("conv_id", "turn", "age", "tier", C.keep_ratio(F.col("role"), F.col("tier")).alias("ratio"))


_TOK = "ceil(strlen(text) / 4)::bigint"


@query(
    f"""with m as (select conv_id, turn, role, {_TOK} as tokens, row_number() over (partition by conv_id order by turn desc) - 1 as age from conversations
), g as (select *, case when age >= 3 then tokens - tokens // 2 else 0 end as gain, sum(tokens) over (partition by conv_id) as total from m
), l as (select *, total - sum(gain) over o as lft from g window o as (partition by conv_id order by role <> 'user', age desc)
), n as (select *, min(lft) over (partition by conv_id order by role <> 'user', age desc) as low from l
), p as (select *, coalesce(lag(low) over (partition by conv_id order by role <> 'user', age desc), total) as before from n)
select conv_id, turn, age >= 3 and least(before, total) > 300 as stepped, case when age >= 3 and least(before, total) > 300 then tokens // 2 else tokens end as tokens_after from p"""
)
def convo_budget_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.ages(messages(spark, sf_dir)).withColumn("tokens", T.token_estimate("text"))
    m = m.withColumn("tokens_less", F.floor(F.col("tokens") / 2).cast("long"))
    return C.budget_pass(m, 300).select("conv_id", "turn", "stepped", "tokens_after")


@query(
    f"""with s as (select conv_id, turn, unnest(x) as sentence, generate_subscripts(x, 1) - 1 as n from (select conv_id, turn, {_SENT} as x from conversations where role = 'user')
), f as (select *, min(turn) over (partition by conv_id, sentence) as first_turn from s)
select conv_id, turn, n::int as n, sentence, case when first_turn < turn then first_turn end as covered_in from f"""
)
def convo_sentence_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_sentence_dedup(messages(spark, sf_dir))


@query(
    f"""with c as (select conv_id, turn, sum({_TOK}) over (partition by conv_id order by turn) as context from conversations)
select conv_id, turn, context::bigint as context, (sum(context) over (partition by conv_id order by turn))::bigint as cumulative from c"""
)
def convo_cumulative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cumulative_tokens(messages(spark, sf_dir), T.token_estimate("text")).select("conv_id", "turn", "context", "cumulative")


@query(
    r"""with k as (select conv_id, turn, lower(text) as low from conversations), n as (select conv_id, turn, case when regexp_matches(low, '\b(edited|applied|wrote|updated) \S*|\+\+\+ ') then 'edit'
  when regexp_matches(low, '(?m)^(diff --git|@@ )') then 'diff' when regexp_matches(low, '\b(error|failed|passed|compiling|build)\b') then 'build' end as kind from k
), w as (select *, max(case when kind = 'edit' then turn end) over (partition by conv_id) as last_edit, max(turn) over (partition by conv_id, kind) as later from n)
select conv_id, turn, kind, coalesce(kind in ('build', 'diff') and (turn < last_edit or turn < later), false) as stale from w"""
)
def convo_stale_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stale_flags(messages(spark, sf_dir)).select("conv_id", "turn", "kind", "stale")


@query()
def convo_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compress(messages(spark, sf_dir)).select("conv_id", "turn", "age", "tier", "compressed")


# --- Web and routing -------------------------------------------------------------------------


@query()
def web_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", handled(F.lit("(webfetch)"), F.regexp_replace("html", "<[^>]+>", "\n")).alias("text"))


def _score_sql() -> str:
    from textsluice.functions.summarise import SECTION_NOISE, SECTION_WORDS

    count = lambda w: f"(length(l) - length(replace(l, '{w}', ''))) // {len(w)}"
    return f"greatest(0, {' + '.join(map(count, SECTION_WORDS))} - 3 * ({' + '.join(map(count, SECTION_NOISE))}))"


@query(f"with p as (select page_id, lower(html) as l from pages) select page_id, ({_score_sql()})::bigint as score from p")
def web_section_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textsluice.functions.summarise import SECTION_NOISE, SECTION_WORDS

    low = F.lower("html")
    count = lambda ws: sum((F.regexp_count(low, F.lit(w)) for w in ws[1:]), F.regexp_count(low, F.lit(ws[0])))
    return table(spark, sf_dir, "pages").select("page_id", F.greatest(count(SECTION_WORDS) - 3 * count(SECTION_NOISE), F.lit(0)).cast("long").alias("score"))


@query(
    rf"""with {LIN}, m as (select doc_id, line_no, strlen(line) as bytes, trim(line) as t from lin
), f as (select doc_id, count(*) as line_count, round(sum(bytes) / count(*), 4) as avg_line_length,
  round(sum(regexp_matches(t, '(?i)error|warn|fail|fatal|panic|exception')::int) / count(*), 4) as error_line_density,
  round((count(*) filter (line_no < 200) - count(distinct t) filter (line_no < 200)) / count(*) filter (line_no < 200), 4) as repetition_ratio,
  sum((starts_with(t, 'at ') or contains(t, ' at ') or starts_with(t, 'File "') or starts_with(t, 'goroutine '))::int) >= 3 as has_stack_trace
  from m group by doc_id)
select * from f"""
)
def router_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.features(lines(spark, sf_dir))
    return f.select("doc_id", "line_count", *(_r(c).alias(c) for c in ("avg_line_length", "error_line_density", "repetition_ratio")), "has_stack_trace")


@query()
def router_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    f = R.features(own).join(R.byte_entropy(own), "doc_id", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))
    return f.select("doc_id", F.posexplode(R.top_experts(R.scores())).alias("place", "x")).select("doc_id", "place", "x.expert", _r("x.weight").alias("weight"))


@query(
    """with c as (select user_id, list(n) as n from (select user_id, event_type, count(*) as n from events group by 1, 2) group by user_id)
select user_id, round(list_sum(list_transform(n, lambda x: (x / list_sum(n)) * (x / list_sum(n)))), 4) as hhi from c"""
)
def router_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("click", "purchase", "error", "signup", "view")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    return per.select("user_id", _r(R.hhi([F.col(k) for k in kinds])).alias("hhi"))


# --- Analytics -------------------------------------------------------------------------------

_SUMS = "count(*) as runs, sum(input_tokens)::bigint as tokens_in, sum(output_tokens)::bigint as tokens_out, sum(saved)::bigint as tokens_saved"


@query(f"with {REC} select {_SUMS}, round(avg(duration_ms), 4) as avg_ms, round(sum(saved) * 100.0 / sum(input_tokens), 4) as pct from sav")
def gain_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.totals(records(spark, sf_dir)).withColumn("avg_ms", _r("avg_ms")).withColumn("pct", _r("pct"))


_LAST = "(select max(ts) from rec)"


@query(
    f"""with {REC}, n as (select max(ts) as now from rec) select coalesce(sum(saved) filter (ts >= now - now % 86400), 0)::bigint as saved_today,
coalesce(sum(saved) filter (ts >= now - 604800), 0)::bigint as saved_7d, count(*) filter (ts >= now - 604800) as runs_7d from sav cross join n"""
)
def gain_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = records(spark, sf_dir)
    return A.windows(rec, _newest(spark, sf_dir))


def _newest(spark: SparkSession, sf_dir: str) -> int:
    """The newest record's time: what stands for now."""
    return table(spark, sf_dir, "lineitem").agg(F.max(seconds("l_shipdate"))).first()[0]


@query(f"with {REC} select command as key, {_SUMS}, round(sum(saved) * 100.0 / sum(input_tokens), 4) as pct from sav group by command")
def gain_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.breakdown(records(spark, sf_dir)).withColumn("pct", _r("pct"))


@query(f"with {REC} select command as key, sum(saved)::bigint as tokens_saved from sav group by command order by tokens_saved desc, key limit 1")
def gain_top_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_command(records(spark, sf_dir)).select("key", "tokens_saved")


@query(
    f"""with {REC}, n as (select max(ts) - max(ts) % 86400 as last from rec), d as (select unnest(generate_series(last - 13 * 86400, last, 86400)) as day_ts from n
), p as (select ts - ts % 86400 as day_ts, {_SUMS} from sav group by 1)
select strftime(make_timestamp(day_ts * 1000000), '%Y-%m-%d') as day, coalesce(runs, 0) as runs, coalesce(tokens_in, 0) as tokens_in, coalesce(tokens_out, 0) as tokens_out, coalesce(tokens_saved, 0) as tokens_saved
from d left join p using (day_ts)"""
)
def gain_history_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_history(records(spark, sf_dir), _newest(spark, sf_dir))


@query(
    f"""with {REC}, p as (select project || ' ' || command as key, sum(saved) as s from sav group by 1), r as (select *, row_number() over (order by s desc, key) as n from p)
select case when n <= 8 then key else 'rest' end as key, sum(s)::bigint as tokens_saved from r group by 1"""
)
def gain_top8_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_and_rest(records(spark, sf_dir).withColumn("command", F.concat_ws(" ", "project", "command")))


@query(f"with {REC} select round(sum(saved * 3.0 / 1e6), 4) as cost_saved from sav")
def gain_blended_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blended_cost(records(spark, sf_dir)).select(_r("cost_saved").alias("cost_saved"))


@query(f"with {REC} select command as key, {_SUMS} from sav group by rollup(command)")
def gain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cost_rollup(records(spark, sf_dir))


QUA = f"""{REC}, sig as (select project, count(*) as runs, sum(saved) * 100.0 / sum(input_tokens) as savings, avg(cache_hit::int * 100.0) as cache_rate,
  avg(case when subcommand = 'delta' then 100.0 else 0.0 end) as delta_rate, stddev_pop(case when input_tokens = 0 then 0 else saved * 100.0 / input_tokens end) as spread from sav group by project)"""


@query(f"with {QUA} select project, runs, round(savings, 4) as savings, round(cache_rate, 4) as cache_rate, round(delta_rate, 4) as delta_rate, round(spread, 4) as spread from sig")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.quality_signals(records(spark, sf_dir))
    return s.select("project", "runs", *(_r(c).alias(c) for c in ("savings", "cache_rate", "delta_rate", "spread")))


@query(
    f"""with {QUA}, s as (select project, 0.5 * least(savings / 90 * 100, 100) + 0.1 * cache_rate + 0.1 * delta_rate + 0.15 * least(runs / 30 * 100, 100) + 0.15 * greatest(100 - spread, 0) as score from sig)
select project, round(score, 4) as score, case when score >= 90 then 'S' when score >= 80 then 'A' when score >= 70 then 'B' when score >= 55 then 'C' else 'D' end as grade from s"""
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality_score(A.quality_signals(records(spark, sf_dir))).select("project", _r("score").alias("score"), "grade")


@query(f"with {REC} select command, record_id, saved as tokens_saved from sav where not cache_hit order by saved desc, record_id limit 1")
def biggest_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.biggest_save(records(spark, sf_dir), "record_id")


@query(f"with {REC}, c as (select sum(saved * 3.0 / 1e6) as cost, count(distinct ts // 86400) as days from sav where ts > 0) select round(cost, 4) as cost, days, round(cost / days * 30, 4) as monthly from c")
def monthly_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monthly_projection(records(spark, sf_dir)).select(_r("cost").alias("cost"), "days", _r("monthly").alias("monthly"))


LOW = f"""{REC}, low as (select command, {_SUMS}, round(sum(saved) / sum(input_tokens), 6) as ratio from sav group by command
  having count(*) >= 5 and sum(input_tokens) > 2000 and sum(saved) / sum(input_tokens) < 0.35 order by tokens_in desc, command limit 15)"""


@query(f"with {LOW} select * from low")
def discover_low_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.low_compression(records(spark, sf_dir)).withColumn("ratio", _r("ratio", 6))


@query(f"with {LOW} select command, greatest(floor(tokens_in * 0.6)::bigint - tokens_saved, 0) as potential from low")
def discover_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.low_compression_potential(A.low_compression(records(spark, sf_dir)), A.savings_targets(spark)).select("command", "potential")


@query(f"with {REC} select command, round(sum(saved) / sum(input_tokens), 6) as ratio from sav group by command having sum(saved) > 0")
def discover_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.measured_ratios(records(spark, sf_dir)).withColumn("ratio", _r("ratio", 6))


@query(
    f"""with {ENT}, u as (select cmd as command, count(*) as runs, sum(tokens)::bigint as tokens from ent group by cmd), o as (select *, floor(tokens * 0.4)::bigint as saveable from u)
select command, runs, tokens, saveable from o where saveable >= 500 order by saveable desc, command limit 20"""
)
def discover_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = entries(spark, sf_dir).select(F.col("cmd").alias("command"), "tokens")
    return A.opportunities(usage, A.measured_ratios(records(spark, sf_dir)), A.savings_targets(spark))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.col("session_id"), F.col("content").alias("file"), "tokens", "ts")


@query(f"with {ENT}, r as (select content as file, count(*) as reads from ent group by content) select file, reads, round(reads / max(reads) over (), 6) as frequency from r")
def read_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read_frequency(_reads(spark, sf_dir), 0).withColumn("frequency", _r("frequency", 6))


@query(f"with {ENT} select round(greatest(50, avg(tokens)), 4) as avg_tokens from ent")
def tokens_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tokens_per_read(_reads(spark, sf_dir)).select(_r("avg_tokens").alias("avg_tokens"))


def _guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 12).alias("files_recommended"), (F.col("c_custkey") % 12 + 40).alias("files_in_repo")
    )


@query(
    f"""with {ENT}, b as (select session_id, count(distinct content) as read from ent group by session_id), a as (select c_custkey as session_id, c_custkey % 12 as recommended from customer)
select session_id, recommended, read, round(least(recommended, read) / read, 6) as precision from a join b using (session_id) where recommended > 0 and read > 0"""
)
def focus_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.focus_precision(_guidance(spark, sf_dir), _reads(spark, sf_dir)).withColumn("precision", _r("precision", 6))


@query("select round(sum(40) / sum(c_custkey % 12 + 40), 6) as ratio from customer")
def exclusion_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.exclusion_ratio(_guidance(spark, sf_dir)).withColumn("ratio", _r("ratio", 6))


@query("select event_id, case event_id % 3 when 0 then event_type || ' x' when 1 then 'tool' else '(pipeline)' end as key from events")
def cmd_key_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("A_B=1 /usr/bin/"), F.col("event_type"), F.lit("  x"))).when(F.col("event_id") % 3 == 1, "./bin/tool")
    return table(spark, sf_dir, "events").select("event_id", T.command_key(raw).alias("key"))


@query("select s_suppkey, case s_suppkey % 3 when 0 then 5.0 when 1 then 15.0 else 3.0 end::double as price from supplier")
def price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.get(F.array(*map(F.lit, ("claude-opus-4-5-20251101", "Claude-Opus-4-1", "unknown"))), (F.col("s_suppkey") % 3).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", A.model_price(model).alias("price"))


@query(
    f"""with {ENT}, f as (select session_id, content as file, ts, turn from ent where cmd = 'view'), d as (select session_id, content as file, ts, turn, turn % 100 as edit_line from ent where cmd = 'click'
), j as (select d.*, (select arg_max(f.turn, (f.ts, f.turn)) from f where f.session_id = d.session_id and f.file = d.file and f.ts <= d.ts) as seen from d)
select session_id, file, ts, edit_line, edit_line >= seen % 40 and edit_line < seen % 40 + 30 as was_preserved from j where seen is not null"""
)
def edit_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumn("file", F.col("content"))
    begin = F.col("turn") % 40
    events = e.filter("cmd = 'view'").groupBy("session_id", "file", "ts").agg(F.max("turn").alias("turn")).select(
        "session_id", "file", "ts", F.array(F.struct(begin.alias("begin"), (begin + 30).alias("end"), F.lit(True).alias("preserved"))).alias("sections")
    )
    edits = e.filter("cmd = 'click'").select("session_id", "file", "ts", (F.col("turn") % 100).alias("edit_line"))
    return A.attribute_edits(edits, events)


@query(
    f"""with {ENT}, p as (select session_id, cmd, sum(tokens)::bigint as tokens, count(*) as runs from ent group by 1, 2), r as (select *, row_number() over (partition by session_id order by tokens desc, cmd) as n from p)
select session_id, string_agg(cmd || ' ×' || runs || ' (' || tokens || ' tokens)', chr(10) order by n) as digest from r where n <= 8 group by session_id"""
)
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.session_digest(entries(spark, sf_dir).withColumnRenamed("cmd", "command"))


# --- Graph and retrieval ---------------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file"))


COC = """chg as (select distinct l_orderkey as c, l_suppkey as f from lineitem), coc as (
  select a.f as file_a, b.f as file_b, count(*) as change_count from chg a join chg b on a.c = b.c and a.f < b.f group by 1, 2
), sym as (select file_a as file, file_b as other, change_count from coc union all select file_b, file_a, change_count from coc
), nei as (select * from (select *, row_number() over (partition by file order by change_count desc, other) as rank from sym) where rank <= 20)"""


@query(f"with {COC} select * from coc")
def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cochanges(_changes(spark, sf_dir))


@query(f"with {COC} select file, other, change_count, rank::int as rank from nei")
def cochange_neighbours_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(G.cochanges(_changes(spark, sf_dir)))


@query(
    f"""with {COC}, one as (select distinct file as start, other as file from nei), two as (
  select distinct o.start, n.other as file from one o join nei n on n.file = o.file where n.other <> o.start and (o.start, n.other) not in (select (start, file) from one))
select start, file, 1 as depth from one union all select start, file, 2 from two"""
)
def impact_bfs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every file reaches in two steps of strong edges."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    return G.impact(G.cochanges(_changes(spark, sf_dir)), starts)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("src/"), "source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file"),
        F.col("text").alias("signatures"),
        (F.pmod(F.col("doc_id") * 37, F.lit(100)) / 100.0).alias("similarity"),
        F.pmod(F.col("doc_id"), F.lit(7)).alias("change_count"),
        F.lit(0.0).alias("read_frequency"),
        F.lit("general").alias("role"),
    )


#: What the words of the query find in each document: signatures, path, and beginnings of words of four bytes or more.
_ASKED = ("the", "and", "doc1", "that")
_CAMEL = r"regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1' || chr(1) || '\2', 'g')"
_FOUND = " + ".join(
    f"case when bool_or(sig and p = '{w}') then 1.0 else 0.0 end + case when bool_or(not sig and p = '{w}') then 0.8 else 0.0 end + case when {str(len(w) >= 4).lower()} and bool_or(starts_with(p, '{w}')) then 0.3 else 0.0 end"
    for w in _ASKED
)
LEX = rf"""fi as (select 'src/' || source || '/doc' || doc_id || '.rs' as file, text, (doc_id * 37) % 100 / 100.0 as similarity, doc_id % 7 as c from documents
), wo as (select file, true as sig, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+')) as w from fi where text is not null union all select file, false, unnest(string_split_regex(file, '[/\\._-]')) from fi
), pa as (select distinct file, sig, p from (select file, sig, lower(w) as p from wo where strlen(w) >= 2 union all select file, sig, lower(unnest(string_split({_CAMEL}, chr(1)))) from wo where strlen(w) >= 2) where strlen(p) >= 2
), lx as (select file, least(1.0::double, ({_FOUND})::double / 8.4::double) as lexical from pa group by file)"""


@query(
    f"""with {LEX}, b as (select file, (0.7 * similarity + 0.3 * ln(1 + c) / ln(1 + max(c) over ()))::double as base from fi), t as (select * from b order by base desc, file limit 200)
select file, round(base, 6) as base, round(lexical, 6) as lexical, round(0.4 * base + 0.6 * lexical, 6) as final from t join lx using (file) order by 0.4 * base + 0.6 * lexical desc, file limit 20"""
)
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = G.hybrid_rank(G.base_rank(_files(spark, sf_dir)), "the and doc1 that", 20)
    return ranked.select("file", _r("base", 6).alias("base"), _r("lexical", 6).alias("lexical"), _r("final", 6).alias("final"))


@query(
    """with f as (select 'src/' || source || '/doc' || doc_id || '.rs' as file, (doc_id * 37) % 100 / 100.0 as similarity, doc_id % 7 as c from documents)
select file, round(0.7 * similarity + 0.3 * ln(1 + c) / ln(1 + max(c) over ()), 6) as base from f"""
)
def base_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.base_rank(_files(spark, sf_dir)).select("file", _r("base", 6).alias("base"))


@query(f"with {LEX} select file, round(lexical, 6) as score from lx")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.lexical_score(T.query_tokens(F.lit("the and doc1 that")), T.signature_tokens("signatures"), T.path_tokens("file"))
    return _files(spark, sf_dir).select("file", _r(score, 6).alias("score"))


@query(
    r"""with iw as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark
), dw as (select doc_id::varchar as file, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
), ik as (select item_id, 3 as most, least(3, len(w)) as k, w from iw union all select item_id, 8, least(8, len(w)), w from iw
), ir as (select item_id, most, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as run from ik where k > 0
), dr as (select distinct file, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as run from dw cross join (select distinct k from ik where k > 0)
), n as (select item_id, file, count(*) as c from ir join dr using (k, run) where most = 3 group by all
), r as (select *, row_number() over (partition by item_id order by c desc, file) as rank from n
), x as (select distinct item_id, file from ir join dr using (k, run) where most = 8
), b as (select item_id, min(rank) as best from r join x using (item_id, file) where rank <= 5 group by item_id)
select iw.item_id, best is not null as hit, coalesce(1.0::double / best, 0) as rr from iw left join b using (item_id)"""
)
def hit_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item: documents are ranked by its runs of 3 words, the expected ones have 8 words of it in a row."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    matches = G.passage_matches(items, docs)
    found = G.retrieval_metrics(G.top_files(matches), matches.filter("contains"))
    return items.join(found, "task", "left").select(F.col("task").alias("item_id"), F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("rr", F.lit(0.0)).alias("rr"))


@query(r"select p_partkey, case when p_name ~ '.*' then case when p_partkey % 4 = 0 then 'test' when p_partkey % 4 = 1 then 'entry_point' when p_partkey % 4 = 2 then 'config' else 'general' end end as role from part")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, ("src/tests/a.rs", "src/main.rs", "etc/x.toml", "src/other.rs"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_role(path)["role"].alias("role"))


# --- Handlers and the whole reduction (each handler has queries of its own in handler_queries) --------


@query()
def handlers_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through the log handler, every page through the web handler's relatives."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("log").alias("command"), F.col("text").alias("output"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("curl https://x").alias("command"), F.col("html").alias("output"))
    both = docs.unionByName(pages)
    return both.select("id", "command", F.char_length("output").alias("chars_in"), F.char_length(handled(F.col("command"), F.col("output"))).alias("chars_out"))


@query()
def text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reduction of every document, with its accounting."""
    from textsluice.plans.pipeline import process

    return process(table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("make").alias("command"))).select("doc_id", "output", "input_tokens", "output_tokens", "lines_in", "lines_out")
