"""Queries of gates, command rewriting, intent and file reads, with oracle SQL where SQL can say the same."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textsluice.functions import commands as K
from textsluice.functions import text as T
from textsluice.functions import vectors as V
from textsluice.functions.summarise import hash_embed
from textsluice.operators import convo as C
from textsluice.operators import gates
from textsluice.operators import graph as G
from textsluice.operators import reads as D
from textsluice.plans.catalog import query
from textsluice.plans.tables import DOT, ENT, entries, messages, table, vectors

#: Command lines that events stand for. Fixed values of these queries.
COMMANDS = (
    "sleep", "RUST_LOG=debug cargo build", "A='x y' B=\"q \\\" r\" git status && ls -l", "cat a | grep b", "head -20 src/{e}.rs", "tail -n 5 a.log", "tail -f a.log",
    "make || echo '>' x", "true", "fn() => x", "cargo test > out.txt", "/usr/bin/git push; unknown {e}", "run git log", "X=1 head --lines=3 f{e}", "echo \"a | b\"",
)
KNOWN = ("cargo", "git", "ls", "make", "grep")


def _chosen(items: tuple[str, ...]) -> Column:
    one = F.get(F.array(*map(F.lit, items)), (F.col("event_id") % len(items)).cast("int"))
    return F.replace(one, F.lit("{e}"), F.col("event_id").cast("string"))


def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_CMD = f"c as (select event_id, props, replace({_list(COMMANDS)}[event_id % {len(COMMANDS)} + 1], '{{e}}', event_id::varchar) as command from events)"
_ENV = r"""^(?:\s*[A-Za-z_][A-Za-z0-9_]*=(?:[^\s''"]|''[^'']*(?:''|$)|"(?:[^"\\]|\\.)*(?:"|$))*)*\s*"""
_BARE = """regexp_replace(command, '''[^'']*(?:''|$)|"[^"]*(?:"|$)', 'Q', 'g')"""
_OPT = r"(?:(?:-n|--lines)\s+\S+|--lines=\S*|-+[0-9]+)"
_FILE = rf"^(?:head|tail)(?:\s+{_OPT})*\s+([^-\s]\S*)(?:\s+{_OPT})*(?:\s+(?:-n|--lines))?\s*$"


@query(
    rf"""with {_CMD} select event_id, regexp_replace(command, '{_ENV}', '') as bare, contains(replace({_BARE}, '||', '  '), '|') or regexp_matches({_BARE}, '(?:^|[^-=])>') as diverted,
nullif('cat ' || regexp_extract(command, '{_FILE}', 1), 'cat ') as cat from c"""
)
def command_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_id", _chosen(COMMANDS).alias("command"))
    return c.select("event_id", K.without_assignments(F.col("command")).alias("bare"), K.diverts_output(F.col("command")).alias("diverted"), K.head_or_tail(F.col("command")).alias("cat"))


#: What each of COMMANDS becomes, worked out by hand.
_REWRITTEN = (
    None, "RUST_LOG=debug run cargo build", "A='x y' B=\"q \\\" r\" run git status && run ls -l", None, "run cat src/{e}.rs", "run cat a.log", None,
    "run make || echo '>' x", None, None, None, "run /usr/bin/git push; unknown {e}", None, "X=1 run cat f{e}", None,
)


@query(
    f"select event_id, replace([{', '.join('NULL' if x is None else _list((x,))[1:-1] for x in _REWRITTEN)}][event_id % {len(COMMANDS)} + 1], '{{e}}', event_id::varchar) as rewritten from events"
)
def command_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", K.rewritten(_chosen(COMMANDS), KNOWN).alias("rewritten"))


@query(
    f"""with {_CMD}, o as (select event_id, command, case event_id % 4 when 0 then props when 1 then repeat(props, 9) when 2 then repeat(props, 9) || ' Error' else repeat('x', event_id % 80) end as output from c)
select event_id, ceil(strlen(output) / 4.0) < 15 as small, command in ('sleep', 'wait', 'true', 'false', ':') and not regexp_matches(output, 'error|Error|invalid') as leaked from o"""
)
def output_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    turn = F.col("event_id") % 4
    nine = F.repeat("props", F.lit(9))
    output = F.when(turn == 0, F.col("props")).when(turn == 1, nine).when(turn == 2, F.concat(nine, F.lit(" Error"))).otherwise(F.expr("repeat('x', cast(event_id % 80 as int))"))
    o = e.select("event_id", _chosen(COMMANDS).alias("command"), output.alias("output"))
    return o.select("event_id", gates.too_small(F.col("output")).alias("small"), gates.leaked(F.col("command"), F.col("output")).alias("leaked"))


#: First lines of blocks, one kind each. Fixed values of this query.
HEADS = ("Compiling a", "error: x", "thread panicked", "test a ok", "warning: y", "note: z", "  indented", "plain")


@query(
    rf"""with b as (select doc_id, [{_list(HEADS)}[doc_id % {len(HEADS)} + 1]] || case when doc_id % 3 = 0 and coalesce(text, '') <> '' then
    list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) else []::varchar[] end as L from documents
), s as (select *, lower(array_to_string(L, chr(10))) as low from b)
select doc_id, case when len(list_filter(L, lambda x: not regexp_matches(x, '^\s*(?:Compiling|Checking|Download|Fetching|Updating)'))) = 0 then 'build/download progress'
  when contains(low, 'error:') or contains(low, 'error[') then 'error details' when contains(low, 'panicked') or contains(low, 'stack backtrace') then 'stack trace'
  when (contains(low, 'passed') or contains(low, ' ok')) and not contains(low, 'failed') and contains(low, 'test') then 'passing tests'
  when contains(low, 'warning:') then 'compiler warnings' when contains(low, 'note:') then 'compiler notes'
  when len(list_filter(L, lambda x: not (starts_with(x, '  ') or starts_with(x, chr(9))))) = 0 then 'indented detail' else 'filtered output' end as kind from s"""
)
def block_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.array(F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS)).cast("int")))
    body = F.when(F.col("doc_id") % 3 == 0, T.lines("text")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", gates.block_kind(F.concat(head, body)).alias("kind"))


@query(
    r"""with m as (select conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from conversations where role = 'assistant'
), r as (select *, row_number() over (partition by conv_id order by turn desc) as n from m where text <> ''
), s as (select conv_id, n, regexp_replace(translate(text, '*`#>', ''), '^\s+|\s+$', '', 'g')[:case n when 1 then 200 when 2 then 150 else 100 end] as cut from r where n <= 3)
select conv_id, string_agg(regexp_replace(regexp_extract(cut, '^([^.!?]*[.!?]?)', 1), '^\s+|\s+$', '', 'g'), ' | ' order by n) as intent from s group by conv_id"""
)
def intent_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.recent_intent(messages(spark, sf_dir))


_BLEND = "list_transform(list_zip(a.embedding, b.embedding), lambda p: 0.4 * p[1]::double + 0.6 * p[2]::double)"


@query(
    f"""with p as (select a.vec_id, a.label, a.embedding as last, {_BLEND} as v from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
s as (select *, {DOT.format(a='v', b='last')} / sqrt({DOT.format(a='v', b='v')} * {DOT.format(a='last', b='last')}) as c from p)
select vec_id, round(c, 4) as similarity, c > 0.85 or 20 + vec_id % 20 < 25 as skipped from s"""
)
def prompt_topic_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("intent"))
    both = v.join(after, "vec_id").withColumn("v", G.prompt_blend(F.col("embedding"), F.col("intent")))
    return both.select("vec_id", F.round(V.cosine(F.col("v"), F.col("embedding")), 4).alias("similarity"), G.topic_skipped(F.col("v"), F.col("embedding"), 20 + F.col("vec_id") % 20).alias("skipped"))


@query(
    """select doc_id, (doc_id % 2 = 0) and (doc_id % 4 < 3) and n_chars // 10 >= 150 and doc_id % 5 >= 2 and doc_id % 3 >= 1 as applies from documents"""
)
def focus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("src/a.rs", "lib/b.PY", "x/c.hpp", "README.md")))
    path = F.get(kinds, (F.col("doc_id") % 4).cast("int"))
    applies = gates.focus_applies(path, F.expr("n_chars div 10"), F.col("doc_id") % 5, F.col("doc_id") % 3, F.col("doc_id") % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", applies.alias("applies"))


@query(
    r"""with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) <= 12 as allowed from events)
select user_id, event_id, allowed from r"""
)
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.within_calls(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(
    """with g as (select user_id, list(props order by event_id) as L from events group by user_id)
select user_id, array_to_string(case when len(L) > 60 then L[1:40] || ['[... ' || (len(L) - 60) || ' lines omitted — BERT budget exhausted ...]'] || L[-20:] else L end, chr(10)) as output from g"""
)
def call_budget_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(own.alias("lines")).select("user_id", gates.beyond_calls(F.col("lines")).alias("output"))


@query(f"with {ENT} select session_id, turn, content as file, tokens, row_number() over (partition by session_id order by ts, turn) as place from ent where cmd = 'view'")
def session_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = entries(spark, sf_dir).filter("cmd = 'view'").withColumn("at", F.struct("ts", "turn"))
    return D.session_log(reads, order="at").select("session_id", "turn", F.col("content").alias("file"), "tokens", "place")


_COS = DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + "))"


@query(
    f"""with s as (select *, label as session, vec_id // 40 as turn, vec_id % 40 as seg, 5 + vec_id % 7 as n_lines, row_number() over (partition by label order by vec_id) as place from embeddings
), f as (select *, min(place) over (partition by session, turn) as first from s
), seen as (select distinct a.vec_id from f a join f b on a.session = b.session and b.place < a.first and b.place >= a.first - 8 and {_COS} >= 0.8
), t as (select f.*, seen.vec_id is not null as hit from f left join seen using (vec_id)
), u as (select *, sum(case when hit then n_lines else 0 end) over (partition by session, turn) as gone from t)
select session as session_id, turn, seg as seg_no, hit and gone / 60 <= 0.3 as suppressed from u"""
)
def cross_file_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sections: a session per label, a read per 40 ids; the last 8 sections count, so that caps are met."""
    v = vectors(spark, sf_dir).select(
        F.col("label").alias("session_id"), F.expr("vec_id div 40").alias("turn"), (F.col("vec_id") % 40).alias("seg_no"), (5 + F.col("vec_id") % 7).alias("n_lines"), "embedding"
    )
    reads = v.select("session_id", "turn", F.lit(60).alias("total_lines")).distinct()
    return D.cross_file_dedup(v, reads, stored=8).select("session_id", "turn", "seg_no", "suppressed")


@F.arrow_udf(ArrayType(DoubleType()))
def _embedded(texts: pa.Array) -> pa.Array:
    return pa.array(hash_embed([t or "" for t in texts.to_pylist()]).tolist(), pa.list_(pa.float64()))


@query()
def semantic_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message against the nearest earlier one of its role and conversation."""
    m = messages(spark, sf_dir).filter("text is not null")
    e = m.select(F.col("conv_id").alias("session_id"), "turn", F.col("role").alias("cmd"), T.token_estimate("text").alias("tokens"), F.col("text").alias("content"))
    return D.semantic_delta(e.withColumn("embedding", _embedded(F.col("content"))))


@query()
def read_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a read, twenty of them a session, paths shared by documents of a source in it."""
    d = table(spark, sf_dir, "documents")
    return D.read_flow(
        d.select(
            F.expr("doc_id div 20").alias("session_id"), F.col("doc_id").alias("turn"), F.concat(F.coalesce("source", F.lit("x")), F.lit(".py")).alias("path"), "text",
            F.lit("the words").alias("goal"), F.when(F.col("doc_id") % 7 == 0, "strip").otherwise("passthrough").alias("level"),
            F.array(F.struct(F.lit(10).alias("first"), F.lit(12).alias("last"))).alias("edited"),
        )
    )
