"""Queries of scalar functions: paths, formats, cuts, hashes and pressures over values made from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsluice.functions import hashing as H
from textsluice.functions import text as T
from textsluice.operators import router as R
from textsluice.operators import semantic as M
from textsluice.operators.handlers.base import HARD_KEEP
from textsluice.plans.catalog import query
from textsluice.plans.tables import table

#: Paths, sizes and lines that events stand for. Fixed values of these queries.
PATHS = (
    "src/main.rs", "a/very/long/path/that/goes/on/and/on/for/more/than/fifty/f{e}.TOML", "README.md", "x/docs/guide{e}.py", "examples/a.rs", "/abs/file", "deep/testdata/b{e}", "lib/my-docs/c.js", "pkg/server.go",
    ".hidden", "tests/unit/d{e}_test.go",
)
SIZES = ("12.5MB", "{e}kB", "3.2gb", "7B", "none", "1.5 TB")
HITS = ("src/a.rs:{e}:let x = 1;", "no hit {e}", "b.py:7:", "c:d:e")
STAMPED = ("2024-01-01T00:00:00Z line {e}", "2024-01-01T00:00:00.123+02:00  y{e}", "plain {e}", "connection Refused {e}", "ok Timeout")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "props", "value")


def _chosen(items: tuple[str, ...]) -> Column:
    return F.replace(F.get(F.array(*map(F.lit, items)), (F.col("event_id") % len(items)).cast("int")), F.lit("{e}"), F.col("event_id").cast("string"))


def _pick(items: tuple[str, ...]) -> str:
    return "replace([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"][event_id % {len(items)} + 1], '{{e}}', event_id::varchar)"


@query(
    rf"""with p as (select event_id, {_pick(PATHS)} as p from events), s as (select *, string_split(p, '/') as a, lower(p) as low from p)
select event_id, a[-1] as name, case when not contains(p, '/') then '.' when len(a) = 2 and a[1] = '' then '/' else array_to_string(a[:-2], '/') end as folder,
  lower(regexp_extract(a[-1], '[^.]\.([A-Za-z0-9_+-]+)$', 1)) as extension, case when length(p) > 50 and len(a) > 3 then a[1] || '/.../' || a[-2] || '/' || a[-1] else p end as short,
  regexp_matches(low, '\.(md|mdx|rst|adoc|asciidoc|txt)$') or regexp_matches(low, '/(testdata|test-data|fixtures?|docs?|documentation|docs_src|e2e|benchmarks?|website|paradox|i18n)/')
  or regexp_matches(low, '^[^/]*/(examples?|samples?)/') or regexp_matches(low, '^(testdata|samples|examples|docs?|docs_src|fixtures|benchmarks|website)/') or regexp_matches(low, '[-_]docs(/|$)') as noise from s"""
)
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).select("event_id", _chosen(PATHS).alias("p"))
    return p.select(
        "event_id", T.basename("p").alias("name"), T.parent_dir("p").alias("folder"), T.extension("p").alias("extension"), T.compact_path("p").alias("short"), T.is_noise_path("p").alias("noise")
    )


@query(
    """with n as (select event_id, event_id * 700 + 30 as n, event_id * 50 as s from events)
select event_id, case when n >= 1000000 then printf('%.1fM', n / 1000000) when n >= 1000 then printf('%.1fk', n / 1000) else n::varchar end as tokens,
  case when n / 1e6 < 0.01 then '< $0.01' else printf('$%.2f', n / 1e5 + 0.001) end as cost, case when n < 1000 then n || 'ms' else printf('%.1fs', n / 1000) end as duration,
  case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' when s < 86400 then s // 3600 || 'h' else s // 86400 || 'd' end as age,
  strftime(make_timestamp(s * 1000 * 1000000), '%Y-%m-%d') as day from n"""
)
def format_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _events(spark, sf_dir).select("event_id", (F.col("event_id") * 700 + 30).alias("n"), (F.col("event_id") * 50).alias("s"))
    cost = F.when(F.col("n") / 1e6 < 0.01, T.format_cost(F.col("n") / 1e6)).otherwise(T.format_cost(F.col("n") / 1e5 + 0.001))
    return n.select(
        "event_id", T.format_tokens("n").alias("tokens"), cost.alias("cost"), T.format_duration("n").alias("duration"), T.format_age("s").alias("age"), T.utc_day(F.col("s") * 1000).alias("day")
    )


@query(
    rf"""with x as (select event_id, {_pick(SIZES)} as size, {_pick(HITS)} as hit, {_pick(STAMPED)} as line, props from events), y as (select *, repeat(props || ' ', 20) || 'NEEDLE' || repeat(' ' || props, 20) as long from x
), z as (select *, greatest(1, position('needle' in lower(long)) - 60) as b from y)
select event_id, try_cast(regexp_extract(upper(size), '^([0-9.]+)\s*[KMGT]?B$', 1) as double) * case regexp_extract(upper(size), '([KMGT]?)B$', 1) when 'K' then 1e3 when 'M' then 1e6 when 'G' then 1e9 when 'T' then 1e12 else 1 end as bytes,
  nullif(regexp_extract(hit, '^([^:]+):[0-9]+:', 1), '') as path, try_cast(regexp_extract(hit, '^[^:]+:([0-9]+):', 1) as int) as line_no, case when regexp_matches(hit, '^[^:]+:[0-9]+:') then regexp_extract(hit, '^[^:]+:[0-9]+:(.*)$', 1) end as found,
  regexp_replace(line, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?\s*', '') as bare, regexp_matches(lower(line), '{"|".join(HARD_KEEP)}') as keep,
  case when length(line) > 12 then line[:12] || '…' else line end as cut, case when b > 1 then '…' else '' end || long[b:b + 119] || case when b + 119 < length(long) then '…' else '' end as centre from z"""
)
def line_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _events(spark, sf_dir).select("event_id", _chosen(SIZES).alias("size"), _chosen(HITS).alias("hit"), _chosen(STAMPED).alias("line"), "props")
    pad = F.concat(F.repeat(F.concat("props", F.lit(" ")), F.lit(20)), F.lit("NEEDLE"), F.repeat(F.concat(F.lit(" "), "props"), F.lit(20)))
    hit = T.grep_fields("hit")
    return x.select(
        "event_id", T.docker_size("size").alias("bytes"), hit["path"].alias("path"), hit["line_no"].alias("line_no"), hit["match"].alias("found"), T.strip_docker_timestamp("line").alias("bare"),
        F.lower("line").rlike("|".join(HARD_KEEP)).alias("keep"), T.truncate_chars("line", 12).alias("cut"), T.centred(pad, F.lit("needle")).alias("centre"),
    )


_FNV = "list_reduce([14695981039346656037::uhugeint] || list_transform(string_split({x}, ''), lambda c: ascii(c)::uhugeint), lambda h, b: xor(h::ubigint, b::ubigint)::uhugeint * 1099511628211::uhugeint % 18446744073709551616::uhugeint)"
_SIGNED = "(case when {h} >= 9223372036854775808::uhugeint then {h}::hugeint - 18446744073709551616::hugeint else {h}::hugeint end)::bigint"


@query(f"with h as (select event_id, {_FNV.format(x='props')} as h from events) select event_id, {_SIGNED.format(h='h')} as fnv from h")
def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", H.fnv1a(F.col("props")).alias("fnv"))


@query(
    f"""with t as (select event_id, list_transform(string_split(props || ' ' || (event_id % 9) || ' word', ' '), lambda w: ({_FNV.format(x='w')})::ubigint) as hs from events
), s as (select event_id, list_reduce(list_transform(range(0, 64), lambda b: case when 2 * len(list_filter(hs, lambda z: (z >> b::ubigint) & 1::ubigint = 1)) > len(hs) then (1::ubigint << b::ubigint)::uhugeint else 0::uhugeint end), lambda a, z: a + z) as h from t)
select event_id, {_SIGNED.format(h='h')} as simhash from s"""
)
def simhash_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("props", F.lit(" "), (F.col("event_id") % 9).cast("string"), F.lit(" word"))
    return _events(spark, sf_dir).select("event_id", H.simhash(text).alias("simhash"))


@query(
    """with x as (select event_id, event_id % 101 / 100 as s, event_id % 400 as n, event_id * 40 as t from events)
select event_id, round(case when s < 0.85 then 0 else least((s - 0.85) / 0.15 * 0.8, 0.8) * 0.4 end, 6)::double as stability,
  round(case when n > 0 then least((n // 3) / n * 0.5, 0.3) else 0 end, 6)::double as stale, case when s < 0.01 then n else greatest(floor(n * (1 - 0.5 * s)), 20)::bigint end as tightened,
  round(greatest(0.5, least(1, 1 - (t - 50000) / 50000 * 0.5)), 6)::double as factor, case when n > 200 then 0.96 when n > 50 then 0.95 else 0.92 end::double as threshold,
  case when s >= 0.70 and s - 0.4 >= 0.15 then 'full' when s >= 0.55 and s - 0.4 >= 0.08 then 'filter' else 'none' end as route from x"""
)
def pressure_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("event_id") % 101 / 100, F.col("event_id") % 400
    r = lambda x: F.round(x, 6)
    return _events(spark, sf_dir).select(
        "event_id", r(R.stability_pressure(s)).alias("stability"), r(R.staleness_pressure(F.floor(n / 3), n)).alias("stale"), R.tighten(n, s, 0.5, 20).alias("tightened"),
        r(R.compression_factor(F.col("event_id") * 40)).alias("factor"), M.read_threshold(n).cast("double").alias("threshold"), M.route(s, F.lit(0.4)).alias("route"),
    )


_KINDS = ("click", "purchase", "error", "signup", "view")


@query(
    f"""with c as (select user_id, {', '.join(f"count(*) filter (event_type = '{k}' or '{k}' = case when user_id % 2 = 0 then 'view' else '' end)::bigint as {k}" for k in _KINDS)} from events group by user_id
), b as (select *, {' + '.join(_KINDS)} as total, greatest({', '.join(_KINDS)}) as top from c)
select user_id, {', '.join(f"(case when total > 0 and top / total > 0.70 and {k} <> top then 0.5 else 0 end)::double as {k}" for k in _KINDS)} from b"""
)
def exploration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus of every expert beside a dominant one; users of even id count every event as a view too."""
    also = lambda k: F.when(F.col("user_id") % 2 == 0, F.lit(k) == "view").otherwise(F.lit(False))
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if((F.col("event_type") == k) | also(k)).alias(k) for k in _KINDS))
    return counts.select("user_id", *(x.cast("double").alias(k) for k, x in zip(_KINDS, R.exploration_bonus([F.col(k) for k in _KINDS]), strict=True)))


@query(
    """with f as (select item_id, lower(text) as low, [lower(text[1:12]), 'zzzz', lower(text[5:9])] as facts from benchmark where text is not null)
select item_id, doc_id, len(list_filter(facts, lambda x: contains(lower(d.text), x))) > 0 as recalled from f join documents d on d.doc_id % 50 = f.item_id % 50 where d.text is not null"""
)
def key_fact_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.array(F.substring("text", 1, 12), F.lit("ZZZZ"), F.substring("text", 5, 5)).alias("facts"))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    pairs = docs.join(facts, F.col("doc_id") % 50 == F.col("item_id") % 50)
    return pairs.select("item_id", "doc_id", T.has_key_fact("text", "facts").alias("recalled"))
