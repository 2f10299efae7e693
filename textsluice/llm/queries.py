"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsluice.llm import langid, toxicity
from textsluice.llm.bitplane import round_trip
from textsluice.llm.bloom_dedup import exact_groups
from textsluice.llm.common import read_table
from textsluice.llm.jaccard_join import near_groups
from textsluice.llm.mixing import mix_plan
from textsluice.llm.mtree import quantised, top_k
from textsluice.llm.packing import pack
from textsluice.llm.pii import replace_pii
from textsluice.llm.urlfilter import host_of, url_filter


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    bucket = langid.id_bucket("doc_id", 3)
    machine = toxicity.fit(docs, labels, bucket != 1)
    return toxicity.toxicity(docs, machine).select("doc_id", (bucket == 1).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    bucket = langid.id_bucket("doc_id", 4)
    model = langid.fit(docs, bucket != 2)
    return langid.identify(docs, model).select("doc_id", (bucket == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


def _number(x: Column, digits: int = 6) -> Column:
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("int")


def _day(n: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n)


def _block_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, parent domains and addresses that occur: which of them
    are listed, when they are added, removed and added again follows from their MD5."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).filter("pattern is not null").distinct()
    n = _number(F.col("pattern"))
    category = F.element_at(F.array(*map(F.lit, ("ads", "adult", "malware", "spam"))), n % 4 + 1)
    entry = lambda kind, action, at: F.struct(F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), category.alias("category"), _day(at).alias("at"))
    listed = hosts.filter(n % 3 == 0).select(
        F.explode(F.array(entry("domain", "add", n % 300), entry("domain", "remove", n % 300 + 45), entry("domain", "add", n % 300 + 90))).alias("e")
    )
    parents = hosts.select(F.regexp_replace("pattern", r"^[^.]*\.", "").alias("pattern")).distinct().select(
        F.explode(F.array(entry("domain", "add", n % 300), entry("domain", "remove", n % 300 + 20))).alias("e")
    )
    urls = (
        pages.select(F.regexp_replace("url", "#.*$", "").alias("pattern"))
        .filter(n % 50 == 0)
        .distinct()
        .select(F.explode(F.array(entry("url", "add", n % 300))).alias("e"))
    )
    return listed.union(parents).union(urls).select("e.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day((F.col("page_id") * 7919 % 366).cast("int")))
    return url_filter(captures, _block_list(pages)).withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, key="textsluice")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mtree_search": op1_mtree_search,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mtree_search": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as x from embeddings
), s as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::bigint as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op7_url_filter": r"""
with p as (
  select page_id, url, date '2024-01-01' + (page_id * 7919 % 366)::int as fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)', 1)) as host,
         regexp_replace(url, '#.*$', '') as bare
  from pages
), n as (
  select distinct 'domain' as kind, host as pattern, 1 as rule from p
  union select distinct 'domain', regexp_replace(host, '^[^.]*\.', ''), 2 from p
  union select distinct 'url', bare, 3 from p
), m as (
  select *, ('0x' || substr(md5(pattern), 1, 6))::int as n from n
), e as (
  select kind, pattern, n, unnest([('add', n % 300), ('remove', n % 300 + 45), ('add', n % 300 + 90)]) as x from m where rule = 1 and n % 3 = 0
  union all select kind, pattern, n, unnest([('add', n % 300), ('remove', n % 300 + 20)]) from m where rule = 2
  union all select kind, pattern, n, ('add', n % 300) from m where rule = 3 and n % 50 = 0
), l as (
  select distinct kind, pattern, x[1] as action, ['ads', 'adult', 'malware', 'spam'][n % 4 + 1] as category, date '2024-01-01' + x[2] as at_day from e
), i as (
  select kind, pattern, category, action, at_day as valid_from,
         lead(at_day) over (partition by kind, pattern order by at_day, action = 'remove', category) as valid_to
  from l
), k as (
  select page_id, fetched_at, 'url' as kind, bare as pattern from p
  union all
  select page_id, fetched_at, 'domain', array_to_string(string_split(host, '.')[j:], '.')
  from (select *, unnest(range(1, len(string_split(host, '.')) + 1)) as j from p)
), h as (
  select page_id, count(*) as n_matches, array_to_string(list_sort(list(distinct category)), ',') as categories, min(kind || ':' || pattern) as first_pattern
  from k join i using (kind, pattern)
  where action = 'add' and fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)
  group by page_id
)
select page_id, url, strftime(fetched_at, '%Y-%m-%d') as fetched_at, host, coalesce(n_matches, 0) as n_matches, coalesce(categories, '') as categories, first_pattern,
       n_matches is not null as blocked
from p left join h using (page_id)
""",
    "op5_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         substr(md5('mix|' || cast(doc_id as varchar)), 1, 12) as k
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
         source_size * 3 as cap
  from s
), r as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as lvl
  from w
  window o as (order by cap::double / weight::double, source is null, source rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, least(cap::double, weight * (
           select arg_min(lvl, cap::double / weight::double) from r where lvl <= cap::double / weight::double)) as target
  from r
), u as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as whole from t
), p as (
  select d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size as want,
         sum(d.size) over (partition by d.source order by d.k, d.doc_id rows between unbounded preceding and current row) as upto
  from d join u on d.source is not distinct from u.source
)
select doc_id, size::bigint as size, source_size, target,
       (size * (whole + case when want > 0 and whole < 3 and upto - size / 2.0 <= want then 1 else 0 end))::bigint as taken
from p
""",
    "op8_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), d as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from w
), t as (
  select doc_id, len(s) as n, unnest(s) as x from d
), l as (
  select a.doc_id as p, b.doc_id as q from t a join t b on a.x = b.x and a.doc_id < b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e as (
  select p, q from l union all select q, p from l
), c(doc_id, root) as (
  select doc_id, doc_id from d union select e.q, c.root from c join e on e.p = c.doc_id
)
select doc_id, len(any_value(s))::bigint as n_shingles, min(root) as component_id from c join d using (doc_id) group by doc_id
""",
    "op9_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents
), r as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size
  from d window w as (partition by h order by n desc, doc_id)
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from r
""",
}
