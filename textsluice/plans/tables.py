"""The driver's tables in the shapes that operators take, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsluice.operators.lines import explode_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Unix seconds of a time stamp without zone, read as UTC."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records of filtered commands."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_mktsegment").alias("project"),
            F.col("o_orderpriority").alias("command"),
            F.col("l_returnflag").alias("subcommand"),
            F.floor("l_extendedprice").cast("long").alias("input_tokens"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("output_tokens"),
            seconds("l_shipdate").alias("ts"),
            (F.col("l_discount") == 0).alias("cache_hit"),
            F.col("l_linestatus").alias("model"),
            (F.col("l_orderkey") % 1000).alias("duration_ms"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        )
    )


REC = """rec as (
  select c_mktsegment as project, o_orderpriority as command, l_returnflag as subcommand, floor(l_extendedprice)::bigint as input_tokens,
         floor(l_extendedprice * (1 - l_discount))::bigint as output_tokens, epoch(l_shipdate)::bigint as ts, l_discount = 0 as cache_hit,
         l_linestatus as model, l_orderkey % 1000 as duration_ms, l_orderkey * 10 + l_linenumber as record_id
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
), sav as (select *, greatest(input_tokens - output_tokens, 0) as saved from rec)"""

#: The moment that stands for now: the end of the tables' last day.
NOW = 1_735_689_600


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session entries; turn is the event's id, which ascends with time per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("turn"),
        F.col("event_type").alias("cmd"),
        seconds("ts").alias("ts"),
        F.floor("value").cast("long").alias("tokens"),
        F.col("props").alias("content"),
    )


ENT = """ent as (
  select user_id as session_id, event_id as turn, event_type as cmd, floor(epoch(ts))::bigint as ts, floor(value)::bigint as tokens, props as content
  from events
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LIN = r"""lin as (
  select doc_id, line_no, regexp_replace(line, '\r$', '') as line from (
    select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as line_no
    from (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) as parts from documents where text is not null and text <> '')
  )
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
CEN = """cen as (
  select label, list(m / len order by dim) as centroid from (
    select label, dim, m, sqrt(sum(m * m) over (partition by label)) as len from (
      select label, dim, avg(x::double) as m from (
        select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as dim from embeddings
      ) group by label, dim
    )
  ) group by label
)"""
