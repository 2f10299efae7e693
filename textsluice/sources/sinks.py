"""Sinks: record log, blocks that were cut out, co-change graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_VERSION = "1"


def append_records(records: DataFrame, path: str) -> None:
    """Appends to a log that is partitioned by UTC day."""
    day = F.to_date(F.timestamp_seconds("ts"))
    records.withColumn("day", day).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """blocks: session_id, turn, block_no, line_no, line."""
    blocks.write.mode("append").parquet(path)


def read_block(spark: SparkSession, path: str, session: str, turn: int, block: int) -> DataFrame:
    return (
        spark.read.parquet(path)
        .filter((F.col("session_id") == session) & (F.col("turn") == turn) & (F.col("block_no") == block))
        .orderBy("line_no")
    )


def list_blocks(spark: SparkSession, path: str, session: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("session_id") == session).groupBy("turn", "block_no").agg(F.count("*").alias("lines"))


def write_graph(files: DataFrame, edges: DataFrame, path: str) -> None:
    files.withColumn("version", F.lit(GRAPH_VERSION)).write.mode("overwrite").parquet(f"{path}/files")
    edges.write.mode("overwrite").parquet(f"{path}/cochanges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """files and edges; a graph of another version is refused."""
    files = spark.read.parquet(f"{path}/files")
    if not files.filter(F.col("version") != GRAPH_VERSION).isEmpty():
        raise ValueError("the graph has another version and must be built again")
    return files.drop("version"), spark.read.parquet(f"{path}/cochanges")


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows, with fresh ones in place of those of equal key."""
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def index_status(files: DataFrame, edges: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges")))
