"""Documents to packed token sequences: language ID, exact and near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``docs``. Texts that are null or have
no letter go in the first stage; rows without an id, and repeated ids, pass like
any other row; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsluice.llm import langid
from textsluice.llm.bloom_dedup import exact_dedup
from textsluice.llm.common import Scratch, read_table
from textsluice.llm.jaccard_join import near_dedup
from textsluice.llm.mixing import mix
from textsluice.llm.packing import pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those far from all languages."""
    model = langid.fit(docs, langid.id_bucket("doc_id", 4) != 2)
    return langid.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts, white space aside."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near duplicates: the smallest doc_id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until the sources have their target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 2048."""
    # the stages before it share its executors: less memory, some more time
    return pack(docs, cache_words=120_000, chunk_bytes=2_000_000).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language ID, its model and the tokenizer are not expressible in SQL. A test holds every stage and run() against a plain
#: chain on a small table, tests/llm/test_brute_force.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents table; each stage's result is written and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}", texts=True)
        scratch.keep(f"{k}-{name}")  # what the stage read is not read again
    return docs
