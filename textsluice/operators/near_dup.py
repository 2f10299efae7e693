"""Near duplicates over a corpus: SimHash bands, and greedy clusters of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simhash_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b, distance) of representatives whose hashes differ in ``distance`` bits at most.

    ``hashes``: doc_id, simhash. Equal hashes are one representative, the smallest
    id. Of ``distance + 1`` bands of bits one is equal in any such pair; the pair is
    emitted at its first equal band only, so no distinct is needed.
    """
    one = hashes.filter("simhash is not null").groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    bands = distance + 1
    width = 64 // bands
    parts = [F.shiftrightunsigned("simhash", i * width).bitwiseAND((1 << (width if i < bands - 1 else 64 - width * i)) - 1) for i in range(bands)]
    keyed = one.select("doc_id", "simhash", F.posexplode(F.array(*parts)).alias("band", "bits"))
    a = keyed.select("band", "bits", F.col("doc_id").alias("a"), F.col("simhash").alias("ha"))
    b = keyed.select("band", "bits", F.col("doc_id").alias("b"), F.col("simhash").alias("hb"))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    pairs = a.join(b, ["band", "bits"]).filter("a < b").withColumn("distance", F.bit_count(differ)).filter(F.col("distance") <= distance)
    masks = [((1 << (width if i < bands - 1 else 64 - width * i)) - 1) << (i * width) for i in range(bands)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    first = F.lit(bands)
    for i in reversed(range(bands)):
        first = F.when(differ.bitwiseAND(F.lit(signed[i])) == 0, i).otherwise(first)
    return pairs.filter(F.col("band") == first).select("a", "b", "distance")


def simhash_members(hashes: DataFrame) -> DataFrame:
    """(a, b, 0) of every document b whose hash equals that of its representative a, the smallest id of that hash.

    With ``simhash_pairs`` this tells every near pair: the links of a representative hold for all its members.
    """
    one = hashes.filter("simhash is not null").groupBy("simhash").agg(F.min("doc_id").alias("a"))
    return hashes.join(one, "simhash").filter("doc_id > a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("distance"))


def greedy_clusters(df: DataFrame, group: str, key: str, least: float = 0.85, vector: str = "embedding") -> DataFrame:
    """(group, key, cluster) by greedy online clustering in key order. The order makes it sequential within a
    group; what is held per group are the cluster centres, rows come in batches."""
    from textsluice.functions.summarise import unit

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, centres, counts = None, [], []
        for pdf in frames:
            out = []
            for g, k, v in zip(pdf[group], pdf[key], pdf[vector], strict=True):
                if g != current:
                    current, centres, counts = g, [], []
                row = unit(np.asarray(v, float))
                scores = np.stack(centres) @ row if centres else np.zeros(0)
                best = int(len(scores) - 1 - scores[::-1].argmax()) if len(scores) else -1
                if best >= 0 and scores[best] >= least:
                    counts[best] += 1
                    centres[best] = unit((centres[best] * (counts[best] - 1) + row) / counts[best])
                else:
                    centres.append(row)
                    counts.append(1)
                    best = len(centres) - 1
                out.append((g, k, best))
            yield pd.DataFrame(out, columns=[group, key, "cluster"])

    kinds = dict(df.dtypes)
    return df.select(group, key, vector).repartition(group).sortWithinPartitions(group, key).mapInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster int")
