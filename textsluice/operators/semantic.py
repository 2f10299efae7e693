"""Scores and selections over embeddings, as native column arithmetic over a frame of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.functions import vectors as V

SCORE = "score"


def anomaly(df: DataFrame, group: str, vector: str = "embedding", history: DataFrame | None = None) -> DataFrame:
    """``df`` with score: 1 - cosine to its group's centroid, or to ``history`` (group, centroid)."""
    middle = V.centroids(df, [group], vector) if history is None else history
    return df.join(middle, group).withColumn(SCORE, 1 - V.cosine(F.col(vector), F.col("centroid")))


def relevance(df: DataFrame, query: DataFrame, vector: str = "embedding", weight: float = 0.5) -> DataFrame:
    """Scores blended with the cosine to the one row of ``query`` (column q)."""
    return df.crossJoin(F.broadcast(query.limit(1))).withColumn(SCORE, (1 - weight) * F.col(SCORE) + weight * V.cosine(F.col(vector), F.col("q")))


def select_budget(df: DataFrame, group: str, budget: int, key: str, factor: float = 0.40, floor: float = 0.0, must: Column | None = None) -> DataFrame:
    """Rows within the budget by score, not below ``factor`` times the group's best; ``must`` rows always stay."""
    must = F.lit(False) if must is None else must
    whole = Window.partitionBy(group)
    by = whole.orderBy(must.desc(), F.col(SCORE).desc(), key)
    ranked = df.withColumn("_must", must).withColumn("rank", F.row_number().over(by)).withColumn("_best", F.max(SCORE).over(whole))
    ok = F.col("_must") | ((F.col("rank") <= budget) & (F.col(SCORE) >= F.greatest(F.col("_best") * factor, F.lit(floor))))
    return ranked.filter(ok).drop("_must", "_best")


def gaps(df: DataFrame, group: str, place: str) -> DataFrame:
    """Selected rows with the number of rows left out before each (places from 0)."""
    return df.withColumn("omitted_before", F.col(place) - F.coalesce(F.lag(place).over(Window.partitionBy(group).orderBy(place)), F.lit(-1)) - 1)


def entropy(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """group, n, entropy: mean distance to the centroid, 0 for single rows."""
    scored = anomaly(df, group, vector)
    return scored.groupBy(group).agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.avg(SCORE)).otherwise(0.0).alias("entropy"))


def entropy_budget(n: Column, e: Column, most: int) -> Column:
    """Budget of a group: all of it under 200 rows, else 5 % to 100 % by entropy, one at least."""
    share = F.when(e <= 0.10, 0.05).when(e >= 0.35, 1.0).otherwise(0.05 + (e - 0.10) / 0.25 * 0.95)
    return F.when(n < 200, F.lit(most)).otherwise(F.greatest(F.floor(most * share), F.lit(1))).cast("long")


def noise_score(df: DataFrame, useful: DataFrame, noise: DataFrame, vector: str = "embedding") -> DataFrame:
    """cosine to the useful prototype less that to the noise prototype; each frame has one row (column p)."""
    both = F.broadcast(useful.limit(1).withColumnRenamed("p", "_u")).crossJoin(F.broadcast(noise.limit(1).withColumnRenamed("p", "_n")))
    return df.crossJoin(both).withColumn("noise_score", V.cosine(F.col(vector), F.col("_u")) - V.cosine(F.col(vector), F.col("_n"))).drop("_u", "_n")


def drop_noise(scored: DataFrame, least: float = -0.05) -> DataFrame:
    return scored.filter(F.col("noise_score") >= least)


def nearest(df: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """For each of a few queries (query_id, q) the k rows of highest cosine, ties by key. Queries are broadcast."""
    scored = df.crossJoin(F.broadcast(queries)).select("query_id", key, V.cosine(F.col(vector), F.col("q")).alias("cosine"))
    by = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), key)
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column in double, shorter ones filled with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _sum(terms: Iterator[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sums in order, as ``V.dot`` does: equal vectors get equal scores wherever they stand."""
    out = np.zeros(shape)
    for t in terms:
        out += t
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_sum((x * x for x in m.T), (len(m),)))


def _best(query: np.ndarray, cosine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by falling cosine, ties by id."""
    at = np.lexsort((ids, -cosine, query))
    q = query[at]
    at = at[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return query[at], cosine[at], ids[at]


def nearest_blocks(df: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block: int = 4096, rows: int = 8192) -> DataFrame:
    """``nearest`` for any number of queries: blocks of about ``block`` are broadcast, and tasks of about ``rows`` rows
    keep ``k`` rows of each query, so the products never leave a task."""
    spark = df.sparkSession
    asked = queries.filter("query_id is not null and q is not null").select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q"))
    held = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    blocks, parts = max(1, -(-asked.count() // block)), max(1, -(-held.count() // rows))
    held = held.repartition(parts)
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in part], np.int64), _matrix(pa.array([r.q for r in part], pa.list_(pa.float64())))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: B008
            names, asks = sent.value
            asks_norm = _norms(asks)
            kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    piece = batch.slice(start, 2048)
                    ids, m = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece.column(1))
                    dims, norm, new = min(m.shape[1], asks.shape[1]), _norms(m), [kept]
                    for low in range(0, len(names), 256):
                        some = slice(low, low + 256)
                        n = norm[:, None] * asks_norm[None, some]
                        dot = _sum((m[:, d, None] * asks[None, some, d] for d in range(dims)), n.shape)
                        scores = np.where(n == 0, 0.0, np.clip(dot / np.where(n == 0, 1.0, n), -1.0, 1.0))
                        least = np.partition(scores, max(len(ids) - k, 0), axis=0)[max(len(ids) - k, 0)]
                        r, q = np.nonzero(scores >= least)  # ties of the last place too
                        new.append((q + low, scores[r, q], ids[r]))
                    kept = _best(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[2]), pa.array(kept[1])], ["query_id", key, "cosine"])

        some = held.mapInArrow(run, f"query_id long, {key} long, cosine double")
        found = some if found is None else found.unionByName(some)
    by = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), key)
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def read_threshold(n_lines: Column) -> Column:
    """Similarity from which a read counts as repeated, by its length."""
    return F.when(n_lines > 200, 0.96).when(n_lines > 50, 0.95).otherwise(0.92)


def route(best: Column, second: Column) -> Column:
    """full, filter or none from the best two similarities to handlers."""
    return F.when((best >= 0.70) & (best - second >= 0.15), "full").when((best >= 0.55) & (best - second >= 0.08), "filter").otherwise("none")
