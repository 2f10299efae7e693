"""Vector functions over ARRAY<FLOAT or DOUBLE> columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsluice.functions.text import let


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter of the two lengths."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v, F.lit(1), n)
    return F.aggregate(
        F.zip_with(cut(a), cut(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def normalize(a: Column) -> Column:
    return let(
        norm(a), lambda n: F.when(n <= 1e-9, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))
    )


def blend(a: Column, wa: float, b: Column, wb: float) -> Column:
    return normalize(F.zip_with(a, b, lambda x, y: x.cast("double") * wa + y.cast("double") * wb))


def centroids(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """keys and centroid: mean per dimension, normalised. Means combine before the shuffle."""
    means = (
        df.select(*keys, F.posexplode(vector).alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    packed = means.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean")
    )
    return packed.select(*keys, normalize(F.col("mean")).alias("centroid"))


def percentile_index(scores: Column, p: float) -> Column:
    """Element floor(n * p) of the sorted scores, clamped; scores are not interpolated."""
    n = F.size(scores)
    at = F.least(F.greatest(F.floor(n * p), F.lit(0)), n - 1)
    return F.when(n > 0, F.get(F.sort_array(scores), at.cast("int")))
