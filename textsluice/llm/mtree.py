"""Exact top-k inner-product search by best-first search in M-trees.

Integer vectors become points of a metric space by one more coordinate,
``sqrt(M**2 - |x|**2)`` with M the largest norm of the tree and 0 for a query; then
the distance to a query falls exactly as the inner product rises. The rows of a
partition are put in order around pivots, GROUP trees at a time, and every stretch of
TREE rows becomes an M-tree of pages: an inner page has routing
points with covering radii and distances to the parent's point, a leaf has
vectors with distances to the parent's point. A search keeps a queue of pages by
the least distance they can hold, and skips entries whose stored bounds already
exclude them (``|d(q, parent) - d(o, parent)| - radius`` beyond the k-th best)
without computing a distance. A group's trees are searched in the order of the most
they can hold (by their centre and radius), each with the k-th best of those before
it as its bound, and skipped from where that excludes them. Groups of trees meet
blocks of queries on the executors. Scores are integers; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsluice.llm.common import Scratch

TREE = 8192
LEAF = 128
FANOUT = 32
#: Relative slack for bounds in floating point; what falls within it is computed.
SLACK = 1e-9

#: Trees that are built, and searched by a block of queries, together; and the most bytes of vectors among them.
GROUP = 8
GROUP_BYTES = 1 << 26

_PAGE = pa.struct([("leaf", pa.bool_()), *((name, pa.binary()) for name in ("keys", "vectors", "radii", "parents"))])
_TREES = pa.schema(
    [("dim", pa.int32()), ("group", pa.int64()), ("top", pa.float64()), ("centre", pa.binary()), ("radius", pa.float64()), ("pages", pa.list_(_PAGE))]
)
TREES = (
    "dim int, group long, top double, centre binary, radius double, "
    "pages array<struct<leaf: boolean, keys: binary, vectors: binary, radii: binary, parents: binary>>"
)


@dataclass
class Page:
    leaf: bool
    keys: np.ndarray  # child pages, or ids of a leaf's vectors
    vectors: np.ndarray  # routing points with the further coordinate, or integer vectors
    radii: np.ndarray
    parents: np.ndarray  # distance to the routing point of the page


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def build(ids: np.ndarray, vectors: np.ndarray) -> list[Page]:
    """Pages of a tree, the root first. ``vectors``: integers, a row for each id."""
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    points = np.column_stack([vectors.astype(np.float64), np.sqrt(np.maximum(norms.max() - norms, 0))])
    rng = np.random.default_rng(len(ids))
    pages: list[Page | None] = []

    def split(rows: np.ndarray, router: np.ndarray) -> int:
        number = len(pages)
        pages.append(None)
        if len(rows) <= LEAF:
            pages[number] = Page(True, ids[rows], vectors[rows], np.zeros(len(rows)), _distances(points[rows], router))
            return number
        wanted = min(FANOUT, -(-len(rows) // LEAF) + 1)
        seeds = points[rng.choice(rows, wanted, replace=False)]
        own = np.argmin(((points[rows] ** 2).sum(axis=1)[:, None] - 2 * points[rows] @ seeds.T) + (seeds**2).sum(axis=1), axis=1)
        groups = [rows[own == j] for j in range(wanted)]
        if max(map(len, groups)) > 0.9 * len(rows):  # nearly all alike: deal them out evenly
            groups = np.array_split(rows[np.argsort(own, kind="stable")], wanted)
        keys, centres, radii, parents = [], [], [], []
        for group in groups:
            if not len(group):
                continue
            centre = points[group[np.argmin(_distances(points[group], points[group].mean(axis=0)))]]
            keys.append(split(group, centre))
            centres.append(centre)
            radii.append(_distances(points[group], centre).max())
            parents.append(np.sqrt(((centre - router) ** 2).sum()))
        pages[number] = Page(False, np.array(keys), np.array(centres), np.array(radii), np.array(parents))
        return number

    split(np.arange(len(ids)), points[0])
    root = pages[0]
    root.parents = np.full(len(root.keys), np.nan)  # the root has no routing point
    return pages


def search(pages: list[Page], query: np.ndarray, own_id: int | None, k: int, top: float, best: list[tuple[int, int]]) -> None:
    """Puts a tree's vectors into ``best``, a heap of the k best (score, -id) so far, the worst on top.
    ``top``: the tree's largest squared norm."""
    q = query.astype(np.float64)
    square = float(q @ q)
    slack = SLACK * (np.sqrt(square) + np.sqrt(top) + 1) + 1e-9
    point = np.append(q, 0.0)
    bound = np.sqrt(max(square + top - 2.0 * best[0][0], 0.0)) + slack if len(best) == k else np.inf
    queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
    while queue:
        least, number, to_router = heapq.heappop(queue)
        if least > bound:
            break
        page = pages[number]
        near = slice(None)
        if to_router == to_router and bound < np.inf:
            gap = np.abs(to_router - page.parents) - page.radii
            near = np.flatnonzero(gap <= bound + slack)
            if not len(near):
                continue
        if page.leaf:
            scores = page.vectors[near] @ query
            keys = page.keys[near]
            if len(best) == k:
                some = np.flatnonzero(scores >= best[0][0])
                scores, keys = scores[some], keys[some]
            for score, key in zip(scores.tolist(), keys.tolist(), strict=True):
                if key == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -key))
                elif (score, -key) > best[0]:
                    heapq.heapreplace(best, (score, -key))
            if len(best) == k:
                bound = np.sqrt(max(square + top - 2.0 * best[0][0], 0.0)) + slack
        else:
            d = _distances(page.vectors[near], point)
            low = np.maximum(d - page.radii[near], 0.0) - slack
            for a, key, b in zip(low.tolist(), page.keys[near].tolist(), d.tolist(), strict=True):
                if a <= bound:
                    heapq.heappush(queue, (a, key, b))


def quantised(embedding: Column) -> Column:
    """floor(1024 x) of each component; null where a component is null or not finite, or the vector is."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024).cast("long")))


def _near_order(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """An order of rows in which neighbours lie near one of some pivots, far from each other."""
    x = vectors.astype(np.float64)
    nearest, owner = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    at = 0
    for p in range(pivots):
        d = _distances(x, x[at])
        owner[d < nearest] = p
        nearest = np.minimum(nearest, d)
        at = int(nearest.argmax())
    return np.lexsort((nearest, owner))


def _build_group(dim: int, ids: np.ndarray, vectors: np.ndarray, group: int, tree: int) -> pa.RecordBatch:
    order, trees = _near_order(vectors, -(-len(ids) // tree)), []
    for i in range(0, len(ids), tree):
        own = order[i : i + tree]
        x = vectors[own].astype(np.float64)
        centre = x.mean(axis=0)
        pages = [
            {
                "leaf": p.leaf,
                "keys": p.keys.astype("<i8").tobytes(),
                "vectors": p.vectors.astype("<i8" if p.leaf else "<f8").tobytes(),
                "radii": p.radii.astype("<f8").tobytes(),
                "parents": p.parents.astype("<f8").tobytes(),
            }
            for p in build(ids[own], vectors[own])
        ]
        trees.append(
            {
                "dim": dim,
                "group": group,
                "top": float((x**2).sum(axis=1).max()),
                "centre": centre.astype("<f8").tobytes(),
                "radius": float(_distances(x, centre).max()),
                "pages": pages,
            }
        )
    return pa.RecordBatch.from_pylist(trees, _TREES)


def _build(tree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            lists = batch.column(1)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                a, b = waiting.setdefault(dim, ([], []))
                a.append(ids[own])
                b.append(values[at[own][:, None] + np.arange(dim)].reshape(len(own), dim))
                most = tree * max(1, min(GROUP, GROUP_BYTES // (8 * tree * max(dim, 1))))
                if sum(map(len, a)) >= most:
                    x, y = np.concatenate(a), np.concatenate(b)
                    whole = len(x) // most * most
                    for i in range(0, whole, most):
                        group += 1
                        yield _build_group(dim, x[i : i + most], y[i : i + most], group, tree)
                    waiting[dim] = ([x[whole:]], [y[whole:]])
        for dim, (a, b) in waiting.items():
            x = np.concatenate(a)
            if len(x):
                group += 1
                yield _build_group(dim, x, np.concatenate(b), group, tree)

    return run


def index(vectors: DataFrame, tree: int = TREE) -> DataFrame:
    """A row per tree of at most ``tree`` rows over ``vectors`` (id long, vector array<long>); no vector is left out."""
    return vectors.mapInArrow(_build(tree), TREES)


def _pages(rows: list[dict], dim: int) -> list[Page]:
    return [
        Page(
            r["leaf"],
            np.frombuffer(r["keys"], "<i8"),
            np.frombuffer(r["vectors"], "<i8" if r["leaf"] else "<f8").reshape(-1, dim if r["leaf"] else dim + 1),
            np.frombuffer(r["radii"], "<f8"),
            np.frombuffer(r["parents"], "<f8"),
        )
        for r in rows
    ]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(trees) and len(blocks):
            dim = trees.column("dim")[0].as_py()
            held = [_pages(p, dim) for p in trees.column("pages").to_pylist()]
            tops = trees.column("top").to_pylist()
            centres = np.stack([np.frombuffer(c, "<f8") for c in trees.column("centre").to_pylist()])
            radii = np.array(trees.column("radius").to_pylist())
            for block in blocks.column("queries").to_pylist():
                for q in block:
                    vector = np.array(q["vector"], np.int64)
                    norm = np.sqrt(float((vector.astype(np.float64) ** 2).sum()))
                    # no vector of a tree has a higher score than its centre's and the radius' share
                    most = centres @ vector + norm * radii
                    most += SLACK * (np.abs(most) + norm * (np.sqrt(tops) + 1)) + 1e-6
                    best: list[tuple[int, int]] = []
                    for t in np.argsort(-most).tolist():
                        if len(best) == k and most[t] < best[0][0]:
                            break
                        search(held[t], vector, q["id"], k, tops[t], best)
                    out += [(q["id"], -i, s) for s, i in best]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, tree: int = TREE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors of each query but its own row.

    Both frames: id long, vector array<long>, in this order; more columns are an error.
    Null vectors take no part; vectors are compared with those of the same length; empty
    tables give no rows; repeated ids are separate candidates, but none is its own
    query's. Queries are dealt by a hash into blocks of about ``block``; every block
    meets every group of trees in a task of its own, which holds these two only.
    """
    scratch = Scratch(vectors.sparkSession, "mtree")
    trees = scratch.save(index(vectors.toDF("id", "vector").filter("vector is not null and id is not null"), tree), "trees")
    asked = queries.toDF("id", "vector").filter("vector is not null and id is not null").distinct()
    asked = scratch.save(asked.withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))).groupBy("dim", "block").agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    # the groups' names are few and small: a row for some 65,000 vectors
    groups = trees.select(F.col("dim").alias("d"), F.col("group").alias("g")).distinct()
    meets = dealt.join(groups, F.col("dim") == F.col("d")).select("d", "g", F.col("block").alias("b"), "queries")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    found = (
        trees.select("*", every)
        .groupBy("dim", "group", "block")
        .cogroup(meets.groupBy("d", "g", "b"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
