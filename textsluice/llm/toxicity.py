"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words in lower case and their beginnings and endings,
hashed; presence counts, not frequency. The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: beside each term's weight, pairs
of terms have a weight of their own through their factors, so that an insult
beside a group's name can weigh more than both apart.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsluice.llm.tokens import chunks

SPACE_BITS = 22
CACHE_WORDS = 400_000


def terms(word: str) -> list[int]:
    """Hashed terms of a word: itself, beginnings of 3 to 6 letters, endings of 4 and 5."""
    w = "".join(c for c in unicodedata.normalize("NFKC", word).lower() if c.isalpha())
    if not w:
        return []
    found = ["=" + w, *("^" + w[:n] for n in (3, 4, 5, 6) if len(w) >= n), *("$" + w[-n:] for n in (4, 5) if len(w) >= n)]
    return [zlib.crc32(x.encode()) >> (32 - SPACE_BITS) for x in found]


class Terms:
    """Distinct terms of each text of an array; ``keep`` maps hashed terms to columns, -1 to none."""

    def __init__(self, keep: np.ndarray | None = None) -> None:
        self.keep, self.cache = keep, {}

    def _of(self, word: str) -> bytes:
        found = np.array(terms(word), np.int64)
        if self.keep is not None:
            found = self.keep[found]
            found = found[found >= 0]
        return found.astype("<u4").tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows and terms of the distinct pairs, in order."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, known = self.cache, []
        for w in coded.dictionary.to_pylist():
            t = cache.get(w)
            if t is None:
                t = cache[w] = self._of(w)
            known.append(t)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        useful = size[code] > 0  # most words have no kept term
        pair = np.unique(row[useful] * len(known) + code[useful])
        row, code = pair // len(known), pair % len(known)
        n = size[code]
        term = flat[np.repeat(begin[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
        pair = np.unique((np.repeat(row, n) << SPACE_BITS) + term)
        return pair >> SPACE_BITS, pair & ((1 << SPACE_BITS) - 1)


@dataclass
class Machine:
    keep: np.ndarray  # hashed term -> column or -1
    bias: float
    w: np.ndarray
    v: np.ndarray  # terms x factors

    def logits(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(rows, self.w[cols], n)
        for k in range(self.v.shape[1]):
            own = self.v[cols, k]
            out += (np.bincount(rows, own, n) ** 2 - np.bincount(rows, own * own, n)) / 2
        return out


def learn(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, factors: int, rounds: int, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by full-batch Adam on the class-balanced log loss."""
    rng = np.random.default_rng(7)
    n = len(y)
    params = [np.zeros(1), np.zeros(width), rng.normal(0, 0.02, (width, factors))]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for step in range(1, rounds + 1):
        bias, w, v = params
        total = np.stack([np.bincount(rows, v[cols, k], n) for k in range(factors)], axis=1)
        square = sum(np.bincount(rows, v[cols, k] ** 2, n) for k in range(factors))
        z = bias[0] + np.bincount(rows, w[cols], n) + ((total**2).sum(axis=1) - square) / 2
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        own = g[rows]
        grads = [
            np.array([g.sum()]),
            np.bincount(cols, own, width) + l2 * w,
            np.stack([np.bincount(cols, own * (total[rows, k] - v[cols, k]), width) for k in range(factors)], axis=1) + 20 * l2 * v,
        ]
        for i, (p, d) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.99 * s[i] + 0.01 * d * d
            p -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Terms()
    for batch in batches:
        for at, part in chunks(batch.column(1)):
            rows, found = find(part)
            cut = np.searchsorted(rows, np.arange(1, len(part)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.array([x.astype("<u4").tobytes() for x in np.split(found, cut)], pa.binary())],
                names=["y", "terms"],
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    per_class: int = 3000,
    width: int = 4096,
    factors: int = 4,
    rounds: int = 150,
    l2: float = 1e-5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Machine:
    """A machine from at most about ``per_class`` labelled rows of each class where ``train`` holds.

    ``labels``: id, label 0/1; an id with several labels counts as toxic if one says
    so, null labels are left out. Of the hashed terms those stay, ``width`` at most,
    whose share differs most between the classes in standard errors. With one class
    only, or none, every score is that class's share.
    """
    own = labels.filter(train & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sizes = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    total = sum(sizes.values())
    nothing = np.full(1 << SPACE_BITS, -1, np.int32)
    if len(sizes) < 2:
        bias = 0.0 if not total else (9.0 if 1 in sizes else -9.0)
        return Machine(nothing, bias, np.zeros(0), np.zeros((0, factors)))
    dice = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    rate = F.when(F.col("y") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    chosen = own.filter(dice < rate).withColumnRenamed(id_col, "_id")
    got = (
        docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), F.col("i") == F.col("_id"))  # at most about 2 * per_class ids
        .select("y", "text")
        .mapInArrow(_term_rows, "y int, terms binary")
        .collect()
    )
    found = sorted((r.y, bytes(r.terms)) for r in got)
    y = np.array([f[0] for f in found], float)
    each = [np.frombuffer(t, "<u4") for _, t in found]
    if not len(y) or y.min() == y.max():
        return Machine(nothing, float(np.log((sizes[1] + 1) / (sizes[0] + 1))), np.zeros(0), np.zeros((0, factors)))
    cols, rows = np.concatenate(each).astype(np.int64), np.repeat(np.arange(len(y)), [len(t) for t in each])
    n1, n0 = y.sum(), (1 - y).sum()
    in1 = np.bincount(cols[y[rows] == 1], minlength=1 << SPACE_BITS)
    in0 = np.bincount(cols[y[rows] == 0], minlength=1 << SPACE_BITS)
    p = (in1 + in0 + 1) / (n1 + n0 + 2)
    z = np.abs(in1 / n1 - in0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[in1 + in0 < 4] = 0
    best = np.argsort(-z, kind="stable")[:width]
    best = np.sort(best[z[best] >= 5])
    keep = nothing
    keep[best] = np.arange(len(best))
    cols = keep[cols]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    bias, w, v = learn(rows, cols, y, len(best), factors, rounds, l2)
    return Machine(keep, bias + float(np.log(sizes[1] / sizes[0])), w, v)  # learned as if both classes were as frequent


def toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Whole texts are scored; null and empty ones get the score of no terms. All
    columns stay, and the two new ones replace any of the same name.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    state: dict[str, Terms] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = held.value
        find = state.setdefault("terms", Terms(own.keep))
        out = []
        for _, part in chunks(texts):
            z = own.logits(*find(part), len(part))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("score", "predicted")]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    scored = docs.select(row, score(F.col(text_col).cast("string")).alias("score")).select(*rest, "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
