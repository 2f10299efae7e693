"""Language identification by nearest centroids of TF-IDF byte n-grams.

Texts are lower-cased, everything but letters becomes a space, and 2- and 3-grams
of the UTF-8 bytes are hashed into DIM counts, weighted by IDF and normalised.
Each language has several centroids from spherical k-means, so that spellings,
registers and lengths that differ can keep centroids apart. The nearest centroid by
cosine names the language; a text that lies farther from it than the centroid's
own members ever did, by a margin, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsluice.llm.common import tidy
from textsluice.llm.tokens import chunks

HALF = 4096
DIM = 2 * HALF
UNKNOWN = "und"
#: Texts whose dense vectors are held at a time: short ones come many to a batch.
ROWS = 256

_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of the n-gram counts of each text."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    at = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = lower.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    b = _KEEP[raw].astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    grams2 = ((two * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    grams2[two == 0x2020] = -1
    three = (two[:-1] << np.uint32(8)) | b[2:]
    grams3 = ((three * np.uint32(0x85EBCA6B)) >> np.uint32(20)).astype(np.int64) + HALF
    grams3[(two[:-1] == 0x2020) | (two[1:] == 0x2020)] = -1
    grams2, grams3 = grams2 + 1, grams3 + 1
    for s, e in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
        found = np.bincount(grams2[s : max(s, e - 1)], minlength=DIM + 1)
        found += np.bincount(grams3[s : max(s, e - 2)], minlength=DIM + 1)
        yield np.sqrt(found[1:].astype(np.float32))


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # DIM x centroids, unit length
    floor: np.ndarray  # cosine below which a centroid rejects

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether the text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        names, scores, rejected = [], [], []
        known = has_letter(texts)
        few = ((at + i, part.slice(i, ROWS)) for at, part in chunks(texts, 1_000_000) for i in range(0, len(part), ROWS))
        for at, part in few:
            x = np.empty((len(part), DIM), np.float32)
            for i, row in enumerate(counts(part)):
                np.multiply(row, self.idf, out=x[i])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cos = x @ self.centroids
            best = cos.argmax(axis=1)
            own = cos[np.arange(len(best)), best]
            ok = known[at : at + len(part)]
            names += [self.languages[k] if y else UNKNOWN for k, y in zip(best, ok, strict=True)]
            scores.append(np.where(ok, np.clip(own, 0, 1), 0.0))
            rejected.append(~ok | (own < self.floor[best]))
        if not names:
            return [], np.zeros(0), np.zeros(0, bool)
        return names, np.concatenate(scores).astype(float), np.concatenate(rejected)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, part in chunks(batch.column(1)):
            at_, value = [], []
            for x in counts(part):
                k = np.flatnonzero(x)
                at_.append(k.astype("<u2").tobytes())
                value.append(x[k].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(part)), pa.array(at_, pa.binary()), pa.array(value, pa.binary())],
                names=["lang", "at", "value"],
            )


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from each other, the first near the mean."""
    mean = x.mean(axis=0)
    centroids = [x[int((x @ mean).argmax())]]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[int((x @ np.stack(centroids).T).max(axis=1).argmin())])
    c = np.stack(centroids)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(
    docs: DataFrame,
    train: Column,
    per_language: int = 500,
    clusters: int = 4,
    margin: float = 0.25,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """A model from at most about ``per_language`` rows of each language, chosen by a hash
    of the id, out of those where ``train`` holds, lang is set and the text has a letter."""
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    sizes = {r[0]: r[1] for r in docs.filter(train & F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], np.zeros(DIM, np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0))
    rate = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    dice = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    chosen = rows.filter(dice < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = sorted(
        (r.lang, bytes(r.at), bytes(r.value)) for r in chosen.mapInArrow(tidy(_vectors), "lang string, at binary, value binary").collect()
    )
    x = np.zeros((len(found), DIM), np.float32)
    for i, (_, at, value) in enumerate(found):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f4")
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lang = np.array([f[0] for f in found])
    languages, parts, floors = [], [], []
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        c = _kmeans(own, clusters)
        cos = own @ c.T
        best = cos.argmax(axis=1)
        for j in range(len(c)):
            languages.append(name)
            floors.append(margin * float(cos[best == j, j].min()) if (best == j).any() else 0.0)
        parts.append(c)
    if not parts:
        return Model([], idf, np.zeros((DIM, 0), np.float32), np.zeros(0))
    return Model(languages, idf, np.concatenate(parts).T.copy(), np.array(floors))


def _predictor(docs: DataFrame, model: Model):
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, rejected = held.value.predict(texts)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["lang_pred", "score", "rejected"],
        )

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    Null, empty and letterless texts are ``und`` with score 0 and rejected. All
    columns stay; the three new ones replace any of the same name. An untrained
    model answers ``und`` everywhere.
    """
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, _predictor(docs, model)(F.col(text_col).cast("string")).alias("found")).select(*rest, "found.*")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that the model does not reject."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = docs.select(row, _predictor(docs, model)(F.col(text_col).cast("string")).alias("found"))
    return found.filter(~F.col("found.rejected")).select("row.*")


def id_bucket(id_col: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id, which then is in no training set."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % buckets
