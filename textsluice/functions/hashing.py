"""FNV-1a, SimHash and Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & MASK
    return h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def simhash64(text: str, cache: dict[str, int] | None = None) -> int:
    """Majority of the token hashes' bits; 0 without tokens."""
    tokens = text.split()
    if not tokens:
        return 0
    cache = {} if cache is None else cache
    hashes = []
    for t in tokens:
        if t not in cache:
            cache[t] = fnv1a64(t.encode())
        hashes.append(cache[t])
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    votes = 2 * bits.sum(axis=0) - len(tokens)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


@F.arrow_udf(LongType())
def fnv1a(texts: pa.Array) -> pa.Array:
    """FNV-1a 64 of the UTF-8 bytes, as a signed long."""
    return pa.array([None if t is None else _signed(fnv1a64(t.encode())) for t in texts.to_pylist()], pa.int64())


@F.arrow_udf(LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """SimHash 64 of the tokens between white space, as a signed long."""
    cache: dict[str, int] = {}
    return pa.array([None if t is None else _signed(simhash64(t, cache)) for t in texts.to_pylist()], pa.int64())


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
