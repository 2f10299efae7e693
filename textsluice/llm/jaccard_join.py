"""Near-duplicate documents: a Jaccard join on word shingles by token-combination prefixes.

Two sets that link share so many shingles that they also share some within their
prefixes under any common order. Shingles are ordered by document frequency,
rarest first. A rare shingle in the prefix is a signature by itself. Frequent
ones would give long lists, so they are dealt into sub-classes by a hash, and
what is indexed are pairs (or triples, of the most frequent) of shingles of one
sub-class. A sub-class of k-combinations wastes k - 1 shingles, so the prefix is
extended until ``sum(max(0, n_i - k_i + 1))`` over sub-classes exceeds the number
of shingles that may differ; then some sub-class must have k in common. How
many sub-classes there are depends on the smaller set's size bucket; a set is
indexed for each bucket that its smaller partner can lie in.

Equal sets are one node throughout. Since only components are asked for, pairs of
one component need no check: two rounds link the members of each list to one of
them, components are joined, and only pairs of a list that then still lie in
different components are all verified. Verification is exact, on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsluice.llm.bloom_dedup import members
from textsluice.llm.common import Scratch, tidy
from textsluice.llm.components import components
from textsluice.llm.tokens import chunks

WORDS = 5
#: Document frequencies from which shingles are put in order, and from which pairs and triples are indexed.
ORDER_FROM, PAIRS_FROM, TRIPLES_FROM = 3, 32, 2048
#: How many shingles with their frequencies are broadcast at most (12 bytes each).
FREQUENT = 2_000_000
FLUSH = 2_000_000
#: Bits of the smallest parity map; larger sets have larger ones.
MAP_BITS = 512
#: Rows of one signature in a batch from which it is listed by batch, with two rows a stretch for the list of all.
HOT = 64
#: Nodes of a signature that are compared with each other, or with so many more, in one go.
BLOCK = 2048
#: Partners of a node that are verified in one go.
PARTNERS = 32
#: Longest lists of a node that its rows in other lists know of, so that a pair is made in one list.
LONGEST = 16

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(at[0]), int(at[-1] - at[0]))
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    at = upto[at - at[0]]
    coded = flat.filter(real).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    n = len(h) - WORDS + 1
    rolled = _mix(sum((h[j : n + j] * _ODD[j] for j in range(WORDS)), np.zeros(max(n, 0), np.uint64))) if n > 0 else h[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(_mix(np.array([(h[a:b] * _ODD[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(h[:0])
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte plane by byte plane."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _count(bits: int):
    """Per task: 40-bit shingle prints and the number of texts that hold them, by bucket."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        prints, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(prints, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(40 - bits))
        rows = [(k, p, m) for k, (p, m) in enumerate(zip(np.split(prints, cut), np.split(n, cut), strict=True)) if len(p)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([_squeeze(r[1]) for r in rows], pa.binary()),
                pa.array([zstandard.compress(r[2].astype("<u4").tobytes(), 1) for r in rows], pa.binary()),
            ],
            names=["bucket", "prints", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, part in chunks(batch.column(0)):
                for s in shingle_sets(part):
                    held.append(s >> np.uint64(24))
                    size += len(s)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return count


def _frequent(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints, n = [], []
    for batch in batches:
        prints += [_unsqueeze(x) for x in batch.column("prints").to_pylist()]
        n += [np.frombuffer(zstandard.decompress(x), "<u4") for x in batch.column("n").to_pylist()]
    all_prints, all_n = np.concatenate(prints), np.concatenate(n)
    order = np.argsort(all_prints, kind="stable")
    all_prints, all_n = all_prints[order], all_n[order]
    first = np.flatnonzero(np.concatenate([[True], all_prints[1:] != all_prints[:-1]]))
    df = np.add.reduceat(all_n.astype(np.int64), first)
    keep = df >= ORDER_FROM
    yield pa.RecordBatch.from_arrays([pa.array(all_prints[first][keep].astype(np.int64)), pa.array(df[keep])], names=["print", "df"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = (batch.column(k).to_numpy().astype(t).tobytes() for k, t in enumerate(("<u8", "<i4")))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in rows], names=["prints", "df"])


def frequent_shingles(docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Prints and document frequencies of shingles, counted over all texts, from ORDER_FROM on.

    At most FREQUENT, about: where more shingles reach ORDER_FROM, the bound rises. Any
    bound gives the same links, a lower one shorter lists.
    """
    rows = docs.count()
    bits = min(20, max(6, (rows // 2048).bit_length()))
    found = scratch.save(
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(tidy(_count(bits)), "bucket int, prints binary, n binary")
        .groupBy("bucket")
        .applyInArrow(_frequent, "print long, df long"),
        "frequent",
        texts=True,
    )
    total, least = found.count(), ORDER_FROM
    if total > FREQUENT:
        least = int(found.approxQuantile("df", [1 - FREQUENT / total], 0.001)[0]) + 1
    got = found.filter(F.col("df") >= least).mapInArrow(_pack, "prints binary, df binary").collect()  # a row a batch
    prints = np.frombuffer(b"".join(r.prints for r in got), "<u8")
    df = np.frombuffer(b"".join(r.df for r in got), "<i4")
    order = np.argsort(prints)
    return prints[order], df[order]


def may_differ(n: int, percent: int) -> int:
    """How many of n shingles a linked set may lack."""
    return n - -(-percent * n // 100)


def size_bucket(n: int) -> int:
    return (n.bit_length() - 1) // 2


def signatures(
    s: np.ndarray, prints: np.ndarray, df: np.ndarray, percent: int, pairs_from: int = PAIRS_FROM, triples_from: int = TRIPLES_FROM
) -> np.ndarray:
    """Signatures of a set: any two sets that link have one in common."""
    need = may_differ(len(s), percent) + 1
    own = s >> np.uint64(24)
    if len(prints):
        at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
        common = prints[at] == own
        rare = s[~common]
    else:
        common, rare = np.zeros(len(s), bool), s
    if len(rare) >= need:
        return rare[:need]
    freq, count = s[common], df[at[common]]
    order = np.lexsort((freq, count))
    freq, count = freq[order], count[order]
    rest, out = need - len(rare), [rare]
    least = -(-percent * len(s) // 100)
    for b in range(size_bucket(least), size_bucket(len(s)) + 1):  # all that a smaller partner can lie in
        # pigeonhole: 0.3 * 4**b sub-classes without a pair and 0.2 * 4**b without a triple hold 0.7 * 4**b shingles at most,
        # fewer than the 4**b or more in common; below 4 of them no pair is certain
        tag = np.array([b + 1], np.uint64) * _ODD[4]
        deal = _mix(freq ^ _ODD[3])
        pairs, triples = max(1, int(0.3 * 4**b)), int(0.2 * 4**b)
        pair_class, triple_class = (deal % np.uint64(pairs)).tolist(), (deal % np.uint64(max(1, triples))).tolist()
        groups: dict[tuple[int, int], list[int]] = {}
        singles, tagged, left = [], [], rest
        for i, c in enumerate(count.tolist()):
            if c < pairs_from or b == 0:
                (singles if c < pairs_from else tagged).append(i)
                left -= 1
            else:
                k = 3 if c >= triples_from and triples else 2
                group = groups.setdefault((k, triple_class[i] if k == 3 else pair_class[i]), [])
                group.append(i)
                left -= len(group) >= k
            if not left:
                break
        out += [freq[singles], _mix(freq[tagged] + tag)] if len(freq) else []
        for k in (2, 3):
            chosen = [c for (kk, _), g in groups.items() if kk == k for c in combinations(g, k)]
            if chosen:
                # by hash within a combination, which does not depend on the set
                members = np.sort(freq[np.array(chosen)], axis=1)
                out.append(_mix((members * _ODD[:k]).sum(axis=1, dtype=np.uint64) + tag))
    return np.unique(np.concatenate(out))


def parity_map(s: np.ndarray) -> bytes:
    """One bit for each remainder of shingles modulo the map's size: whether their number is odd. A set of n has a
    power of two of bits from n on; the halves of a map, xored, are the map of half the size."""
    bits = max(MAP_BITS, 1 << max(0, len(s) - 1).bit_length())
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool)).tobytes()


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether parity maps allow a link of sets with ``n`` shingles together. A shingle flips one bit of its
    set's map, so the bits that differ are at most as many as the shingles that do: no link is lost."""
    words = min(x.shape[1], y.shape[1])
    differ = np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum(axis=1).astype(np.int64)
    return (100 + percent) * differ <= (100 - percent) * n


def _spine(held, percent: int):
    def spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, df = held.value
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                sets = shingle_sets(part)
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                both = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        batch.column(2).slice(at, len(part)),
                        pa.array(np.arange(rid, rid + len(part))),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(both[:, 0]),
                        pa.array(both[:, 1]),
                        pa.array([signatures(s, prints, df, percent, PAIRS_FROM, TRIPLES_FROM).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                        pa.array([parity_map(s) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "print", "rid", "n", "hi", "lo", "sigs", "map"],
                )
                rid += len(part)

    return spine


def _explode(percent: int):
    """(sig, salt, node, n) of each signature of each node. A signature that many nodes of a batch have gets a list of
    its own there (salt other than 0); the list of all (salt 0) gets the least and the largest of each stretch of
    near sizes, one of which any near node of another batch is near to."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 33
        for batch in batches:
            salt += 1
            found = [np.frombuffer(x, "<i8") for x in batch.column("sigs").to_pylist()]
            many = [len(x) for x in found]
            sig = np.concatenate([*found, np.zeros(0, "<i8")])
            node = np.repeat(batch.column("node").to_numpy(), many)
            n = np.repeat(batch.column("n").to_numpy(), many).astype(np.int64)
            salts = np.zeros(len(sig), np.int64)
            order = np.argsort(sig, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], sig[order][1:] != sig[order][:-1]])) if len(sig) else np.zeros(0, np.int64)
            length = np.diff(np.append(first, len(sig)))
            ends = []
            for at, count in zip(first[length >= HOT].tolist(), length[length >= HOT].tolist(), strict=True):
                rows = order[at : at + count]
                rows = rows[np.argsort(n[rows], kind="stable")]
                salts[rows] = salt
                i, sizes = 0, n[rows]
                while i < count:
                    j = int(np.searchsorted(percent * sizes, 100 * sizes[i], "right")) - 1
                    ends += [rows[i], rows[j]] if j > i else [rows[i]]
                    i = j + 1
            both = np.concatenate([np.arange(len(sig)), np.array(ends, np.int64)])
            salts = np.concatenate([salts, np.zeros(len(ends), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[both]), pa.array(salts), pa.array(node[both]), pa.array(n[both], pa.int64())], names=["sig", "salt", "node", "n"]
            )

    return explode


def _close(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def _lists(percent: int):
    """Rows of lists (of a signature and salt) that two nodes or more of near sizes have, each with the node it is
    first compared to. Rows come in order of (signature, salt, size); a row counts if its neighbour in that order is near
    enough, or if it has a salt. The head of a stretch is its smallest node; a size beyond its reach begins a new one.
    What goes from batch to batch is one row and a head."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        linked = False  # whether the held row is near to the one before it
        head = (0, 0, 0, 0)  # signature, salt, node, size

        def heads(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal head
            sig, salt, node, size = head
            first = []
            for s, t, x, n in zip(*rows.T.tolist(), strict=True):
                if s != sig or t != salt or 100 * size < percent * n:
                    sig, salt, node, size = s, t, x, n
                first.append(node)
            head = (sig, salt, node, size)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows.T[[0, 2, 3]], np.array(first, np.int64))], names=["sig", "node", "n", "first"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)])
            if len(rows) < 2:
                held = rows
                continue
            near = (rows[1:, :2] == rows[:-1, :2]).all(axis=1) & _close(rows[1:, 3], rows[:-1, 3], percent)
            keep = near | np.concatenate([[linked], near[:-1]]) | (rows[:-1, 1] != 0)
            if keep.any():
                yield heads(rows[:-1][keep])
            held, linked = rows[-1:], bool(near[-1])
        if len(held) and (linked or held[0, 1]):
            yield heads(held)

    return lists


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maps folded to MAP_BITS, for lists, where a node stands many times."""
    for batch in batches:
        maps = [_fold(np.frombuffer(x, np.uint64).reshape(1, -1), MAP_BITS // 64).tobytes() for x in batch.column("map").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(maps, pa.binary())], names=["node", "map"])


def _pairs(every: bool, percent: int):
    """Pairs to verify from rows in order of (signature, block, other block, size): of different components, of sizes and
    parity maps that allow a link; of two blocks, only those across. Not ``every``: of the nodes of a block, only those of
    other components than the node before. A pair that an earlier list has too, as far as the rows tell (``before``), is made
    there alone. Goes on from batch to batch with those rows of the last list that can still pair."""

    def earlier(lists: pa.ListArray) -> np.ndarray:
        at = lists.offsets.to_numpy().astype(np.int64)
        many, flat = np.diff(at), lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
        out = np.zeros((len(lists), LONGEST), np.int64)
        out[np.repeat(np.arange(len(lists)), many), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], many)] = flat
        return out

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_maps, held_before = np.zeros((0, 7), np.int64), np.zeros((0, MAP_BITS // 64), np.uint64), np.zeros((0, LONGEST), np.int64)
        for batch in batches:
            new = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(7)], axis=1)
            if not len(new):
                continue
            rows = np.concatenate([held, new])
            maps = np.concatenate([held_maps, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, MAP_BITS // 64)])
            before = np.concatenate([held_before, earlier(batch.column(8))])
            fresh = len(held)
            _, low, high, own, n, node, comp = rows.T
            number = np.cumsum(np.concatenate([[False], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]))
            found = []
            i = np.arange(len(rows) - 1)
            d = 1
            while len(i):
                i = i[i + d < len(rows)]
                i = i[number[i] == number[i + d]]
                i = i[_close(n[i], n[i + d], percent)]  # sizes ascend: later ones are no closer
                use = i[(comp[i] != comp[i + d]) & (i + d >= fresh) & ((low[i] == high[i]) | (own[i] != own[i + d]))]
                use = use[_may_link(maps[use], maps[use + d], n[use] + n[use + d], percent)]
                x, y = before[use], before[use + d]
                again = np.zeros(len(use), bool)
                for k in range(LONGEST):
                    again |= ((x[:, k : k + 1] == y) & (y != 0)).any(axis=1)
                use = use[~again]
                if len(use):
                    found.append(np.unique(np.stack([np.minimum(node[use], node[use + d]), np.maximum(node[use], node[use + d])], axis=1), axis=0))
                    if sum(map(len, found)) > 1_000_000:
                        yield out(found)
                        found = []
                d += 1
                if not every:
                    break
            if found:
                yield out(found)
            last = np.flatnonzero(number == number[-1])
            last = last[_close(n[last], n[-1:], percent)] if every else last[-1:]
            held, held_maps, held_before = rows[last], maps[last], before[last]

    return pairs


def _allowed(percent: int):
    """The pairs (a, b) whose whole parity maps allow a link."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            n = batch.column("n").to_numpy().astype(np.int64)
            sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
            ok = np.zeros(len(n), bool)
            for p, q in np.unique(sizes, axis=0).tolist():
                at = np.flatnonzero((sizes[:, 0] == p) & (sizes[:, 1] == q))
                own = (np.frombuffer(b"".join([z[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1) for z in (x, y))
                ok[at] = _may_link(*own, n[at], percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return allowed


def _verify(percent: int):
    """Links among rows in order of (a, part, role): a row of a's own text, then its partners' texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for at, part in chunks(batch.column("text")):
                rows = batch.slice(at, len(part))
                for x, role, b, s in zip(*(rows.column(c).to_pylist() for c in ("a", "role", "b")), shingle_sets(part), strict=True):
                    if role == 0:
                        a, own = x, s
                        continue
                    assert a == x
                    small, big = (s, own) if len(s) < len(own) else (own, s)
                    found = np.minimum(np.searchsorted(big, small), len(big) - 1)
                    both = int((big[found] == small).sum())
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return verify


def _links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame | None:
    """The pairs (a, b) that link; None where the maps already exclude all.

    Whole parity maps decide most pairs; only for the rest are texts fetched, each once, and only rows that a filter of
    the wanted ones lets through are shuffled. A node with many partners is dealt into parts of about PARTNERS of them.
    """
    first = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("x"))
    second = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y"))
    left = scratch.save(
        pairs.join(first, "a").join(second, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(_allowed(percent), "a long, b long"),
        f"{name}-left",
    )
    if left.isEmpty():
        return None
    many = left.groupBy("a").agg(F.count("*").alias("partners"))
    dealt = scratch.save(
        left.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / PARTNERS)).cast("int").alias("part")), f"{name}-pairs"
    )
    wanted = scratch.save(
        dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct().join(nodes, "node").select("node", F.col("doc_id").alias("d"), F.col("print").alias("p")),
        f"{name}-wanted",
    )
    asked, filter_ = members(wanted.select(F.xxhash64("d", "p").alias("h")), wanted.count())
    texts = scratch.save(
        rows.filter(asked(F.xxhash64("doc_id", "print")))
        .join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")))
        .groupBy("node")
        .agg(F.min("text").alias("text")),
        f"{name}-texts",
    )
    filter_.destroy()
    partners = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    owners = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    both = owners.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text").unionByName(partners)
    links = scratch.save(
        both.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(tidy(_verify(percent)), "a long, b long"), f"{name}-links", texts=True
    )
    scratch.drop(*(f"{name}-{x}" for x in ("left", "pairs", "wanted", "texts")))
    scratch.free()
    return links


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id.

    Texts link where their sets of WORDS-word shingles have a Jaccard similarity of
    ``percent`` hundredths or more; component_id is the smallest id reachable by
    links. Texts without words, or null, have no shingles and stand alone. Rows with
    equal texts fall together; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    held = spark.sparkContext.broadcast(frequent_shingles(docs, text_col, scratch))  # at most FREQUENT of them
    scratch.drop("frequent")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("print"))
    spine = scratch.save(
        rows.mapInArrow(tidy(_spine(held, percent)), "doc_id long, print long, rid long, n int, hi long, lo long, sigs binary, map binary"), "spine", texts=True
    )
    held.destroy()
    scratch.free()
    some = spine.filter("n > 0")
    equal = scratch.save(
        some.groupBy("hi", "lo").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("rows")), "equal"
    )
    # only rows that may have an equal are shuffled to find the first of each
    several = equal.filter("rows > 1")
    repeated, filter_ = members(several.select(F.xxhash64("hi", "lo").alias("h")), several.count())
    marked = some.withColumn("repeated", repeated(F.xxhash64("hi", "lo")))
    one = marked.filter("not repeated").unionByName(marked.filter("repeated").join(equal.select(F.col("node").alias("rid")), "rid", "left_semi"))
    lists = scratch.save(
        one.select(F.col("rid").alias("node"), "n", "sigs")
        .mapInArrow(tidy(_explode(percent)), "sig long, salt long, node long, n long")
        .repartition("sig", "salt")
        .sortWithinPartitions("sig", "salt", "n", "node")
        .mapInArrow(tidy(_lists(percent)), "sig long, node long, n long, first long"),
        "lists",
    )
    nodes = scratch.save(
        one.withColumnRenamed("rid", "node").join(lists.select("node").distinct(), "node", "left_semi").select("node", "n", "doc_id", "print", "map"), "nodes"
    )
    filter_.destroy()
    scratch.free()
    stars = scratch.save(lists.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    found = _links(stars, rows, nodes, percent, scratch, "star")
    links = stars.limit(0) if found is None else found
    roots = None
    small = nodes.mapInArrow(_small, "node long, map binary")
    for name, every in (("chain", False), ("rest", True)):
        if roots is None:
            roots = scratch.save(components(links, scratch, f"{name}-cc"), f"{name}-roots")
        placed = lists.select("sig", "node", "n").join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("root"))
        # of lists with the same nodes one is enough: they have the same sums of hashes
        sums = [F.sum(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 32))).alias(f"sum{k}") for k in range(3)]
        mixed = placed.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("rows"), *sums).filter("p <> q")
        mixed = mixed.groupBy("p", "q", "rows", "sum0", "sum1", "sum2").agg(F.min("sig").alias("sig"))
        blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
        dealt = placed.join(mixed.select("sig", "rows", blocks.alias("blocks")), "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        dealt = scratch.save(dealt.withColumn("place", F.struct((-F.col("rows")).alias("rows"), "sig")), f"{name}-dealt")
        if every:  # lists in order of length, then signature
            longest = dealt.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("place")), 1, LONGEST).alias("longest"))
            dealt = dealt.join(longest, "node").withColumn("before", F.transform(F.filter("longest", lambda x: x < F.col("place")), lambda x: x["sig"]))
        else:
            dealt = dealt.withColumn("before", F.array().cast("array<long>"))
        other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1) if every else F.array("own")
        pairs = scratch.save(
            dealt.select("sig", "own", "n", "node", "root", "before", F.explode(other).alias("other"))
            .select("sig", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "n", "node", "root", "before")
            .join(small, "node")
            .select("sig", "low", "high", "own", "n", "node", "root", "map", "before")
            .repartition("sig", "low", "high")
            .sortWithinPartitions("sig", "low", "high", "n", F.xxhash64("node", "sig"))
            .mapInArrow(tidy(_pairs(every, percent)), "a long, b long")
            .distinct(),
            f"{name}-found",
        )
        found = _links(pairs, rows, nodes, percent, scratch, name)
        scratch.drop(f"{name}-found", f"{name}-dealt")
        if found is not None:
            links, roots = scratch.save(links.unionByName(found), f"{name}-all"), None
    scratch.drop("lists", "nodes")
    if roots is None:
        roots = components(links, scratch, "last-cc")
    placed = scratch.save(
        equal.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"), "least"), "placed"
    )
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.save(placed.join(names, "root").select("hi", "lo", "component_id"), "named")
    alone = spine.filter("n = 0").select(F.col("doc_id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = scratch.save(
        some.join(named, ["hi", "lo"])
        .select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(alone),
        "result",
    )
    scratch.keep("result")
    return result


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of :func:`near_groups`, the one of the smallest id.

    All columns stay. Rows without an id, and texts without words, stay.
    """
    groups = near_groups(docs, percent, id_col, text_col)
    gone = groups.filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
