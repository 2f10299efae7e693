"""Token-id files by bit-plane shuffling.

A file holds the ids of documents in ascending id order. Ids are cut into blocks
of BLOCK; a block is transposed into byte planes (all lowest bytes, all second
bytes, ...) or bit planes, every plane is compressed with zstandard on its own,
and planes that are all zero cost nothing. A footer keeps the chunk index (place,
count and plane sizes of each block) and the documents' ids and lengths.

    file   := MAGIC block* footer u64(footer length) MAGIC
    footer := zstd( u32 header length, JSON header, doc ids i64, null flags u8, lengths i64 )

Executors write files straight to the shared folder under names of their own; a
file counts once its row stands in the committed index, so lost or repeated
tasks leave no trace in what is read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsluice.llm.common import Scratch, tidy
from textsluice.llm.tokens import chunks, default_tokenizer, encoder

MAGIC = b"TSBP0001"
BLOCK = 65_536
INDEX = "part int, path string, docs long, ids long, bytes long"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of a block, lowest first, as far as the largest id needs them."""
    top = int(ids.max()) if len(ids) else 0
    if kind == "byte":
        own = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
        return [own[:, k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1) != 0).tobytes() for k in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(plane, np.uint8).astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    def __init__(self, sink, kind: str = "byte", level: int = 3) -> None:
        self.sink, self.kind, self.zstd = sink, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.held, self.waiting = len(MAGIC), [], [], 0
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        sink.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs += docs
        self.lengths.append(lengths)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            rest = np.concatenate(self.held)
            whole = len(rest) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(rest[i : i + BLOCK])
            self.held, self.waiting = [rest[whole:]], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        if self.waiting:
            self._block(np.concatenate(self.held))
        head = json.dumps({"kind": self.kind, "block": BLOCK, "docs": len(self.docs), "chunks": self.index}).encode()
        lengths = np.concatenate([*self.lengths, np.zeros(0, np.int64)]).astype("<i8")
        ids = np.array([d or 0 for d in self.docs], "<i8")
        none = np.array([d is None for d in self.docs], np.uint8)
        foot = self.zstd.compress(struct.pack("<I", len(head)) + head + ids.tobytes() + none.tobytes() + lengths.tobytes())
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return len(self.docs), int(lengths.sum()), self.at + len(foot) + 8 + len(MAGIC)


class PlaneReader:
    def __init__(self, source) -> None:
        """``source``: a seekable binary file."""
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        source.seek(end - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a bit-plane file, or cut off")
        n = struct.unpack("<Q", tail[:8])[0]
        source.seek(end - 8 - len(MAGIC) - n)
        foot = self.zstd.decompress(source.read(n))
        size = struct.unpack_from("<I", foot)[0]
        self.head = json.loads(foot[4 : 4 + size])
        docs, at = self.head["docs"], 4 + size
        ids = np.frombuffer(foot, "<i8", docs, at)
        none = np.frombuffer(foot, np.uint8, docs, at + 8 * docs)
        self.lengths = np.frombuffer(foot, "<i8", docs, at + 9 * docs)
        self.docs = [None if x else int(d) for d, x in zip(ids, none, strict=True)]
        self.first = np.cumsum([0, *(n for _, n, _ in self.head["chunks"])])

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.head["chunks"][k]
        self.source.seek(at)
        return from_planes([self.zstd.decompress(self.source.read(s)) for s in sizes], n, self.head["kind"])

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file; only the blocks that hold them are read."""
        if end <= begin:
            return np.zeros(0, "<u4")
        lo, hi = np.searchsorted(self.first, [begin, end - 1], "right") - 1
        held = np.concatenate([self.block(k) for k in range(lo, hi + 1)])
        return held[begin - self.first[lo] : end - self.first[lo]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first id's number in the file, and pieces of its ids, in order."""
        k, block, used, start = -1, np.zeros(0, "<u4"), 0, 0
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            pieces, need = [], n
            while need:
                if used == len(block):
                    k, used = k + 1, 0
                    block = self.block(k)
                take = min(need, len(block) - used)
                pieces.append(block[used : used + take])
                used, need = used + take, need - take
            yield doc, start, pieces
            start += n


def _write(folder: str, tokenizer: str, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, sink = TaskContext.get().partitionId(), None, None
        fs, top = pafs.FileSystem.from_uri(folder)
        path = f"{top}/part-{part:06d}-{uuid.uuid4().hex}.bp"
        words = encoder(tokenizer)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1)):
                if writer is None:
                    fs.create_dir(top, recursive=True)
                    sink = fs.open_output_stream(path)
                    writer = PlaneWriter(sink, kind)
                writer.add(docs[at : at + len(texts)], *words.encode(texts))
        if writer is not None:
            counts = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": path, "docs": counts[0], "ids": counts[1], "bytes": counts[2]}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
            )

    return write


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str | None = None, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes every whole text and writes files to ``folder``, a URI that all executors share.

    Returns the index, not yet run: one row per file. Files in ``part`` order hold
    the documents in ascending id order (null ids first, ties by text); other columns are ignored. Null
    text counts as empty and has the end id alone; an empty table writes nothing.
    """
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(tidy(_write(folder, tokenizer or default_tokenizer(), kind), encodes=True), INDEX)
    )


def _read(folder: str):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    rows = []
                    for doc, start, pieces in PlaneReader(source).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                        rows.append((doc, base + start, sum(map(len, pieces)), crc))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return read


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.select("part", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "part").mapInArrow(
        tidy(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte") -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and returns what the files hold."""
    scratch = Scratch(docs.sparkSession, "ids")
    folder = f"{scratch.path}/files"
    # one file of the index, not one for every row: each that is made starts processes beside the executor
    index = scratch.save(write_ids(docs, folder, tokenizer, kind).repartition(1), "index", texts=True)
    return read_ids(index, folder)
