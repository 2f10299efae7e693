"""Shared helpers: scratch tables in the cluster's shared folder, ASCII words, row hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


#: Whether the shuffle files of a finished query go at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: How many rows go to Python at a time, and how many where they are whole texts.
BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: Folders made here, by application.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where a local session
    names none, a temporary one; on a cluster executors could not read that, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="textsluice-")
        root = _OWN[app]
    return root.rstrip("/")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Batches, encodes: bool = False) -> Batches:
    """``run``, giving freed memory back to the system at the end of a task: workers live on for other stages.
    Unless it ``encodes``, encoders that an earlier stage left in the worker, with their caches, go first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("textsluice.llm.tokens")
        if tokens and not encodes and tokens.encoder.cache_info().currsize:
            tokens.encoder.cache_clear()
            _give_back()
        yield from run(batches)
        _give_back()

    return wrapped


class Scratch:
    """Tables and files of one operator call, under the shared folder.

    ``save`` writes a frame as Parquet and reads it back, which cuts lineage at a
    copy that any executor can read again; the shuffle files behind it are removed.
    ``drop`` frees a table early; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.tables: set[str] = set()
        self.path = f"{shared_root(spark)}/textsluice/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.path)

    def save(self, df: DataFrame, table: str, texts: bool = False) -> DataFrame:
        """``texts``: whole texts go to Python, so fewer rows at a time."""
        path, conf = f"{self.path}/{table}", self.spark.conf
        self.tables.add(table)
        before = {CLEANUP: conf.get(CLEANUP, "false"), BATCH: conf.get(BATCH)}
        conf.set(CLEANUP, "true")  # the copy replaces them
        if texts:
            conf.set(BATCH, min(TEXT_ROWS, int(before[BATCH])))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Lets the driver notice which joins' broadcasts are out of use, so that the executors drop them."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: str) -> None:
        for table in tables:
            self.tables.discard(table)
            self._remove(f"{self.path}/{table}")

    def keep(self, *tables: str) -> None:
        """Drops all tables but these, once no frame in use reads the others."""
        self.drop(*(self.tables - set(tables)))

    def _remove(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        if jvm is None or jsc is None:  # the session has ended
            return
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # at exit the JVM may already be gone
            pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
