"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``.  Only where it is unset and all runs on one machine (tests) a
    temporary folder is made and set for this session's context."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        place = sc.getCheckpointDir()
    if place is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), f"dealerlens-{uuid.uuid4().hex}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so that the loss of an
    executor never loses it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Memory that this worker process has freed goes back to the system, where libc can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: str):
    """``run`` for ``mapInArrow``; at the end of a task its worker, which Spark keeps for further
    tasks, empties the ``caches`` ("module:name") and gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        try:
            yield from run(batches)
        finally:
            for place in caches:
                module, name = place.split(":")
                getattr(sys.modules[f"{__package__}.{module}"], name).clear()
            give_back()

    return whole


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes (or a row) for what is planned meanwhile; no result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of two bigint columns that may be broadcast (about 16 MB as a relation).
BROADCAST_ROWS = 400_000


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` are below ``limit``; beyond
    it the planner chooses, and a shuffle join does the same work."""
    return F.broadcast(df) if rows <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def every_column(df: DataFrame) -> list:
    """The columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def doc_key_bucket(doc_id, buckets: int) -> int:
    """crc32 of the id as text, modulo ``buckets`` (the fold rule of the contracts);
    a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % buckets


def fold(column, buckets: int):
    """The same rule as a column."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def chosen_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows by the order of a hash of ``key``, for bounded samples.  A large input is
    first thinned by other bits of the hash to about 4 n rows, so that what all partitions
    offer together stays bounded as well."""
    total, bits = df.count(), 1 << 30
    h = F.xxhash64(key)
    if total > 8 * n:
        df = df.filter(F.pmod(h, F.lit(bits)) < max(1, bits * 4 * n // total))
    return df.orderBy(h, key).limit(n)
