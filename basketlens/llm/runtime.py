"""What the operators need from a session: the shared folder, the package on executors, cut lineage."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import struct
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import shared_folder, ship

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4_000_000
_lock, _depth, _before = threading.Lock(), [0], ["false"]


def ready(spark: SparkSession) -> None:
    """Sends this package to the executors, sees to a checkpoint folder, and bounds Arrow batches.

    The folder is the one that spark.checkpoint.dir names (session.shared_folder). Batches are bounded
    by rows as Spark comes, which lets ten thousand long texts into one; a bound in bytes is set unless
    the session has one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    ship(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there.

    The shuffle files behind them are removed as soon as the rows are written: nothing reads them
    again, and the next job writes its own.
    """
    spark = df.sparkSession
    ready(spark)
    with _lock:  # several threads can be here: the first sets, the last sets back
        _depth[0] += 1
        if _depth[0] == 1:
            _before[0] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        with _lock:
            _depth[0] -= 1
            if not _depth[0]:
                spark.conf.set(_CLEANUP, _before[0])


def dealt_anew(df: DataFrame, *columns: str) -> DataFrame:
    """df whose columns no longer count as the keys it is partitioned by: each is inverted twice.

    A join on them then shuffles this side, too, and only such joins does adaptive execution split
    where the other side has very many rows of one key. For sides that are small.
    """
    return df.withColumns({c: F.bitwise_not(F.bitwise_not(F.col(c))) for c in columns})


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def release() -> None:
    """Gives memory that Python holds but does not use back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def trimmed(f):
    """For functions on batches: a worker is kept for later tasks, but not the memory of this one."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, as a number."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def renamed(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, str], str]:
    """docs with names of our own, so that no column we add clashes; the names; and that of the text."""
    names = {x: fresh(f"own{i}") for i, x in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{x}`").alias(y) for x, y in names.items()]), names, names[text]


def text_keys(docs: DataFrame, text: str) -> DataFrame:
    """docs with k1 and k2, the halves of the MD5 of the text as little-endian longs; null is empty text."""
    half = lambda a: F.conv(F.concat(*[F.substring("__md5", a + 14 - 2 * i, 2) for i in range(8)]), 16, -10).cast("bigint")
    return docs.withColumn("__md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).withColumns({"k1": half(1), "k2": half(17)}).drop("__md5")


_HALVES = struct.Struct("<qq")


def text_key(text: bytes) -> tuple[int, int]:
    """As text_keys()."""
    return _HALVES.unpack(hashlib.md5(text).digest())
