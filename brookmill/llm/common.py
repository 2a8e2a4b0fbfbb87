"""Shared-folder tables, batch helpers and the table reader used by every operator here."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task works on.
SLICE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of the data folder through Spark, whatever store the folder is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset, as in local
    tests, a temporary folder of this machine is taken and set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-brookmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the paths of tables written in between are noted, for whoever will drop them.
_noted: ContextVar[list[str] | None] = ContextVar("_noted", default=None)


@contextmanager
def noting_tables(paths: list[str]) -> Iterator[None]:
    """Adds the path of every table that ``written`` makes meanwhile."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables whose readers are done, and forgets them."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


#: Shuffle partitions that one file has at the least, where tables are gathered; those of a table of pairs of numbers.
GATHERED_PARTITIONS, GATHERED_PAIRS = 32, 128
#: Whether ``written`` gathers its tables.
_gathering: ContextVar[bool] = ContextVar("_gathering", default=False)


@contextmanager
def gathering_files() -> Iterator[None]:
    """Tables that ``written`` makes meanwhile have few files."""
    token = _gathering.set(True)
    try:
        yield
    finally:
        _gathering.reset(token)


def few_files(df: DataFrame, pairs: bool = False) -> DataFrame:
    """The same rows in a task a core, or one for GATHERED_PARTITIONS shuffle partitions if these are more.

    ``pairs``: rows of a number or two, of which a task takes GATHERED_PAIRS partitions.

    On a local file system without Hadoop's native library every file that is written starts
    some processes (chmod, for the file and its checksum), each of which shares the executor's
    whole memory until it has begun its own program.
    """
    spark = df.sparkSession
    tasks = parallelism(spark)
    return df.coalesce(max(1, tasks // GATHERED_PAIRS) if pairs else max(spark.sparkContext.defaultParallelism, tasks // GATHERED_PARTITIONS))


def written(df: DataFrame, name: str, gather: bool = True, pairs: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it back: the lineage ends there.

    A table whose rows name the task that made them is not to be gathered.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    if (noted := _noted.get()) is not None:
        noted.append(path)
    (few_files(df, pairs) if gather and _gathering.get() else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle meanwhile is deleted when each has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_CONF) if before is None else spark.conf.set(_CLEANUP_CONF, before)


#: Bytes of an Arrow batch between Spark and its Python tasks, where the session sets none.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about BATCH_BYTES, unless it sets a size itself.

    Both ends of a Python task hold whole batches outside the heap, which are 64 MB else.
    """
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def giving_back(run: Task) -> Task:
    """The same task; what it has freed goes back to the system when it ends.

    Spark keeps a Python worker for later tasks, and its memory counts while it waits.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what numpy frees
                trim(0)

    return task


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most`` bytes of ``column`` or ``rows`` rows, or one row."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        array = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(array).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            size = 0 if size != size else int(size)
            if i > start and (held + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def planes(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second bytes and so on: the planes that hold little compress well."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def lower_ascii(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(column, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(column.cast("string").cast("binary")) % folds
