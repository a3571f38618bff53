"""What the corpus operators share: the shared folder, written tables, Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters between words, for SQL patterns and for trimming.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bytes in a file of a written table: small tables go to few files, large ones to files of FILE bytes.
SMALL, FILE = 4 << 20, 16 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, under the one that the cluster names in spark.checkpoint.dir, that driver and executors see.

    Only where that setting is missing on a local master (tests) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + _temporary()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@lru_cache(maxsize=1)
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def plan_size(df: DataFrame) -> int:
    """Bytes of df as the optimizer estimates them: good for what is read from files, too high after joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def written(df: DataFrame, folder: str, name: str, size: int | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors.

    size: a bound of its bytes; with it a small table is written by few tasks, not one file for each
    shuffle partition.
    """
    path, spark = f"{folder}/{name}", df.sparkSession
    if size is not None:
        df = df.coalesce(max(min(1 + size // SMALL, 2 * spark.sparkContext.defaultParallelism), min(size // FILE, 1_000_000)))
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later job reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m"):
    """Jobs that run inside send so many rows and bytes at most to Python at once."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of batches after which the worker gives freed memory back, as one that waits for its next task keeps it otherwise."""

    @wraps(run)
    def give_back(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries don't have it
                ctypes.CDLL(None).malloc_trim(0)

    return give_back


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def new_folder(uri: str) -> str:
    """The folder, made if it isn't there."""
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)
    return uri


@contextlib.contextmanager
def attempt(folder: str, name: str):
    """A stream to a file that appears, under its name, when all is written: a task that runs again replaces it. Nothing written, no file."""
    fs, path = file_system(folder)
    part = f"{path}/.{name}-{TaskContext.get().taskAttemptId()}"

    out = _Lazy(lambda: fs.open_output_stream(part))
    try:
        yield out
    except BaseException:
        if out.stream is not None:
            out.stream.close()
            fs.delete_file(part)
        raise
    if out.stream is not None:
        out.stream.close()
        fs.move(part, f"{path}/{name}")


class _Lazy:
    """A file for writing that is made with its first bytes."""

    closed = False

    def __init__(self, make: Callable):
        self.make, self.stream = make, None

    def write(self, data) -> int:
        self.stream = self.stream or self.make()
        return self.stream.write(data)

    def flush(self) -> None:
        if self.stream is not None:
            self.stream.flush()

    def close(self) -> None:
        """The file is closed by who opened it."""

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False


class Home:
    """A file of a task's rows, which later tasks read again: rows are known by home and place in it.

    A task that runs again must get its rows in the same order, as it does from files: write what comes out of a
    shuffle before.
    """

    def __init__(self, root: str):
        task = TaskContext.get()
        self.number, self.row, self.writer = task.partitionId(), 0, None
        self.fs, self.path = file_system(root)
        self.part = f"{self.path}/.{self.number:06d}-{task.taskAttemptId()}"

    def write(self, batch: pa.RecordBatch) -> int:
        """Returns the place of the batch's first row."""
        if self.writer is None:
            self.out = self.fs.open_output_stream(self.part)
            self.writer = pa.ipc.new_stream(self.out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
        self.writer.write_batch(batch)
        row, self.row = self.row, self.row + batch.num_rows
        return row

    def __enter__(self) -> Home:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.writer is not None:
            self.writer.close()
            self.out.close()
            if kind is None:
                self.fs.move(self.part, f"{self.path}/{self.number:06d}")
            else:
                self.fs.delete_file(self.part)


def home_rows(root: str, batches: Iterator[pa.RecordBatch], work: Callable[[int, Iterator[pa.RecordBatch], pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """For sorted rows (home, ...), each home's rows together: work(home, the home file's batches, rows as a table)."""
    held: list[pa.RecordBatch] = []
    now = None

    def out():
        fs, path = file_system(root)
        with fs.open_input_stream(f"{path}/{now:06d}") as f:
            yield from work(now, pa.ipc.open_stream(f), pa.Table.from_batches(held))

    for batch in batches:
        homes = batch.column("home").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if now is not None and homes[a] != now:
                yield from out()
                held = []
            now = int(homes[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from out()


def words_of(text: Column) -> Column:
    """Words of a text, as an array: runs of anything but space, tab, line breaks, vertical tab, form feed. Null text: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about `most` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(size) // most
        at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
