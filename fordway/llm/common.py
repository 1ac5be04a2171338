"""What the text operators share: inputs, the shared folder, stored tables, byte-balanced Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
LOWER_TABLE = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir. Where that is unset, as in tests, a folder of
    our own, but only if everything runs on this machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fordway-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path as Hadoop knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Workspace:
    """A folder below the shared one, for the tables of one run.

    store() writes a table and reads it back, which cuts its lineage: whatever executor is lost later, the rows are
    still there. drop() removes a table that is no longer read, keep() all but some; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = filesystem(self.spark, self.path(name))
            fs.delete(at, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but the named ones: what led to a result that is stored."""
        fs, at = filesystem(self.spark, self.root)
        for x in fs.listStatus(at):
            if x.getPath().getName() not in names:
                fs.delete(x.getPath(), True)

    def close(self) -> None:
        try:
            fs, at = filesystem(self.spark, self.root)
            fs.delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before the driver
            pass


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have about `most` bytes at most; a longer text stands alone."""
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in _views(batch.column(column))]
        start = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def _views(column: pa.Array) -> Iterator[memoryview | None]:
    for x in column:
        b = x.as_buffer()
        yield None if b is None else memoryview(b)


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles among objects while a batch is worked on, nor among those that stay after it: for tables
    that are large and hold no cycles. give_back() undoes it at a task's end."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and other tasks' memory counts beside it."""
    gc.unfreeze()  # what a task set aside from collection
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_texts(df: DataFrame, keep: list[str], text_col: str, schema: str, make: Callable[[], Callable[[list[str]], dict[str, list]]], most: int = 4 << 20) -> DataFrame:
    """The kept columns and those of `schema`, a row for each input row, by a function over byte-balanced batches.

    `make` is called once for each task and gives the function; that gets the texts and returns the new columns. Kept
    columns go through as Arrow arrays. Only they and the text leave the scan, under names of our own, so extra
    columns never clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    inner = {k: f"k{i}" for i, k in enumerate(keep)}
    text = inner.get(text_col, "t")
    slim = df.select(*[df[k].alias(n) for k, n in inner.items()], *([] if text_col in inner else [df[text_col].alias(text)]))
    new = _parse_datatype_string(schema)
    kind = StructType([*(StructField(n, df.schema[k].dataType) for k, n in inner.items()), *(StructField(f"n{i}", f.dataType) for i, f in enumerate(new))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        out = to_arrow_schema(kind)
        for part in by_bytes(batches, text, most):
            got = f(texts(part.column(text)))
            kept = [part.column(n) for n in inner.values()]
            kept = [c if c.type == x.type else c.cast(x.type) for c, x in zip(kept, out, strict=False)]
            made = [pa.array(got[x.name], type=out.field(len(inner) + i).type) for i, x in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=out)
        del f
        give_back()

    return slim.mapInArrow(run, kind).toDF(*keep, *new.names)
