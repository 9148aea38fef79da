"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset on one machine (a local master, as in tests) a temporary folder is
    made and remembered in the session; on a cluster it is an error, since a folder of one
    machine is read by no other.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyread-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of written tables by the scope that owns them; the outermost lasts as long as the
#: process and is emptied when it ends.
_scopes: list[list[str]] = [[]]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def delete_tables(spark: SparkSession) -> None:
    """Delete all written tables of this process; results that read them end with them."""
    for scope in _scopes:
        _delete(spark, scope)
        scope.clear()


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and any(_scopes):
        with contextlib.suppress(Exception):  # the JVM may have ended first
            delete_tables(spark)


atexit.register(_at_end)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyread/{uuid.uuid4().hex}"
    schema = df.schema
    _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is written, whereupon all tables that it wrote on its way are
    deleted; the result's own table belongs to the caller's scope."""

    @functools.wraps(work)
    def run(*args, **options) -> DataFrame:
        _scopes.append([])
        done = None
        try:
            done = materialise(work(*args, **options))
            return done
        finally:
            paths = _scopes.pop()
            if done is not None:
                _scopes[-1].append(paths.pop())
            spark = SparkSession.getActiveSession()
            if spark is not None:
                _delete(spark, paths)

    return run


#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1_000
#: What operators keep in a worker between tasks: a function that empties it, by operator.
caches: dict[str, Callable[[], None]] = {}


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches that are small in memory: the session's rows of a batch
    are lowered to ``BATCH_ROWS`` where they are more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def begin(operator: str) -> None:
    """At the start of an operator's task: empty what other operators keep in this worker and
    give memory back that is free."""
    for name, empty in caches.items():
        if name != operator:
            empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def slices(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most so many rows and bytes of text (one row may have more), to
    bound the Python objects that are alive at once."""
    wide = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            wide += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(wide)
    start = 0
    while start < batch.num_rows:
        room = size + (ends[start - 1] if start else 0)
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, room, "right"))))
        yield batch.slice(start, stop - start)
        start = stop
