"""A folder that keeps receiving documents, read by the same batch functions.

Each micro-batch is read on its own; a document is one row, so no state is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.table import read_table
from ..sources.documents import DEFAULT_LIMITS, Limits, PdfEngine, open_documents


def stream_files(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1_000) -> DataFrame:
    """New files of a folder, as a streaming DataFrame of path, length, content."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    )
    reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content")


def read_folder(
    spark: SparkSession,
    path: str,
    sink: Callable[[DataFrame, DataFrame, int], None],
    checkpoint: str,
    limits: Limits = DEFAULT_LIMITS,
    engine: PdfEngine | None = None,
    glob: str | None = None,
) -> StreamingQuery:
    """Start reading a folder; ``sink`` gets (tables, refusals, batch number) of each
    micro-batch and should write idempotently by the number."""

    def each(files: DataFrame, number: int) -> None:
        documents, refusals = open_documents(files, limits, engine)
        sink(read_table(documents), refusals, number)

    files = stream_files(spark, path, glob)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
