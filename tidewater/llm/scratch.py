"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.settle import shared_folder


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of up to this many rows, of a few numbers each, are worked on by one task.
FEW = 1 << 17


def gathered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(df as a written table, its rows): one of FEW rows at most comes in one partition, so that its groups and joins need no shuffle."""
    table = written(df, name)
    rows = table.count()
    return (table.coalesce(1) if rows <= FEW else table), rows


def filesystem(uri: str):
    """(Arrow file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def trim() -> None:
    """Gives freed memory back to the system: Arrow's, then the C library's where it can."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def tidied(run):
    """run, a function over the batches of a task; after the last, freed memory goes back to the system, as workers are kept for later tasks."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole
