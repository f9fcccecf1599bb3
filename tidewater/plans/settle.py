"""Results that several later plans start from."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Where settled tables go while removed_after is in force.
_FOLDER: ContextVar[str | None] = ContextVar("settled tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or what was set on the context.

    Where neither is set, a session on one machine gets a new local folder, as in
    tests; on a cluster that would be a folder that no other machine sees, so it is
    an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewater-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def removed_after(spark: SparkSession):
    """Tables settled inside go to one folder, which is removed at the end, after an error too.

    For commands that have written what they compute by then: a DataFrame built
    inside cannot be read afterwards.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    before = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clearing(command: Callable) -> Callable:
    """command(spark, ...), whose settled tables are removed when it ends."""

    @functools.wraps(command)
    def run(spark: SparkSession, *arguments, **named):
        with removed_after(spark):
            return command(spark, *arguments, **named)

    return run


def settled(df: DataFrame) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder.

    Lost executors lose nothing of it, and later plans read only the columns and
    rows that they need.
    """
    path = f"{_FOLDER.get() or shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
