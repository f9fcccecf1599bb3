"""Readers and sinks: fact and dimension CSV, forecasts, truth, reports."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = T.StructType([T.StructField("Store", T.LongType()), T.StructField("Date", T.StringType()), T.StructField("Sales", T.DoubleType()), T.StructField("Open", T.LongType()), T.StructField("Promo", T.LongType()), T.StructField("SchoolHoliday", T.LongType()), T.StructField("StateHoliday", T.StringType()), T.StructField("Customers", T.DoubleType())])
FORECAST = T.StructType([T.StructField("p10", T.DoubleType()), T.StructField("median", T.DoubleType()), T.StructField("p90", T.DoubleType())])
TRUTH = T.StructType([T.StructField("y_true", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; columns are taken by name, missing ones are null, empty fields are null."""
    header = spark.read.option("header", True).csv(path).columns
    wide = T.StructType([next((f for f in schema if f.name == c), T.StructField(c, T.StringType())) for c in header])
    df = spark.read.schema(wide).option("header", True).option("nullValue", "").csv(path)
    return df.select(*[c for c in header], *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in header])


def read_optional(spark: SparkSession, path: str, schema: T.StructType = FORECAST, fmt: str = "csv") -> DataFrame | None:
    """A forecast file, or a Parquet table with the schema it has; a missing one warns and gives None, an empty one gives None."""
    try:
        df = spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
        empty = df.isEmpty()
    except AnalysisException:
        warnings.warn(f"missing {path}", stacklevel=2)
        return None
    return None if empty else df


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts written by write_forecasts: run and series_id come from the folders, and are pruned by them."""
    return spark.read.parquet(path)


#: Names of forecast files without their ending: a run, perhaps with _output, perhaps a series. Truth has a name of its own.
FILE_NAME = r"([^/]+?)(?:_output)?(?:_store_(\d+))?\.csv$"
TRUTH_FILES = "ground_truth"


def read_forecast_files(spark: SparkSession, folder: str, *only: str, schema: T.StructType = FORECAST) -> DataFrame:
    """run, series_id, context_len, step and the columns of schema from a tree of CSV files, one run and series each.

    Names are <run>.csv or <run>_store_<id>.csv, with _output after the run or not; series_id is 0
    without a number, context_len is that of a folder ctx_<length>, else null. step
    counts the rows of a file. With runs named, no other file is opened; truth is read
    by name and its schema, and left out of forecasts.
    """
    patterns = ",".join(f"{r}.csv,{r}_output.csv,{r}_store_[0-9]*.csv,{r}_output_store_[0-9]*.csv" for r in only) or "*.csv"
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{patterns}}}" if only else patterns).csv(folder)
    path = F.col("_metadata.file_path")
    rows = raw.select("*", path.alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    step = F.row_number().over(Window.partitionBy("__path").orderBy("__block", "__at")) - 1
    part = lambda pattern, i: F.nullif(F.regexp_extract("__path", pattern, i), F.lit("")).cast("long")
    out = rows.select(F.regexp_extract("__path", FILE_NAME, 1).alias("run"), F.coalesce(part(FILE_NAME, 2), F.lit(0)).alias("series_id"), part(r"/ctx_(\d+)/", 1).alias("context_len"), step.cast("long").alias("step"), *schema.names)
    return out


def read_truth_files(spark: SparkSession, folder: str) -> DataFrame:
    return read_forecast_files(spark, folder, TRUTH_FILES, schema=TRUTH).drop("run")


def write_processed(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Writes df and gives the number of its rows, counted by the job that writes."""
    seen = Observation("processed")
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return seen.get.get("rows", 0)


def read_processed(spark: SparkSession, path: str, *columns: str, fmt: str = "parquet") -> DataFrame:
    """What write_processed wrote, or some columns of it; no others are read from Parquet."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_truth(test: DataFrame, path: str, target: str = "target") -> None:
    test.select("series_id", "step", F.col(target).alias("y_true")).write.mode("overwrite").parquet(path)


def write_forecasts(forecasts: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """One folder per run, or per the columns named (context_len, series_id)."""
    forecasts.write.mode(mode).partitionBy(*(by or ("run",))).parquet(path)


def not_yet_written(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Requested runs that have no output yet."""
    return requested.join(existing.select(*keys).distinct(), keys, "left_anti")


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report, in order, as one text file in folder `path`; a report has some hundred lines."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
