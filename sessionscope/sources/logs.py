"""Raw log folders and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.schemas import LOG_TYPES, require_columns


def log_glob(log_type: str) -> str:
    if log_type not in LOG_TYPES:
        raise ValueError(f"log_type must be one of {sorted(LOG_TYPES)}")
    return f"{log_type}-*.log"


def read_log_lines(spark: SparkSession, folder: str, log_type: str, glob: str | None = None, line_numbers: bool = True) -> DataFrame:
    """All lines of one type in a folder: raw_line (bytes that are no UTF-8 replaced), source_file, line_number (from 1, blank lines
    count), event_seq (file name, block, place in the scan), log_type.

    Order inside a file is (block start, row id), taken right at the scan; later stages carry it along. Line numbers come from a
    second scan that only counts the lines of each block, a row a block, and sums the blocks before it up; these rows go to every task,
    so that no line is moved.
    """
    lines = spark.read.option("pathGlobFilter", glob or log_glob(log_type)).text(folder)
    seq = F.struct(F.lower("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    found = lines.select(F.make_valid_utf8("value").alias("raw_line"), F.col("_metadata.file_name").alias("source_file"), seq.alias("event_seq"), F.lit(log_type).alias("log_type"), F.col("_metadata.file_path").alias("_path"))
    if not line_numbers:
        return found.drop("_path")
    block = [F.col("_path").alias("_file"), F.col("event_seq.block").alias("_block")]
    blocks = found.groupBy(*block).agg(F.min("event_seq.row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    numbered = found.join(F.broadcast(blocks), (F.col("_path") == F.col("_file")) & (F.col("event_seq.block") == F.col("_block")))
    return numbered.select("raw_line", "source_file", (F.col("event_seq.row") + F.col("_shift")).alias("line_number"), "event_seq", "log_type")


def list_log_files(spark: SparkSession, folder: str, log_type: str, glob: str | None = None) -> DataFrame:
    """(log_type, file_name), empty files too, which no reader of Spark gives a row: the listing that a reader keeps anyway."""
    files = spark.read.option("pathGlobFilter", glob or log_glob(log_type)).text(folder).inputFiles()
    return spark.createDataFrame([(log_type, f.rsplit("/", 1)[-1]) for f in files], "log_type string, file_name string")


def read_events(spark: SparkSession, path: str, required: tuple[str, ...], fmt: str = "parquet") -> DataFrame:
    """An event table as Parquet or CSV (all columns strings, a byte order mark is skipped); an error names missing columns."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    else:
        df = spark.read.parquet(path)
    return require_columns(df, *required)


def write_tables(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """Write a table in one folder a value of ``by`` (log_type, classification, split), so that readers prune."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """JSON records, one a session; the number of them comes from the same pass."""
    seen = Observation()
    scores.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


HISTORY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "timestamp", "model_dir", "model_created_at", "dataset", "parameters", "result")]
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Build and evaluation records; nested values stay JSON text. seq follows the recording time."""
    return spark.read.schema(HISTORY).json(path).withColumn("seq", F.col("timestamp"))


def append_history(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
