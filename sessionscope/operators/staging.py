"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where nothing is set, a fresh local one, but only if driver and executors are one process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _own_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts lineage: what follows re-reads the table when an executor is lost instead of repeating the
    work before it, and values such as partition ids stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table held in the plan itself. ddl as in ``"node int, cut bigint"``; no Python on executors."""
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    names = ", ".join(n for n, _ in fields)

    def cell(v: object, kind: str) -> str:
        if v is None:
            return f"cast(null as {kind})"
        if isinstance(v, str):
            v = "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        elif isinstance(v, float):
            v = repr(v) + "D"
        return f"cast({v} as {kind})"

    if not rows:
        return spark.sql("select " + ", ".join(f"cast(null as {k}) as {n}" for n, k in fields)).where("false")
    body = ", ".join("(" + ", ".join(cell(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for r in rows)
    return spark.sql(f"select * from values {body} as t({names})")
