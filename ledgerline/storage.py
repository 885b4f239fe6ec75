"""Tables in the folder that all executors share, which cut the lineage of long jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
        folder = context.getCheckpointDir()
    return folder


#: Folders that materialize() has written, by application.
_MADE: dict[str, list[str]] = {}


def made(spark: SparkSession) -> list[str]:
    return _MADE.setdefault(spark.sparkContext.applicationId, [])


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    Unlike checkpoint() this computes the rows once and stores columns.  The
    table stays until clean_up(), as results that read it are computed later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{label}-{uuid.uuid4().hex}"
    made(spark).append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in made(spark):
        made(spark).remove(path)


def _tables(df: DataFrame) -> list[str]:
    """Of the folders of materialize() those that df reads."""
    files = df.inputFiles()
    return [p for p in made(df.sparkSession) if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]


def remove(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more."""
    for path in _tables(df):
        _delete(df.sparkSession, path)


def clean_up(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes what materialize() has written in this application, but for what keep reads.

    For when results have been written: no DataFrame made by these operators
    before can be computed afterwards.  since: len(made()) at an earlier time,
    so that only later tables go.
    """
    stay = set(_tables(keep)) if keep is not None else set()
    for path in [p for p in made(spark)[since:] if p not in stay]:
        _delete(spark, path)
