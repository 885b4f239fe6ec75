"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.storage import clean_up, made, materialize, remove, shared_dir  # noqa: F401  used by the operators through this module

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch, so that long texts don't fill a task's memory.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Arrow batches of BATCH_BYTES at most."""
    df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def byte_text(column: str = "text") -> Column:
    """A text's UTF-8 bytes; of null, none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
