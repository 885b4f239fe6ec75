"""Files of a store against what refers to them; deletion only by consent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, key, size, modified) of all files under a folder; key is the path below it.

    Only names and sizes are read, not contents, and Spark lists folders in
    its tasks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    base = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    return files.select("path", F.substring_index("path", base, -1).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def orphans(files: DataFrame, references: Sequence[DataFrame]) -> DataFrame:
    """Rows of files whose key none of the references (key) names."""
    known = None
    for r in references:
        keys = r.select("key").where("key is not null")
        known = keys if known is None else known.unionByName(keys)
    return files if known is None else files.join(known.distinct(), "key", "left_anti")


def dangling(files: DataFrame, references: Sequence[DataFrame]) -> DataFrame:
    """(key) that the references name and no file has."""
    out = None
    for r in references:
        keys = r.select("key").where("key is not null")
        out = keys if out is None else out.unionByName(keys)
    return out.distinct().join(files.select("key"), "key", "left_anti")


def purge(files: DataFrame, references: Sequence[DataFrame], kept: Sequence[str] = (), consent: bool = False) -> DataFrame:
    """(path, key, size, deleted) of the orphans, but for keys that start with one of ``kept``.

    Without consent this is a dry run: nothing is deleted and deleted is false.
    With it they are deleted at once, DRIVER_FILES in a call at most; more is an
    error before anything is deleted.
    """
    gone = orphans(files, references)
    for head in kept:
        gone = gone.where(~F.startswith("key", F.lit(head)))
    gone = gone.select("path", "key", "size")
    if not consent:
        return gone.withColumn("deleted", F.lit(False))
    spark = files.sparkSession
    rows = gone.collect() if gone.count() <= DRIVER_FILES else None
    if rows is None:
        raise ValueError(f"more than {DRIVER_FILES} files to delete: purge by parts, with kept or a narrower listing")
    conf = spark._jsc.hadoopConfiguration()
    done = []
    for r in rows:
        path = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        path.getFileSystem(conf).delete(path, False)
        done.append((r["path"], r["key"], r["size"], True))
    return spark.createDataFrame(done, "path string, key string, size long, deleted boolean")


#: Files that one call deletes at most; it names them one by one to the file system.
DRIVER_FILES = 100_000
