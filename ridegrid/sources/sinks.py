"""SNK1 / SNK2: JSON rows and versioned Parquet snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """SNK1: one JSON object per row (the API's list-of-dicts result); NULL fields are written as null.

    Money and times become fixed text first, so every engine prints the same object.
    """
    def shown(name: str, kind: str):
        if kind.startswith("decimal"):
            return F.col(name).cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)
        return F.col(name)

    fields = [shown(name, kind) for name, kind in df.dtypes]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


VERSION = "_version"  # partition column of versioned snapshots (reserved name)


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    """SNK2: write table state ``version`` as partition ``_version=<version>``.

    Dynamic partition overwrite replaces only that version, so re-running a
    step (a retried batch) is idempotent and earlier versions stay readable.
    """
    if VERSION in df.columns:
        raise ValueError(f"column name {VERSION!r} is reserved for snapshot versions")
    (df.withColumn(VERSION, F.lit(version).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(VERSION).parquet(path))


def read_snapshot(df_reader, path: str, version: int | None = None) -> DataFrame:
    """Read one version (default: the newest) of a snapshot written by ``write_snapshot``."""
    all_versions = df_reader.parquet(path)
    if version is None:
        version = newest_version(df_reader, path)
    return all_versions.where(F.col(VERSION) == version).drop(VERSION)


def newest_version(df_reader, path: str, below: int | None = None) -> int | None:
    """The highest version (below ``below``), from the partition folders' names alone: no data is read."""
    folders = df_reader.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(VERSION)
    if below is not None:
        folders = folders.where(F.col(VERSION) < below)
    return folders.agg(F.max(VERSION)).first()[0]


def drop_snapshots(spark, path: str, below: int) -> None:
    """Remove the versions under ``below``: folders of states that newer ones replaced."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name, _, version = status.getPath().getName().partition("=")
        if name == VERSION and int(version) < below:
            fs.delete(status.getPath(), True)
