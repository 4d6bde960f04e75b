"""Tables that take updates, deletes and new columns: each change is a new version beside the old one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's whole versions; one whose writer did not end does not count."""
    files, at = _files(spark, path)
    if not files.exists(at):
        return []
    found = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("version=")]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table's rows, by default of its last version."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1] if version is None else version}")


def change(spark: SparkSession, path: str, made: Callable[[DataFrame], DataFrame], by: tuple[str, ...] = (), keep: int = 2) -> DataFrame:
    """Write what `made` says of the last version as a new one, partitioned by some columns; the last `keep` versions stay.

    Readers of an older version are not disturbed, and a change that fails leaves
    the table as it was. One writer at a time.
    """
    known = versions(spark, path)
    number = known[-1] + 1
    made(table(spark, path)).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/version={number}")
    for old in known[: max(0, len(known) + 1 - keep)]:
        files, at = _files(spark, f"{path}/version={old}")
        files.delete(at, True)
    return table(spark, path, number)


def create(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first version of a table, or a new one that replaces all rows."""
    number = (versions(rows.sparkSession, path) or [0])[-1] + 1
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/version={number}")
    return table(rows.sparkSession, path, number)


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """rows, of which those that meet a condition take new values; a condition that is null is not met."""
    met = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    """rows less those that meet a condition."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def upserted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with those of `changes` in place of the ones that have their key, or beside them; changes have a row per key.

    Columns that only one side has are null on the other: an older table gets new columns so.
    """
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def with_column(rows: DataFrame, name: str, kind: str, value: Column | None = None) -> DataFrame:
    """rows with a further column, if they lack it: null, or a value made of the others."""
    return rows if name in rows.columns else rows.withColumn(name, (F.lit(None) if value is None else value).cast(kind))
