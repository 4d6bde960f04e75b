"""Scans that read each file once, set broken ones aside and remember both."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed

PENDING, READ, CORRUPT = "pending", "read", "corrupt"
_ROWS = "path string, status string, error string, at timestamp"


def manifest(spark: SparkSession, where: str) -> DataFrame:
    """path, status, error, at: the last thing known of each file; no rows where no scan has run."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], _ROWS)
    rows = spark.read.schema(_ROWS).option("recursiveFileLookup", "true").parquet(where)
    # of one instant the outcome counts, not the intention
    last = F.max_by(F.struct("status", "error", "at"), F.struct("at", (F.col("status") != PENDING).alias("done")))
    return rows.groupBy("path").agg(last.alias("last")).select("path", "last.*")


def _noted(rows: DataFrame, where: str, run: str, step: str) -> None:
    rows.select("path", "status", "error", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{where}/{run}/{step}")


#: What Spark says of a file that cannot be read as Parquet, and of failures in its reader that are no file's fault.
_BROKEN = ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "org.apache.parquet", "datasources.parquet")
_ELSE = ("FILE_NOT_EXIST", "FileNotFoundException", "OutOfMemoryError", "AccessControlException", "SocketException", "SocketTimeoutException", "ConnectException", "ExecutorLostFailure", "FetchFailed")


def _fault(spark: SparkSession, paths: list[str], whole: bool) -> str | None:
    """What Spark says if one of the files is broken, None if all are sound; nothing but footers is read unless whole."""
    try:
        rows = spark.read.option("mergeSchema", "true").parquet(*paths)
        if whole:
            # a hash of all columns, so that every page is read; maps and variants have none of their own
            read = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]
            read = [c.cast("string") if "map<" in t or "variant" in t else c for c, (_, t) in zip(read, rows.dtypes, strict=True)]
            rows.agg(F.bit_xor(F.xxhash64(*read))).collect()
        else:
            rows.count()
    except Exception as e:
        said = str(e)
        if len(paths) == 1 and (not any(x in said for x in _BROKEN) or any(x in said for x in _ELSE)):
            raise
        return said
    return None


def probed(spark: SparkSession, paths: list[str], whole: bool = True) -> list[tuple[str, str, str | None]]:
    """path, status, error of each Parquet file. Spark reads them in splits, all at once, and halves of them where one is broken, so no task holds a file."""
    out, todo = [], [sorted(paths)]
    while todo:
        some = todo.pop()
        error = _fault(spark, some, whole)
        if error is None:
            out += [(p, READ, None) for p in some]
        elif len(some) == 1:
            out.append((some[0], CORRUPT, error[:300]))
        else:
            todo += [some[: len(some) // 2], some[len(some) // 2 :]]
    return out


def scan_new(spark: SparkSession, folder: str, where: str, use: Callable[[DataFrame, str], None], whole: bool = True, run: str | None = None) -> DataFrame:
    """Give the rows of a folder's Parquet files that no earlier scan has finished to use(rows, run); returns path, status, error of those files.

    Files are noted as pending, probed by Spark's own reader, and read by Spark if they are
    sound; a broken one is noted as corrupt and not looked at again, and the others
    are read all the same. The outcome is noted after use has returned: if it
    fails, its files stay pending and come again with the next scan, so use
    should write under the run's name. Files of any size are read in splits, and
    none is held; a failure that is no file's fault is raised. Without new files
    use is not called.
    """
    run = run or uuid.uuid4().hex
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    names = files.select("path").where(~F.substring_index("path", "/", -1).rlike("^[_.]"))
    done = manifest(spark, where).where(F.col("status") != PENDING).select("path")
    new = checkpointed(names.join(done, "path", "left_anti"))
    if new.isEmpty():
        return spark.createDataFrame([], "path string, status string, error string")
    _noted(new.withColumns({"status": F.lit(PENDING), "error": F.lit(None).cast("string")}), where, run, "begun")
    names = [r["path"] for r in new.toLocalIterator()]
    found = checkpointed(spark.createDataFrame(probed(spark, names, whole), "path string, status string, error string"))
    sound = [r["path"] for r in found.where(F.col("status") == READ).select("path").toLocalIterator()]
    if sound:
        use(spark.read.option("mergeSchema", "true").parquet(*sound), run)
    _noted(found, where, run, "ended")
    return found
