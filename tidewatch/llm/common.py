"""What the corpus operators share: checkpoints, size hints, Arrow helpers."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checkpoints import BROADCAST_ROWS, broadcast_if_small, checkpointed, shared_folder  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def size_hint(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df, from file sizes; nothing is read. 0 where it does not know."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else 0


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder, and read again: a cut of lineage that later reads columns of."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts that a key's rows are dealt in.
SALTS = 32


def told_back(rows: DataFrame, key: str, by: list[str], totals: list, where: str = "true", salts: int = SALTS) -> DataFrame:
    """rows with totals of their key, those of the keys that meet a condition.

    A key's rows lie in parts by a hash of `by`. Totals come from partial
    aggregation and are told to each part, so no task reads all rows of a key.
    """
    dealt = rows.withColumn("_s", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    found = dealt.groupBy(key).agg(*totals, F.collect_set("_s").alias("_parts")).where(where)
    told = found.select(*[c for c in found.columns if c != "_parts"], F.explode("_parts").alias("_s"))
    return dealt.join(told, [key, "_s"]).drop("_s")


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def masked(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "lang")) -> tuple[DataFrame, list[str]]:
    """docs with every column but the used ones under a name that no operator uses, and the names to give back."""
    names = docs.columns
    return docs.toDF(*[c.lower() if c.lower() in used else f"_own_{i}" for i, c in enumerate(names)]), names


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches again, none with more than so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]
