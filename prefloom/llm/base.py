"""Shared folder, tables that cut lineage, and Arrow batch helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A side with at most so many rows of fixed-width keys is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "prefloom-shared"))
        root = sc.getCheckpointDir()
    return root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"


def run_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one: all tables and files that the operators write lie there."""
    return f"{shared_root(spark).rstrip('/')}/prefloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the run's folder; nothing lies there yet."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard_run(spark: SparkSession) -> None:
    """Remove all that the operators have written in this application: to be called once their results are stored elsewhere."""
    discard(spark, run_folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends there."""
    return stored_at(df, shared_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder that no result needs any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, names: list[str]) -> list[str]:
    """``df``'s columns but for those that clash with ``names`` (Spark ignores case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


#: Rows of an Arrow batch: with whole texts in them, Spark's default of 10,000 makes batches that workers and executors hold several times.
BATCH_ROWS = 1000
#: Bytes of an Arrow batch, or a single row if that is larger.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` where it has none set."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, str(value))


def masked(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` under names that clash with no operator's, but for text, and the columns that restore it."""
    names = [c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def append_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """``df`` with the columns ``fields``, which ``fn`` makes from each Arrow batch.

    A column of ``df`` that has the name of a new one is replaced. ``fn`` sees the input columns.
    """
    small_batches(df.sparkSession)
    keep = without(df, [f.name for f in fields])
    schema = T.StructType([f for f in df.schema if f.name in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(made), names=[*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table is small enough for a broadcast; counts limit + 1 rows at most."""
    return df.limit(limit + 1).count() <= limit


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in the stored table ``keys``: by broadcast where ``keys`` is proven small, else by shuffle."""
    keys = keys.select(*on).distinct()
    return df.join(F.broadcast(keys) if few_rows(keys) else keys, on, "left_semi")


def lookup(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with the stored table ``side``, broadcast where that is proven small."""
    return df.join(F.broadcast(side) if few_rows(side) else side, on, how)
