"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexaloc.shipping import ship

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where it is unset, a local folder serves, but only for a local master; it goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@lru_cache(1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="hexaloc-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame to the shared folder and return the written table.

    This cuts the lineage, survives lost executors, and keeps columns prunable. The table
    goes with the driver's process, or before with ``release``."""
    spark = df.sparkSession
    ship(spark)
    folder = f"{shared_folder(spark)}/hexaloc/{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_LEFT: set[str] = set()


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    if folder not in _LEFT:
        _LEFT.add(folder)
        fs, at = _file_system(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing is to be computed from them any more."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._written_to)
        fs.delete(at, True)


def broadcast_if_few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df, marked for a broadcast if it was counted to have no more than so many rows; else a shuffled join brings it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where lambdas repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch's rows in turn, so many at most, whose texts have so many bytes together or are one."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right"))
        upto = min(max(upto, at + 1), at + rows)
        yield batch.slice(at, upto - at)
        at = upto


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    return let(
        F.btrim(text, F.lit(SPACES)),
        lambda t: F.when(F.length(t) > 0, F.split(t, SPACE_RUN)).otherwise(F.array().cast("array<string>")),
    )


def filter_by_ids(df: DataFrame, key: str, ids: DataFrame, keep: bool, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of df whose key is (keep) or is not (not keep) in ids(key).

    The ids are broadcast only after they were counted and found to be no more than
    broadcast_rows (16 MB or so); more go through a shuffled join. Null keys are never in ids."""
    ids = ids.select(F.col(key).alias("__id")).where("__id is not null").distinct()
    side = broadcast_if_few(ids, broadcast_rows)
    return df.join(side, df[key] == side["__id"], "left_semi" if keep else "left_anti")
