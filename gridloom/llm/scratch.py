"""Shared scratch folder and written tables, which cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.scratch import scratch_dir
from gridloom.plans.scratch import stored as written

__all__ = ["beside", "discard", "removed", "scratch_dir", "spread", "without", "written"]


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing will read again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, name)


def beside(table: DataFrame, rows: int, most: int) -> DataFrame:
    """``table`` as the small side of a join: broadcast when its counted rows stay within ``most``."""
    return F.broadcast(table) if rows <= most else table


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to all cores when its files alone would give fewer tasks than cores.

    Row order and content are kept; only small tables in few files are dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Ids (8 bytes each) up to which a list of documents to drop is sent to every task.
BROADCAST_IDS = 1_000_000


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` whose doc_id is not in ``ids`` (one column, distinct); null ids compare equal.

    The list is written and counted; up to ``BROADCAST_IDS`` it is broadcast, beyond that the join shuffles.
    """
    own = written(ids.toDF("__gone"), "gone")
    if own.count() <= BROADCAST_IDS:
        own = F.broadcast(own)
    return documents.join(own, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")
