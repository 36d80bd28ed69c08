"""Shared scratch folder and written tables, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and the master is local below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that shuffle and sort.

    Size estimates come from files, where pixels and whole numbers take a bit or two, and don't grow
    with ``explode``: a table of millions of rows would pass for a small one and be built on the driver.
    ``F.broadcast`` on top still counts.
    """
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder and read back with the same schema."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for tables that are joined by key."""
    return by_key(stored(df, name))
