"""Cutting lineage with tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> SparkSession:
    """Keep unions from claiming their children's partitioning.

    With it on, adaptive execution may coalesce the children's partitions unequally and
    still leave out the exchange that an aggregate above the union needs, which gives
    wrong sums (seen on Spark 4.1.2).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder beside the warehouse, which executors share too.

    Never a folder of one machine: the warehouse is on the local disk only where the
    session is local itself.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch").rstrip("/")


_WRITTEN: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts lineage: a lost executor costs the tasks that read the table, not what produced
    it. Unlike ``checkpoint()`` it computes the plan once and keeps columns apart, so
    later reads are pruned.
    """
    plain_unions(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _WRITTEN:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``materialize`` writes inside, at the end. Only what is written elsewhere outlives it."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
