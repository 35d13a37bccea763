"""Shared helpers: reading tables, word patterns, the bounded labelled sample."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, plain_unions, scratch_dir

__all__ = ["WORD", "give_back", "join_hot", "labelled_sample", "materialize", "scratch_path", "table", "whole_rows", "word_count"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Texts may be long: a Python worker holds a batch in three forms at once.
    plain_unions(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system at the end of a Python task: idle workers stay beside the next stage's JVM."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_rows(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none can clash with a column an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("none"))


def join_hot(rows: DataFrame, named: DataFrame, on: str, n: str = "n", total: int | None = None) -> DataFrame:
    """Left join with ``named``, one row a key whose column ``n`` is the key's number of ``rows``.

    Keys with a thousandth of ``total`` (of all, unless given), a thousand at most, are
    broadcast, so that no task gets all rows of one; the others are joined by shuffle.
    """
    all_ = (named.agg(F.sum(n)).first()[0] or 0) if total is None else total
    often = F.col(n) * 1000 >= all_
    out = rows.join(F.broadcast(named.where(often).drop(n).withColumn("own_hot", F.lit(True))), on, "left")
    rest = out.where("own_hot is null").select(*rows.columns).join(named.where(~often).drop(n), on, "left")
    return out.where("own_hot").drop("own_hot").unionByName(rest)


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id") -> DataFrame:
    """``rows`` (with ``own_key``) of at most ``bound`` labelled keys, with the column ``own_label`` (0 or 1).

    The keys with the smallest hash are taken, so reruns and other partitionings
    agree. Null labels don't count; a key labelled twice has its largest label. The
    bounded side is what is broadcast. The bound is on keys: who collects the sample
    reduces it to one row a key first.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("marked_key")).agg(F.max(label).cast("int").alias("own_label"))
    marks = marks.orderBy(F.xxhash64("marked_key"), "marked_key").limit(bound)
    return rows.join(F.broadcast(marks), F.col("own_key") == F.col("marked_key")).drop("marked_key")
