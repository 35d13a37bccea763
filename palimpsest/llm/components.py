"""Connected components of an edge table by alternating star contractions.

Edges stay in tables in the shared folder; nothing but two numbers a round reaches
the driver. Rows per round are linear in the edges, and the number of rounds grows
with the logarithm of the size of the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

_ROUNDS = 60


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours are linked to the smallest of them (u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = join_hot(edges, least, "u", total=total)
    out = linked.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").where("u <> v").distinct()


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    linked = join_hot(both.where("v > u"), least, "u", total=2 * total)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``u`` and ``v``); the root is the
    smallest node of the component. Self-links and repeated links change nothing."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialize(e, name)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    for step in range(_ROUNDS):
        if not before[0]:
            break
        larger = materialize(_large(e, before[0]), f"{name}{step}-large")
        e = materialize(_small(larger, larger.count()), f"{name}{step}")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Settled: every edge leads from a node to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
