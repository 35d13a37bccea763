"""Connected components of links within sessions, in rounds whose number grows with the logarithm of a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def _leaders(pairs: DataFrame) -> DataFrame:
    """Each node with the smallest node it is paired with, or itself."""
    least = pairs.groupBy("session_id", "u").agg(F.min("v").alias("least"))
    return least.withColumn("least", F.least("u", "least"))


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours move to its smallest neighbour, then its smaller ones do."""
    both = links.unionByName(links.select("session_id", F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.where("v > u").join(_leaders(both), ["session_id", "u"]).select("session_id", F.col("v").alias("u"), F.col("least").alias("v"))
    down = materialize(moved.where("u <> v").distinct(), "stars-large")
    least = down.groupBy("session_id", "u").agg(F.min("v").alias("least"))
    tied = down.join(least, ["session_id", "u"])
    ends = F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v"))))
    return tied.select("session_id", ends.alias("e")).select("session_id", "e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(session_id, node, root) of every linked node; the root is the smallest node it is connected with.

    ``links``: session_id, u, v. Each round is two joins over as many links at most as there
    were, kept in tables of the shared folder; more than ``rounds`` of them is an error.
    """
    now = links.select("session_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialize(now, "stars")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("session_id", "u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        now = materialize(_stars(now), "stars")
        new = mark(now)
        if new == seen:
            break
        seen = new
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    member = now.select("session_id", F.col("u").alias("node"), F.col("v").alias("root"))
    return member.unionByName(now.select("session_id", F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
