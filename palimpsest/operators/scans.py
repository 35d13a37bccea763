"""Running values by blocks of places, so that a session of any size is spread over tasks.

A window over a session sorts all its rows in one task. Here rows are dealt by
(key, block of places): a block's summary is a row, summaries are carried over the
blocks of a key, and each block continues from what was carried to it. No task holds
more rows of one key than a block has, plus a row for each of its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import plain_unions

BLOCK = 4096


@dataclass(frozen=True)
class Running:
    """``value`` over a key's earlier rows (later ones, if ``backward``), the row and its peers too if ``inclusive``.

    ``how``: ``sum`` (0 without rows), ``min``, ``max``, or ``last``, the nearest value that is not null.
    """

    value: Column
    how: str = "sum"
    inclusive: bool = False
    backward: bool = False

    def order(self, by: str) -> Column:
        return F.desc(by) if self.backward else F.asc(by)

    def over(self, value: Column, window: W) -> Column:
        of = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[self.how]
        return of(value).over(window)

    def of_block(self, value: Column, by: str) -> Column:
        """The value that a whole block hands on."""
        if self.how == "last":
            return (F.min_by if self.backward else F.max_by)(value, F.when(value.isNotNull(), F.col(by)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.how](value)

    def joined(self, carried: Column, own: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
        return F.coalesce(own, carried) if self.how == "last" else (F.least if self.how == "min" else F.greatest)(carried, own)


def scans(rows: DataFrame, keys: list[str], out: dict[str, Running], order: str = "pos", block: int = BLOCK) -> DataFrame:
    """``rows`` with the running values ``out`` of each key, by the integer column ``order``.

    Rows of one place are peers: none is earlier than another. Keys are not null; a place
    may be sparse, dense ones fill their blocks best.
    """
    plain_unions(rows.sparkSession)
    on = [*keys, "_block"]
    named = {name: f"_value{i}" for i, name in enumerate(out)}
    rows = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumns({named[name]: run.value for name, run in out.items()})
    blocks = rows.groupBy(*on).agg(*[run.of_block(F.col(named[name]), order).alias(named[name]) for name, run in out.items()])
    carried = {f"{named[name]}c": run.over(F.col(named[name]), W.partitionBy(*keys).orderBy(run.order("_block")).rowsBetween(W.unboundedPreceding, -1)) for name, run in out.items()}
    blocks = blocks.withColumns(carried).select(*on, *carried)
    own = {f"{named[name]}o": run.over(F.col(named[name]), W.partitionBy(*on).orderBy(run.order(order)).rangeBetween(W.unboundedPreceding, 0 if run.inclusive else -1)) for name, run in out.items()}
    met = rows.withColumns(own).join(blocks, on)
    both = {name: run.joined(F.col(f"{named[name]}c"), F.col(f"{named[name]}o")) for name, run in out.items()}
    return met.withColumns(both).drop("_block", *[c for n in named.values() for c in (n, f"{n}c", f"{n}o")])
