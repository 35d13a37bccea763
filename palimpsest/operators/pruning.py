"""Clearing old tool output. Each operator returns the rows to clear; ``sources.logs.replace`` applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .structure import all_rows, checkpoint, rows_upto, session_order

def _newest() -> WindowSpec:
    return W.partitionBy("session_id").orderBy(F.desc("pos"))


def last_n(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each session."""
    return rows.withColumn("_nth", F.row_number().over(_newest())).where(F.col("_nth") <= n).drop("_nth")


def eligible_tools(entries: DataFrame, names: tuple[str, ...], name: Column, cleared: Column) -> DataFrame:
    """Successful results of the named tools that were not cleared before."""
    return entries.where((F.col("role") == "tool") & ~F.col("is_error") & name.isin(*names) & ~cleared)


def clear_old(tools: DataFrame, keep: int) -> DataFrame:
    """All but the last ``keep`` (one at least)."""
    return tools.withColumn("_nth", F.row_number().over(_newest())).where(F.col("_nth") > max(1, keep)).drop("_nth")


def low_water(tools: DataFrame, chars: str, high: int, low: int, keep: int) -> DataFrame:
    """Where a session's tool text is above ``high``, the oldest clearable rows until ``low`` or less remain; the last ``keep`` stay."""
    rows = tools.withColumns({"_total": F.sum(chars).over(all_rows()), "_nth": F.row_number().over(_newest())})
    rows = rows.where((F.col("_total") > high) & (F.col("_nth") > max(1, keep)))
    gone = F.coalesce(F.sum(chars).over(session_order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_left", F.col("_total") - gone).where(F.col("_left") > low).drop("_total", "_nth", "_left")


def backward(entries: DataFrame, price: str, cleared: Column, protect: int, least: int, turns: int = 2, skip: Column | None = None, keep: int = 0) -> DataFrame:
    """Old successful results beyond ``protect`` tokens, counted from the end after ``turns`` user turns.

    The walk stops at a checkpoint, or at a cleared result once ``turns`` turns are
    counted. Nothing is cleared unless it saves more than ``least``.
    """
    skip = F.lit(False) if skip is None else skip
    back = _newest().rowsBetween(W.unboundedPreceding, 0)
    rows = entries.withColumn("_turns", F.sum((F.col("role") == "user").cast("long")).over(back))
    seen = (F.col("_turns") >= turns) & (F.col("role") == "tool") & ~F.col("is_error") & ~skip
    rows = rows.withColumns({"_seen": seen, "_stop": F.max(F.when(checkpoint() | (seen & cleared), F.col("pos"))).over(all_rows())})
    rows = rows.where(F.col("_seen") & (F.col("_stop").isNull() | (F.col("pos") > F.col("_stop"))))
    rows = rows.withColumns({"_kept": F.sum(price).over(back), "_nth": F.row_number().over(_newest())}).where((F.col("_kept") > protect) & (F.col("_nth") > keep))
    return rows.withColumn("_saved", F.sum(price).over(all_rows())).where(F.col("_saved") > least).drop("_turns", "_seen", "_stop", "_kept", "_nth", "_saved")


def grouped(entries: DataFrame, eligible: Column, keep: int) -> DataFrame:
    """Eligible results grouped by the calling message before them; all but those of the last ``keep`` groups.

    Results before any calling message are a group each.
    """
    calls = F.exists("blocks", lambda b: b["type"] == "tool-call") & (F.col("role") == "assistant")
    rows = entries.withColumn("_batch", F.sum(calls.cast("long")).over(rows_upto())).where(eligible)
    rows = rows.withColumn("_group", F.when(F.col("_batch") == 0, F.col("pos") - F.lit(1 << 40)).otherwise(F.col("_batch")))
    return rows.withColumn("_rank", F.dense_rank().over(W.partitionBy("session_id").orderBy(F.desc("_group")))).where(F.col("_rank") > max(1, keep)).drop("_batch", "_group", "_rank")


def savings(cleared: DataFrame, price: str, placeholder: int, anchors: DataFrame) -> DataFrame:
    """Per session: tokens saved by clearing, and those at or before the usage anchor (``anchors``: session_id, anchor_pos)."""
    rows = cleared.withColumn("_saved", F.greatest(F.col(price) - placeholder, F.lit(0))).join(anchors, "session_id", "left")
    return rows.groupBy("session_id").agg(F.sum("_saved").alias("saved"), F.coalesce(F.sum(F.when(F.col("pos") <= F.col("anchor_pos"), F.col("_saved"))), F.lit(0)).alias("anchored"))


def image_pressure(entries: DataFrame, most: int = 20) -> DataFrame:
    """Sessions with at least ``most`` images in results (0: never)."""
    images = F.size(F.filter("blocks", lambda b: b["type"] == "image"))
    n = entries.where("role = 'tool'").groupBy("session_id").agg(F.sum(images).alias("images"))
    return n.where((F.col("images") >= most) & F.lit(most > 0))
