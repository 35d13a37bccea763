"""Splitting a session: protected islands, open tool calls, cuts, rounds and turns.

All operators take canonical entries and share the partitioning by session, so Spark
shuffles once for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import plain_unions
from .scans import Running, scans


def session_order() -> WindowSpec:
    return W.partitionBy("session_id").orderBy("pos")


def rows_before() -> WindowSpec:
    return session_order().rowsBetween(W.unboundedPreceding, -1)


def rows_upto() -> WindowSpec:
    return session_order().rowsBetween(W.unboundedPreceding, 0)


def all_rows() -> WindowSpec:
    return W.partitionBy("session_id")


def protected() -> Column:
    return F.col("role").isin("system", "developer")


def checkpoint() -> Column:
    return F.coalesce(F.col("source_kind") == "compact-checkpoint", F.lit(False))


def typed_user() -> Column:
    return (F.col("role") == "user") & F.coalesce(F.col("source_kind") == "user", F.lit(False))


def context_prefix(text: Column) -> Column:
    """Protected, or a reminder that was put in among the user's messages."""
    reminder = (F.col("role") == "user") & ~typed_user() & F.startswith(F.ltrim(text), F.lit("<system-reminder>"))
    return protected() | reminder


def indexed(entries: DataFrame) -> DataFrame:
    """With ``idx``, the dense place of each row in its session, and ``n``, the session's rows."""
    return entries.withColumns({"idx": (F.row_number().over(session_order()) - 1).cast("long"), "n": F.count("*").over(all_rows())})


def islands(entries: DataFrame, guard: Column | None = None) -> DataFrame:
    """The rows outside ``guard`` with ``island``: maximal runs between guarded rows share a number."""
    guard = protected() if guard is None else guard
    rows = entries.withColumns({"_g": guard, "island": F.sum(guard.cast("long")).over(rows_upto())})
    return rows.where(~F.col("_g")).drop("_g")


def spans(entries: DataFrame, guard: Column | None = None) -> DataFrame:
    """One row for each island: first_pos, last_pos, rows, and whether anything but checkpoints is in it."""
    rows = islands(entries, guard)
    return rows.groupBy("session_id", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("rows"), F.max(~checkpoint()).alias("eligible"))


def first_eligible(spans_: DataFrame) -> DataFrame:
    return spans_.where("eligible").groupBy("session_id").agg(F.min_by(F.struct("island", "first_pos", "last_pos", "rows"), "first_pos").alias("s")).select("session_id", "s.*")


def call_events(entries: DataFrame) -> DataFrame:
    """One row for each tool call and each result, in one pass: session_id, pos, call_id, call (false for a result)."""
    kind = "array<struct<call_id:string,call:boolean>>"
    calls = F.transform(F.filter("blocks", lambda b: b["type"] == "tool-call"), lambda b: F.struct(b["id"].alias("call_id"), F.lit(True).alias("call"))).cast(kind)
    answer = F.when((F.col("role") == "tool") & F.col("tool_call_id").isNotNull(), F.array(F.struct(F.col("tool_call_id").alias("call_id"), F.lit(False).alias("call"))).cast(kind))
    none = F.array().cast(kind)
    events = entries.select("session_id", "pos", F.explode(F.concat(F.coalesce(calls, none), F.coalesce(answer, none))).alias("e"))
    return events.select("session_id", "pos", "e.*")


def call_intervals(entries: DataFrame, block: int | None = None) -> DataFrame:
    """Each call with ``closed_at``: the position of its first later result, null while open."""
    if block is not None:
        result = Running(F.when(~F.col("call"), F.col("pos")), "min", backward=True)
        return scans(call_events(entries), ["session_id", "call_id"], {"closed_at": result}, block=block).where("call").drop("call")
    later = W.partitionBy("session_id", "call_id").orderBy("pos").rangeBetween(1, W.unboundedFollowing)
    return call_events(entries).withColumn("closed_at", F.min(F.when(~F.col("call"), F.col("pos"))).over(later)).where("call").drop("call")


def unexpected_results(entries: DataFrame) -> DataFrame:
    """Results that no open call expects: session_id, pos."""
    prior = F.lag("call").over(W.partitionBy("session_id", "call_id").orderBy("pos"))
    return call_events(entries).withColumn("prior", prior).where(~F.col("call") & ~F.coalesce("prior", F.lit(False))).select("session_id", "pos")


def orphan_sessions(entries: DataFrame) -> DataFrame:
    """Sessions with a result that no open call expects."""
    return unexpected_results(entries).select("session_id").distinct()


def balanced(entries: DataFrame, block: int | None = None) -> DataFrame:
    """Entries with ``open_before`` and ``open_after``: calls without a result around each row.

    Calls are a set: a result closes every earlier call of its id, and results that
    no call expects change nothing. Openings and closings run along with the rows
    through one window, so rows are shuffled by session only, never by place. With
    ``block`` they are dealt by that many places, for sessions larger than a task.
    """
    plain_unions(entries.sparkSession)
    step = lambda pos, d: F.struct(pos.alias("pos"), F.lit(d).cast("long").alias("_d"))
    both = F.array(step(F.col("pos"), 1), step(F.col("closed_at"), -1))
    steps = call_intervals(entries, block).select("session_id", F.explode(F.filter(both, lambda x: x["pos"].isNotNull())).alias("s")).select("session_id", "s.*")
    rows = entries.withColumns({"_d": F.lit(0).cast("long"), "_step": F.lit(False)}).unionByName(steps.withColumn("_step", F.lit(True)), allowMissingColumns=True)
    if block is not None:
        opened = {"open_after": Running(F.col("_d"), inclusive=True), "open_before": Running(F.col("_d"))}
        return scans(rows, ["session_id"], opened, block=block).where("not _step").drop("_d", "_step")
    opened = lambda last: F.coalesce(F.sum("_d").over(session_order().rangeBetween(W.unboundedPreceding, last)), F.lit(0)).cast("long")
    return rows.withColumns({"open_after": opened(0), "open_before": opened(-1)}).where("not _step").drop("_d", "_step")


def safe_rows(entries: DataFrame) -> DataFrame:
    """Rows with ``island`` of the parts of islands that begin and end with no call open and hold more than one row
    and more than checkpoints; sessions with an unexpected result have none."""
    whole = W.partitionBy("session_id", "island")
    rows = islands(indexed(balanced(entries)))
    rows = rows.withColumns({"_a": F.min(F.when(F.col("open_before") == 0, F.col("idx"))).over(whole), "_b": F.max(F.when(F.col("open_after") == 0, F.col("idx"))).over(whole)})
    rows = rows.where("idx between _a and _b").withColumns({"_rows": F.count("*").over(whole), "_fresh": F.max(~checkpoint()).over(whole)})
    rows = rows.where("_rows > 1 and _fresh").drop("_a", "_b", "_rows", "_fresh")
    return rows.join(orphan_sessions(entries), "session_id", "left_anti")


def safe_spans(entries: DataFrame) -> DataFrame:
    """One row for each span of ``safe_rows``: first_pos, last_pos, rows."""
    return safe_rows(entries).groupBy("session_id", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("rows"))


def completed_spans(entries: DataFrame) -> DataFrame:
    """The first island part that starts with nothing open and no result, ends balanced, and holds an answer or a result."""
    rows = islands(balanced(entries))
    start = rows.where((F.col("open_before") == 0) & (F.col("role") != "tool")).groupBy("session_id", "island").agg(F.min("pos").alias("first_pos"))
    rows = rows.join(start, ["session_id", "island"]).where("pos >= first_pos")
    ends = rows.where("open_after = 0").groupBy("session_id", "island", "first_pos").agg(F.max("pos").alias("last_pos"))
    inside = rows.drop("first_pos").join(ends, ["session_id", "island"]).where("pos <= last_pos")
    found = inside.groupBy("session_id", "island", "first_pos", "last_pos").agg(F.count("*").alias("rows"), F.max(F.col("role").isin("assistant", "tool")).alias("works")).where("works")
    return found.groupBy("session_id").agg(F.min_by(F.struct("first_pos", "last_pos", "rows"), "island").alias("s")).select("session_id", "s.*")


def rounds(entries: DataFrame, mode: str = "assistant", block: int | None = None) -> DataFrame:
    """Entries with ``round`` (from 0). A round starts at an assistant message: at each
    (``assistant``), with nothing open (``pending``), or with nothing open and another
    message id than the assistant message before (``message``). ``block`` as in ``balanced``."""
    if block is not None:
        return _blocked_rounds(entries, mode, block)
    rows = entries
    opens = F.col("role") == "assistant"
    if mode != "assistant":
        rows = balanced(entries)
        opens = opens & (F.col("open_before") == 0)
    if mode == "message":
        rows = rows.withColumn("_prior", F.last(F.when(F.col("role") == "assistant", F.col("message_id")), ignorenulls=True).over(rows_before()))
        opens = opens & (F.col("_prior").isNull() | (F.col("_prior") != F.col("message_id")))
    rows = rows.withColumn("_opens", (opens & (F.row_number().over(session_order()) > 1)).cast("long"))
    return rows.withColumn("round", F.sum("_opens").over(rows_upto())).drop("_opens", "_prior", "open_before", "open_after")


def _blocked_rounds(entries: DataFrame, mode: str, block: int) -> DataFrame:
    rows = entries if mode == "assistant" else balanced(entries, block)
    answer = F.col("role") == "assistant"
    rows = scans(rows, ["session_id"], {"_first": Running(F.lit(1)), "_prior": Running(F.when(answer, F.col("message_id")), "last")}, block=block)
    opens = answer & (F.col("_first") > 0)
    if mode != "assistant":
        opens = opens & (F.col("open_before") == 0)
    if mode == "message":
        opens = opens & (F.col("_prior").isNull() | (F.col("_prior") != F.col("message_id")))
    return scans(rows, ["session_id"], {"round": Running(opens.cast("long"), inclusive=True)}, block=block).drop("_first", "_prior", "open_before", "open_after")


def enough(with_rounds: DataFrame) -> DataFrame:
    """Sessions with at least two rounds and an answer."""
    return with_rounds.groupBy("session_id").agg(F.count_distinct("round").alias("rounds"), F.max(F.col("role") == "assistant").alias("answered")).where("rounds >= 2 and answered").select("session_id", "rounds")


def turns(entries: DataFrame) -> DataFrame:
    """Entries with ``turn_no``: user messages other than checkpoints seen so far."""
    return entries.withColumn("turn_no", F.sum(((F.col("role") == "user") & ~checkpoint()).cast("long")).over(rows_upto()))


def running_sum(rows: DataFrame, value: str, out: str, block: int = 4096) -> DataFrame:
    """``out``: the sum of ``value`` over a session's earlier rows, by blocks of places.

    The same as a running window, but no task holds more than a block of one session
    (and one row for each of its blocks), so a session of any size is spread.
    """
    rows = rows.withColumn("_block", F.floor(F.col("pos") / block))
    sums = rows.groupBy("session_id", "_block").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy("session_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(W.partitionBy("session_id", "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(sums, ["session_id", "_block"]).withColumn(out, F.col("_base") + F.col("_own")).drop("_block", "_own", "_base")
