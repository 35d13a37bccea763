"""Retry, failure and refill state over logged events; ``streaming.monitor`` keeps the same live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def failure_circuit(attempts: DataFrame, most: int | None = 3) -> DataFrame:
    """Per session: failures since the last success, and whether the circuit is open. ``attempts``: session_id, ord, ok."""
    last = F.max(F.when(F.col("ok"), F.col("ord"))).over(W.partitionBy("session_id"))
    rows = attempts.withColumn("_last", last)
    n = rows.groupBy("session_id").agg(F.count_if(~F.col("ok") & (F.col("_last").isNull() | (F.col("ord") > F.col("_last")))).alias("failures"))
    return n.withColumn("open", F.lit(False) if most is None else F.col("failures") >= most)


def retry_budget(overflows: DataFrame, series: str, most: int) -> DataFrame:
    """Overflow events with their number in the session's series and whether a retry is allowed."""
    rows = overflows.withColumn("attempt", F.row_number().over(W.partitionBy("session_id", series).orderBy("ord")).cast("long"))
    return rows.withColumn("allowed", F.col("attempt") <= most)


def rapid_refills(compactions: DataFrame, most: int = 3) -> DataFrame:
    """Compactions (session_id, ord, turn_key, batches since the one before) with ``refills`` and ``blocked``.

    ``refills`` counts, within a turn, compactions in a row that came after fewer than
    three completed tool batches; at ``most`` the compaction is refused.
    """
    by_turn = W.partitionBy("session_id", "turn_key").orderBy("ord")
    rows = compactions.withColumn("_first", F.row_number().over(by_turn) == 1)
    rows = rows.withColumn("_quick", ~F.col("_first") & (F.col("batches") < 3))
    rows = rows.withColumn("_run", F.sum((~F.col("_quick")).cast("long")).over(by_turn.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("refills", F.sum(F.col("_quick").cast("long")).over(W.partitionBy("session_id", "turn_key", "_run").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("blocked", F.col("refills") >= most).drop("_first", "_quick", "_run")


def idle(entries: DataFrame, now_ms: Column | int, minutes: int, strict: bool = False) -> DataFrame:
    """Sessions whose last answer is at least (``strict``: more than) ``minutes`` old: session_id, idle_ms."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    last = entries.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("time_ms", "pos").alias("last_ms"))
    rows = last.select("session_id", (now - F.col("last_ms")).cast("long").alias("idle_ms"))
    limit = minutes * 60_000
    return rows.where(F.col("idle_ms") > limit if strict else F.col("idle_ms") >= limit)


def series(events: DataFrame, starts: Column, key: Column) -> DataFrame:
    """Events with ``series``: the key of the last start seen so far."""
    upto = W.partitionBy("session_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("series", F.last(F.when(starts, key), ignorenulls=True).over(upto))


def open_sections(events: DataFrame, begin: Column, end: Column, reset: Column) -> DataFrame:
    """Per session: whether the last of begin, end and reset events is a begin."""
    kind = F.when(begin, 1).when(end | reset, 0)
    return events.withColumn("_k", kind).where("_k is not null").groupBy("session_id").agg((F.max_by("_k", "pos") == 1).alias("open"))


def ownership(events: DataFrame, begin: Column, end: Column, turn_begin: Column, turn_end: Column) -> DataFrame:
    """Per session: ``active`` (a compaction is under way) and ``in_turn`` (a turn is open), by the last event of each kind."""
    last = lambda on, off: F.coalesce(F.max_by(F.when(on, True).when(off, False), F.when(on | off, F.col("pos"))), F.lit(False))
    return events.groupBy("session_id").agg(last(begin, end).alias("active"), last(turn_begin, turn_end).alias("in_turn"))


def refusal(manual: bool) -> Column:
    """Why a session of ``ownership`` may not be compacted now, null if it may: one writer at a time, and an
    automatic compaction belongs to an open turn while one asked for by hand waits until there is none."""
    return F.when(F.col("active"), "active").when(F.col("in_turn") if manual else ~F.col("in_turn"), "in a turn" if manual else "no turn")


def retried(events: DataFrame, failed: Column, replaced: Column) -> DataFrame:
    """Failed requests (session_id, pos) with ``retry``: whether the history was replaced before the next one failed."""
    rows = events.withColumns({"_failed": failed, "_replaced": replaced}).where("_failed or _replaced")
    following = F.lead("_replaced").over(W.partitionBy("session_id").orderBy("pos"))
    return rows.withColumn("retry", F.coalesce(following, F.lit(False))).where("_failed").select("session_id", "pos", "retry")


def observed_window(state: DataFrame) -> DataFrame:
    """The capacity last learned of each session and route. ``state``: session_id, route, seq, observed."""
    return state.where("observed is not null").groupBy("session_id", "route").agg(F.max_by("observed", "seq").alias("observed"))


def grown(sessions: DataFrame) -> DataFrame:
    """Sessions that have grown since their last compaction (measured, last_compacted)."""
    return sessions.where("last_compacted is null or measured > last_compacted")


def valid_ranges(selected: DataFrame) -> DataFrame:
    """Per session whether the selected rows are one unprotected, balanced range of the surface.

    ``selected``: session_id, idx, role, open_before, open_after.
    """
    g = selected.groupBy("session_id").agg(
        (F.max("idx") - F.min("idx") + 1 == F.count("*")).alias("contiguous"), (F.max(F.col("role").isin("system", "developer").cast("int")) == 0).alias("unprotected"),
        ((F.min_by("open_before", "idx") == 0) & (F.max_by("open_after", "idx") == 0)).alias("balanced"),
    )
    return g.withColumn("valid", F.col("contiguous") & F.col("unprotected") & F.col("balanced"))


def version(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Per session a fingerprint of its rows that no order of reading changes; compare before a commit."""
    return entries.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("mark"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sessions whose version is the same in both."""
    return before.join(after, ["session_id", "rows", "mark"], "left_semi").select("session_id")


def shrinks(selected: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (session_id, tokens) smaller than the rows they replace (session_id, price)."""
    old = selected.groupBy("session_id").agg(F.sum("price").alias("old_tokens"))
    return checkpoints.join(old, "session_id").withColumn("accepted", F.col("tokens") < F.col("old_tokens"))


def backoff_ms(attempt: Column, base: int, cap: int) -> Column:
    """Exponential delay without its jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


def jittered(delay: Column, low: float, high: float, seed: int) -> Column:
    return (delay * (F.lit(low) + F.rand(seed) * (high - low))).cast("long")
