"""Context size of each session, anchored on reported usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import usage_total
from .structure import checkpoint, protected, typed_user


def anchors(entries: DataFrame, count: Column, valid: Column) -> DataFrame:
    """Per session the last assistant row with usage that ``valid`` admits: anchor_pos, anchor_seq, anchor_id, anchor."""
    rows = entries.where((F.col("role") == "assistant") & F.col("usage").isNotNull() & valid).withColumn("_count", count)
    return rows.groupBy("session_id").agg(F.max("pos").alias("anchor_pos"), F.max_by("seq", "pos").alias("anchor_seq"), F.max_by("message_id", "pos").alias("anchor_id"), F.max_by("_count", "pos").alias("anchor"))


def _finished() -> Column:
    return ~F.coalesce(F.col("finish").isin("error", "aborted"), F.lit(False))


def context_size(entries: DataFrame, policy: str, price: str = "price", removed: DataFrame | None = None) -> DataFrame:
    """Per session: tokens, stale.

    Policies: ``stale_flag`` (anchor and later estimates; stale if a checkpoint is newer),
    ``since_checkpoint`` (only anchors at or after the last one), ``last_only`` (no later
    rows; 0 is no total), ``clamped`` (the anchor less removals, at least 0, and later
    rows), ``floored`` (all of it at least 0, later rows from the first row of the
    anchor's message id on, without its own), ``padded`` (later rows at one and a half).
    ``removed``: session_id, seq of the anchor, tokens.
    """
    zero = F.lit(0).cast("long")
    cp = entries.groupBy("session_id").agg(F.coalesce(F.max(F.when(checkpoint(), F.col("seq"))), F.lit(-1)).alias("cp_seq"))
    rows = entries.join(cp, "session_id")
    strict = policy in ("stale_flag", "last_only")
    count = usage_total(F.col("usage"), zero_is_absent=strict)
    if policy in ("floored", "padded"):
        count = F.col("usage.input") + F.coalesce("usage.cache_read", zero) + F.coalesce("usage.cache_write", zero) + F.col("usage.output")
    valid = F.lit(True)
    if policy in ("stale_flag", "since_checkpoint"):
        valid = _finished() & (count > 0)
    if policy == "since_checkpoint":
        valid = valid & (F.col("seq") >= F.col("cp_seq"))
    found = anchors(rows, count, valid)
    if removed is not None:
        gone = removed.groupBy("session_id", F.col("seq").alias("anchor_seq")).agg(F.sum("tokens").alias("gone"))
        found = found.join(gone, ["session_id", "anchor_seq"], "left")
    else:
        found = found.withColumn("gone", zero)
    rows = rows.join(found, "session_id", "left")
    after = F.col("pos") > F.col("anchor_pos")
    if policy == "floored":
        # An answer may be several rows of one message id with results between them: what is later
        # begins after the first of them, and leaves out the answer's own rows.
        whole, own = W.partitionBy("session_id"), F.col("message_id") == F.col("anchor_id")
        other = F.max(F.when((F.col("role") == "assistant") & ~own & (F.col("pos") < F.col("anchor_pos")), F.col("pos"))).over(whole)
        rows = rows.withColumn("_other", F.coalesce(other, F.lit(-1)))
        rows = rows.withColumn("_first", F.min(F.when(own & (F.col("pos") > F.col("_other")), F.col("pos"))).over(whole))
        after = (F.col("pos") > F.col("_first")) & ~own
    sums = rows.groupBy("session_id").agg(
        F.first("anchor").alias("anchor"), F.coalesce(F.first("gone"), zero).alias("gone"), F.first("anchor_seq").alias("anchor_seq"), F.first("cp_seq").alias("cp_seq"),
        F.sum(price).alias("all"), F.coalesce(F.sum(F.when(after, F.col(price))), zero).alias("later"),
    )
    half = lambda c: F.floor((c * 3 + 1) / 2)  # noqa: E731  one and a half, rounded up
    a, later = F.col("anchor"), F.col("later")
    tokens = {
        "last_only": a, "clamped": F.greatest(a - F.col("gone"), zero) + later, "floored": F.greatest(a + later - F.col("gone"), zero),
        "padded": F.greatest(a + half(later) - F.col("gone"), zero),
    }.get(policy, a + later)
    bare = half(F.col("all")) if policy == "padded" else F.col("all")
    stale = (F.col("anchor_seq") < F.col("cp_seq")) if policy == "stale_flag" else F.lit(False)
    return sums.select("session_id", F.when(a.isNotNull(), tokens).otherwise(bare).cast("long").alias("tokens"), F.coalesce(stale, F.lit(False)).alias("stale"))


def message_pairs(entries: DataFrame) -> DataFrame:
    """Per session: typed messages that an answer followed (only those two kinds count)."""
    rows = entries.where(typed_user() | (F.col("role") == "assistant"))
    prior = F.lag(typed_user()).over(W.partitionBy("session_id").orderBy("pos"))
    return rows.withColumn("_p", prior).groupBy("session_id").agg(F.count_if((F.col("role") == "assistant") & F.coalesce("_p", F.lit(False))).alias("pairs"))


def request_budget(entries: DataFrame, sessions: DataFrame, price: str = "price", ratio: float = 0.9, reserve: int = 0, pressure: bool = True) -> DataFrame:
    """Per session: calibrated trigger and target. ``sessions``: session_id, context_window, input_limit, max_output_tokens."""
    zero = F.lit(0).cast("long")
    cp = entries.groupBy("session_id").agg(F.coalesce(F.max(F.when(checkpoint(), F.col("seq"))), F.lit(-1)).alias("cp_seq"))
    total = F.col("usage.total") - F.col("usage.output")
    own = F.col("usage.input") + F.coalesce("usage.cache_read", zero) + F.coalesce("usage.cache_write", zero)
    seen = F.when(F.col("usage.total").isNotNull(), total).otherwise(own)
    previous = anchors(entries.join(cp, "session_id").where("seq > cp_seq"), seen, _finished() & (seen > 0)).select("session_id", F.col("anchor").alias("previous"))
    sums = entries.groupBy("session_id").agg(F.coalesce(F.sum(F.when(~protected(), F.col(price))), zero).alias("messages"), F.coalesce(F.sum(F.when(protected(), F.col(price))), zero).alias("overhead"))
    rows = sessions.join(sums, "session_id").join(previous, "session_id", "left").join(message_pairs(entries), "session_id", "left")
    request = F.col("messages") + F.col("overhead")
    raw = F.when(F.col("input_limit") > 0, F.least("input_limit", "context_window").cast("double")).otherwise(F.col("context_window") * 0.9)
    factor = F.when(request > 0, F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.coalesce("previous", zero) / request))).otherwise(1.0)
    rows = rows.withColumns({"request": request, "raw": raw, "factor": factor}).withColumn("input", F.col("raw") / F.col("factor"))
    rows = rows.withColumn("trigger", F.greatest(F.lit(0.0), F.least(F.col("input") * ratio, F.col("input") - reserve)))
    at = F.greatest(F.lit(1), F.floor(F.col("trigger") - F.col("overhead")))
    wide = (F.coalesce("pairs", zero) >= 5) & (F.col("max_output_tokens") > 0) & (F.col("max_output_tokens") < F.col("input"))
    auto = F.when(wide, F.col("input") * 0.5).otherwise(F.col("trigger") * 0.7)
    target = F.floor(F.least(auto, F.col("trigger") - 1) - F.col("overhead")) if pressure else F.floor(F.least(at.cast("double"), F.col("messages") * 0.5))
    return rows.select("session_id", F.col("request").alias("request_tokens"), F.floor("trigger").cast("long").alias("trigger_tokens"), at.cast("long").alias("message_trigger_tokens"), F.greatest(F.lit(1), target).cast("long").alias("target_tokens"), F.coalesce("pairs", zero).alias("pairs"), (F.col("request") >= F.col("trigger")).alias("fires"))
