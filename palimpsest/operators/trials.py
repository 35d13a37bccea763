"""Scoring of evaluation trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def outcome(committed: Column, command_ok: Column, command_text: Column, reason: Column, thrown: Column, cut_off: Column, call_failed: Column, changed: Column) -> Column:
    """The class of a compaction; the first condition that holds decides."""
    text = F.coalesce(command_text, F.lit(""))
    # The phrases that mark each class.
    return (
        F.when(committed & command_ok & ~thrown, "committed")
        .when(committed | text.rlike("(?i)flush|persist|busy|cancelled"), "runtime-error")
        .when(reason.rlike("would increase history tokens|not smaller than the selected history"), "skipped-no-benefit")
        .when(reason.rlike("(?i)output limit|truncat") | cut_off, "summary-truncated")
        .when(call_failed, "provider-error")
        .when(reason.rlike("(?i)empty.*summary|summary.*empty|non-text|must contain text|attempted to call a tool|unsupported response|no summary text|did not contain usable continuation text"), "summary-invalid")
        .when(command_ok & text.contains("No compactable history"), F.when(changed, "pruned-only").otherwise("skipped-no-eligible-history"))
        .otherwise("runtime-error")
    )


def trial_scores(phases: DataFrame, compactions: DataFrame, trials: DataFrame) -> DataFrame:
    """Per trial: task, compaction and overall status.

    ``phases``: trial, phase (from 1), changed, tested, passed, total (of the last one), replayed;
    ``compactions``: trial, after_phase, outcome; ``trials``: trial, baseline, planned, needed, failed.
    """
    p = phases.groupBy("trial").agg(F.count("*").alias("phases"), F.min(F.col("changed") & F.col("tested")).alias("worked"), F.max_by(F.col("passed") == F.col("total"), "phase").alias("accepted"), F.count_if("replayed").alias("replays"))
    done = compactions.where("outcome = 'committed'").withColumn("nth", F.row_number().over(W.partitionBy("trial").orderBy("after_phase")))
    c = done.groupBy("trial").agg(F.count("*").alias("committed"), F.max(F.when(F.col("nth") == 3, F.col("after_phase"))).alias("third"))
    after = phases.join(c, "trial").where("changed and phase > third").select("trial").distinct().withColumn("continued", F.lit(True))
    rows = trials.join(p, "trial", "left").join(c, "trial", "left").join(after, "trial", "left").fillna({"committed": 0, "replays": 0, "phases": 0, "continued": False})
    task = F.when(F.col("phases") < F.col("planned"), "not-completed").when(F.col("accepted") & F.col("worked"), "passed").otherwise("failed")
    short = ~F.col("baseline") & (F.col("committed") != F.col("needed"))
    compaction = F.when(F.col("baseline"), "not-applicable").when(short, "incomplete").otherwise("complete")
    status = F.when(F.col("failed"), "runtime-error").when(task != "passed", "task-failed").when(short | (F.col("replays") != F.col("needed")) | (~F.col("baseline") & ~F.col("continued")), "compaction-incomplete").otherwise("passed")
    return rows.select("trial", task.alias("task_status"), compaction.alias("compaction_status"), F.col("committed").cast("long").alias("committed"), "continued", status.alias("status"))


def histogram(outcomes: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of each value by key, one column a value."""
    return outcomes.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v.replace("-", "_")) for v in values])


def usage_totals(calls: DataFrame) -> DataFrame:
    """Sums of each usage field by session; calls without a report are counted apart."""
    s = lambda n: F.coalesce(F.sum(f"usage.{n}"), F.lit(0)).alias(f"{n}_tokens")
    return calls.groupBy("session_id").agg(s("input"), s("output"), s("cache_read"), s("cache_write"), F.count_if(F.col("usage").isNull()).alias("missing"))


def repeated_reads(reads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per session: reads of a file whose content was read before."""
    rows = reads.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return rows.groupBy("session_id").agg(F.count("*").alias("reads"), F.count_if(F.col("_nth") > 1).alias("repeated"))


def recall_score(checks: DataFrame) -> DataFrame:
    return checks.groupBy("session_id").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.round(F.lit(100.0) * (1 - after / before), 1)
