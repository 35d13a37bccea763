"""The visible history of an append-only log, replayed from its replace operations.

Every message is appended to the surface, or takes the place of a range of nodes that
stand there. As ranges are contiguous and appended numbers ascend, each node covers an
interval of appended messages. So the surface after any operation needs no replay: an
interval's ends are found by following the operations it starts and ends with, doubling
the distance in each round, and at each appended message the covering interval that
reaches furthest is the node that stands there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .scans import BLOCK, Running, scans

_KEY = ["session_id", "seq"]


def covered_intervals(operations: DataFrame) -> DataFrame:
    """session_id, seq, low, high: the first and the last appended message that each operation stands for.

    ``operations``: session_id, seq, start_seq, end_seq. Operations refer to earlier
    messages only, so following them ends; a round doubles the steps taken.
    """
    now = materialize(operations.select(*_KEY, F.col("start_seq").alias("low"), F.col("end_seq").alias("high"), F.lit(True).alias("open")), "intervals")
    while now.where("open").limit(1).count():
        low = now.select("session_id", F.col("seq").alias("low"), F.col("low").alias("next_low"))
        high = now.select("session_id", F.col("seq").alias("high"), F.col("high").alias("next_high"))
        met = now.join(low, ["session_id", "low"], "left").join(high, ["session_id", "high"], "left")
        moved = F.col("next_low").isNotNull() | F.col("next_high").isNotNull()
        now = materialize(met.select(*_KEY, F.coalesce("next_low", "low").alias("low"), F.coalesce("next_high", "high").alias("high"), moved.alias("open")), "intervals")
    return now.select(*_KEY, "low", "high")


def _faults(operations: DataFrame, intervals: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, seq, fault of operations that no surface could have taken."""
    known = messages.select("session_id", F.col("seq").alias("ref"), F.lit(True).alias("there")).distinct()
    ends = operations.select(*_KEY, F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("start_seq").alias("ref")), F.struct(F.lit("end").alias("end"), F.col("end_seq").alias("ref")))).alias("e")).select(*_KEY, "e.*")
    unknown = ends.join(known, ["session_id", "ref"], "left").where("there is null or ref is null or ref >= seq")
    unknown = unknown.select(*_KEY, F.concat(F.lit("no message where it would "), F.col("end")).alias("fault"))
    empty = intervals.where("low > high").select(*_KEY, F.lit("it ends before it starts").alias("fault"))
    # Intervals must nest, the outer one being the later: as many are open before an interval as after it.
    # Messages that an operation starts or ends with take part, as what it covers first and last must be just these.
    single = ends.join(operations.select("session_id", F.col("seq").alias("ref")), ["session_id", "ref"], "left_anti").where("ref is not null")
    nodes = intervals.where("low <= high").unionByName(single.select("session_id", F.col("ref").alias("seq"), F.col("ref").alias("low"), F.col("ref").alias("high")).distinct())
    step = lambda place, closes, a, b: F.struct(place.alias("place"), F.lit(closes).alias("closes"), a.alias("a"), b.alias("b"))
    steps = F.explode(F.array(step(F.col("low"), 0, -F.col("high"), -F.col("seq")), step(F.col("high"), 1, -F.col("low"), F.col("seq"))))
    edges = nodes.select(*_KEY, steps.alias("s")).select(*_KEY, "s.*")
    order = W.partitionBy("session_id").orderBy("place", "closes", "a", "b")
    edges = edges.withColumns({"nth": F.row_number().over(order), "depth": F.sum(1 - 2 * F.col("closes")).over(order) - F.when(F.col("closes") == 0, 1).otherwise(0)})
    torn = edges.groupBy(*_KEY).agg(F.min("depth").alias("a"), F.max("depth").alias("b")).where("a <> b").select(*_KEY, F.lit("it overlaps another one").alias("fault"))
    opens, none = edges.where("closes = 0"), F.lit(None).cast("long")
    around = opens.select("session_id", "nth", "depth", F.col("seq").alias("outer"), none.alias("seq")).unionByName(opens.select("session_id", "nth", (F.col("depth") - 1).alias("depth"), none.alias("outer"), "seq"))
    enclosing = F.last("outer", ignorenulls=True).over(W.partitionBy("session_id", "depth").orderBy("nth"))
    held = around.withColumn("enclosing", enclosing).where("seq is not null").select(*_KEY, "enclosing")
    inside = held.where("enclosing < seq").select(*_KEY, F.lit("its range had been replaced").alias("fault"))
    gone = ends.join(held.withColumnRenamed("seq", "ref"), ["session_id", "ref"]).where("not enclosing <=> seq").select(*_KEY, F.concat(F.lit("no visible message where it would "), F.col("end")).alias("fault"))
    return unknown.unionByName(empty).unionByName(torn).unionByName(inside).unionByName(gone).distinct()


def replay(messages: DataFrame, operations: DataFrame, as_of: Column | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(session_id, pos, seq of the visible nodes in order; session_id, seq, fault of impossible operations).

    ``messages``: session_id, seq of all messages, those of operations too; ``operations``:
    session_id, seq, start_seq, end_seq (nodes of the surface at that time, both included).
    ``as_of``, a boolean column over ``seq``, picks the log's part that has happened. A
    session with an impossible operation has no surface. Operations of one session share
    a task where they are checked; messages are spread by blocks.
    """
    if as_of is not None:
        messages, operations = messages.where(as_of), operations.where(as_of)
    operations = materialize(operations.select(*_KEY, "start_seq", "end_seq"), "operations")
    # An operation that refers to itself or a later one has no interval; it is a fault either way.
    intervals = materialize(covered_intervals(operations.where("start_seq < seq and end_seq < seq")), "covered")
    faults = materialize(_faults(operations, intervals, messages), "surface-faults")
    refused = faults.select("session_id").distinct()
    leaves = messages.select(*_KEY).distinct().join(operations.select(*_KEY), _KEY, "left_anti").join(refused, "session_id", "left_anti")
    marks = leaves.select("session_id", F.col("seq").alias("place"), F.lit(None).cast("struct<high:bigint,seq:bigint>").alias("reach"))
    marks = marks.unionByName(intervals.join(refused, "session_id", "left_anti").select("session_id", F.col("low").alias("place"), F.struct("high", "seq").alias("reach")))
    swept = scans(marks, ["session_id"], {"furthest": Running(F.col("reach"), "max", inclusive=True)}, "place", block).where("reach is null")
    node = F.when(F.col("furthest.high") >= F.col("place"), F.col("furthest.seq")).otherwise(F.col("place"))
    nodes = swept.select("session_id", node.alias("seq"), "place").groupBy(*_KEY).agg(F.min("place").alias("place"))
    placed = scans(nodes, ["session_id"], {"pos": Running(F.lit(1).cast("long"))}, "place", block)
    return placed.select("session_id", "pos", "seq"), faults


def attach(rows: DataFrame, prices: DataFrame, answers: DataFrame, estimate: Column, as_of: Column | None = None) -> DataFrame:
    """``rows`` with what was known of each: ``tokens`` (the latest measurement, else ``estimate``), ``finish`` and ``usage``.

    ``prices``: session_id, seq, measured_at, tokens; ``answers``: session_id, seq,
    answered_at, finish, usage. Of both only what ``as_of`` (a boolean column over
    ``at``) admits counts, the latest one of a row; finish and usage are of answers only.
    """
    def latest(df: DataFrame, at: str, *columns: str) -> DataFrame:
        df = df.withColumn("at", F.col(at))
        df = df if as_of is None else df.where(as_of)
        return df.groupBy(*_KEY).agg(F.max_by(F.struct(*columns), "at").alias("_known"))

    priced = rows.drop("tokens", "finish", "usage").join(latest(prices, "measured_at", "tokens"), _KEY, "left").withColumn("tokens", F.coalesce("_known.tokens", estimate)).drop("_known")
    known = priced.join(latest(answers, "answered_at", "finish", "usage"), _KEY, "left")
    answer = F.col("role") == "assistant"
    return known.withColumns({"finish": F.when(answer, F.col("_known.finish")), "usage": F.when(answer, F.col("_known.usage"))}).drop("_known")
