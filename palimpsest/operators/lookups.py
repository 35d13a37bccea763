"""Lookups between messages, calls, results, records and files, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.logs import calls_of, results_of, text_of
from ..sources.scratch import materialize
from .graph import components


def identify_results(entries: DataFrame) -> DataFrame:
    """Results with the name and arguments of the last call of their id in the session (nulls without one)."""
    calls = calls_of(entries).groupBy("session_id", "call_id").agg(F.max_by(F.struct("name", "arguments"), "pos").alias("call"))
    return results_of(entries).join(calls, ["session_id", "call_id"], "left").select("session_id", "pos", "seq", "call_id", "is_error", "call.name", "call.arguments")


def failed_calls(entries: DataFrame) -> DataFrame:
    """Calls with ``failed``: whether the first result of their id is an error (false without one)."""
    first = results_of(entries).groupBy("session_id", "call_id").agg(F.min_by("is_error", "pos").alias("failed"))
    return calls_of(entries).join(first, ["session_id", "call_id"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def completed_batches(archive: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Per session: calling messages (one for each message id, its first) all of whose calls have a later result.

    ``after``: session_id, seq; only messages beyond it count.
    """
    rows = archive.where("role = 'assistant'")
    if after is not None:
        rows = rows.join(after.withColumnRenamed("seq", "_after"), "session_id", "left").where("seq > coalesce(_after, -1)").drop("_after")
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("session_id", "message_id").orderBy("pos"))).where("_nth = 1")
    calls = calls_of(rows)
    last = results_of(archive).groupBy("session_id", "call_id").agg(F.max("seq").alias("result_seq"))
    done = calls.join(last, ["session_id", "call_id"], "left").groupBy("session_id", "message_id").agg(F.min(F.coalesce(F.col("result_seq") > F.col("seq"), F.lit(False))).alias("done"))
    return done.groupBy("session_id").agg(F.count_if("done").alias("batches"))


def succeeded_calls(entries: DataFrame) -> DataFrame:
    return calls_of(entries).join(results_of(entries).where("not is_error").select("session_id", "call_id"), ["session_id", "call_id"], "left_semi")


def outside(entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Rows of which ``selected`` (session_id, seq) has none."""
    return entries.join(selected.select("session_id", "seq"), ["session_id", "seq"], "left_anti")


def not_superseded(kept: DataFrame, visible: DataFrame) -> DataFrame:
    """State rows (session_id, key, seq) of which no visible row of the key is as new."""
    newest = visible.groupBy("session_id", "key").agg(F.max("seq").alias("_visible"))
    return kept.join(newest, ["session_id", "key"], "left").where("_visible is null or _visible < seq").drop("_visible")


def checkpoint_records(checkpoints: DataFrame, saved: DataFrame) -> DataFrame:
    """Checkpoints (session_id, seq, fingerprint) with the last record of the fingerprint prepared before them.

    ``saved``: session_id, fingerprint, prepared_after, ord, data.
    """
    pairs = checkpoints.join(saved, ["session_id", "fingerprint"]).where("prepared_after < seq")
    return pairs.groupBy("session_id", "seq", "fingerprint").agg(F.max_by("data", "ord").alias("data"))


def fingerprint(blocks: Column | str = "blocks") -> Column:
    return F.sha2(F.to_json(blocks), 256)


def original_users(archive: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """All rows of typed message ids whose first row has a number strictly between ``lower`` and ``upper``."""
    users = archive.where((F.col("role") == "user") & (F.col("source_kind") == "user"))
    first = users.groupBy("session_id", "message_id").agg(F.min("seq").alias("first_seq"))
    return archive.join(first.where((F.col("first_seq") > lower) & (F.col("first_seq") < upper)).select("session_id", "message_id"), ["session_id", "message_id"], "left_semi")


def orphan_closure(entries: DataFrame, rounds: int = 60) -> DataFrame:
    """The oldest unprotected row of each session and all rows tied to it by shared call ids: session_id, pos.

    Rows and call ids are the two sides of a graph, held as links of each row to the first
    row of its ids; star contraction finds its components in a number of rounds that is
    logarithmic in the longest chain of ties, over no more links than there were.
    """
    first = entries.where(~F.col("role").isin("system", "developer")).groupBy("session_id").agg(F.min("pos").alias("pos"))
    ties = calls_of(entries).select("session_id", "pos", "call_id").unionByName(results_of(entries).select("session_id", "pos", "call_id"))
    hubs = ties.groupBy("session_id", "call_id").agg(F.min("pos").alias("hub"))
    links = ties.join(hubs, ["session_id", "call_id"]).select("session_id", F.col("pos").alias("u"), F.col("hub").alias("v"))
    member = materialize(components(links, rounds), "closure")
    roots = first.join(member.withColumnRenamed("node", "pos"), ["session_id", "pos"]).select("session_id", "root")
    tied = member.join(roots, ["session_id", "root"], "left_semi").select("session_id", F.col("node").alias("pos"))
    return tied.unionByName(first).distinct()


def ordered_lookup(wanted: DataFrame, archive: DataFrame) -> DataFrame:
    """Archive rows of the requested numbers (session_id, seq, ord) in the order asked; a missing one is an error."""
    rows = wanted.join(archive.withColumn("_there", F.lit(True)), ["session_id", "seq"], "left")
    return rows.where(F.assert_true(F.col("_there").isNotNull(), F.lit("a requested message is missing")).isNull()).drop("_there")


def unprotected_paths(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """Rows whose ``path`` is none of the protected ones of the session (rows without a path stay)."""
    return rows.join(protected.select("session_id", "path").distinct(), ["session_id", "path"], "left_anti")


# The forms and kinds of source that mark a message as context rather than speech.
STATE_FORMS = ("instructions", "catalog", "snapshot")
STATE_KINDS = "skill|plan|subagent|agent-instructions"


def with_state(entries: DataFrame, forms: tuple[str, ...] = (), kinds: str = "$^") -> DataFrame:
    """Entries with ``source``, the JSON of where a message is from, and ``state_key``, what context it is a version of.

    Context of the given ``forms``, or of kinds that match ``kinds``, is one state for
    each kind and form; other context is one for each source. Null for speech.
    """
    whole = F.to_json(F.struct("source_kind", "source_form", "message_id"))
    matches = lambda isin, like: F.coalesce(F.col("source_form").isin(*isin) if isin else F.lit(False), F.lit(False)) | F.coalesce(F.col("source_kind").rlike(like), F.lit(False))
    shared = F.to_json(F.struct("source_kind", "source_form"))
    key = F.when(matches(STATE_FORMS, STATE_KINDS), F.when(matches(forms, kinds), shared).otherwise(whole))
    return entries.withColumns({"source": whole, "state_key": key})


def retained_state(entries: DataFrame, saved_users: DataFrame, saved_context: DataFrame | None = None) -> DataFrame:
    """What a session keeps beside its summary: session_id, pos, nth, what, state_key, text, in order of (pos, nth).

    ``what`` is ``user`` (typed messages) or ``context`` (context among the user's
    messages, of each state the newest). Live rows give their own; a row that is a
    checkpoint gives what its matching record has saved.
    ``saved_users``: session_id, seq (of the checkpoint), nth, text; ``saved_context``
    has a state_key too.
    """
    none = F.lit(None).cast("string")
    typed = F.coalesce(F.col("source_kind") == "user", F.lit(False))
    point = F.coalesce(F.col("source_kind") == "compact-checkpoint", F.lit(False))
    live = with_state(entries, forms=("snapshot", "catalog"), kinds="plan").where((F.col("role") == "user") & ~point & (typed | F.col("state_key").isNotNull()))
    live = live.select("session_id", "pos", F.lit(0).alias("nth"), F.when(typed, "user").otherwise("context").alias("what"), F.when(~typed, F.col("state_key")).alias("state_key"), text_of("").alias("text"))
    points = entries.where(point).select("session_id", "pos", "seq")
    held = points.join(saved_users, ["session_id", "seq"]).select("session_id", "pos", "nth", F.lit("user").alias("what"), none.alias("state_key"), "text")
    rows = live.unionByName(held)
    if saved_context is not None:
        held = points.join(saved_context, ["session_id", "seq"]).select("session_id", "pos", "nth", F.lit("context").alias("what"), "state_key", "text")
        rows = rows.unionByName(held)
    newest = F.max(F.struct("pos", "nth")).over(W.partitionBy("session_id", "what", "state_key"))
    return rows.withColumn("_newest", newest).where((F.col("what") == "user") | (F.struct("pos", "nth") == F.col("_newest"))).drop("_newest")
