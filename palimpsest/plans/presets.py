"""Which rows each preset hands to a summary: one plan a strategy, made of the set operators.

A span is a run of rows between protected ones. Its rows get a session id of their own
(``per_span``), so that every operator on sessions works on spans, and of a session's
spans the first that gives a selection is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lookups, selection, structure
from ..operators.structure import all_rows, checkpoint, session_order, typed_user
from ..sources.logs import text_of


def per_span(entries: DataFrame, guard: Column | None = None) -> DataFrame:
    """Rows of all spans with anything but checkpoints; ``owner`` is the session, ``session_id`` the span's own, ``island`` its place.

    ``tail`` is the price of the session's rows after each row, protected ones included.
    """
    rows = selection.with_suffix(entries).withColumnRenamed("later", "tail").drop("suffix", "total")
    rows = structure.islands(rows, guard)
    fresh = F.max((~checkpoint()).cast("int")).over(W.partitionBy("session_id", "island"))
    rows = rows.withColumn("_fresh", fresh).where("_fresh = 1").drop("_fresh")
    return rows.withColumn("owner", F.col("session_id")).withColumn("session_id", F.concat_ws("#", F.col("owner").cast("string"), F.col("island").cast("string")))


def first_span(rows: DataFrame, least: int = 1) -> DataFrame:
    """Of each session the rows of the first span that has at least ``least`` of them."""
    counted = rows.withColumn("_n", F.count("*").over(all_rows())).where(F.col("_n") >= least)
    chosen = F.min("island").over(W.partitionBy("owner"))
    counted = counted.withColumn("_chosen", chosen).where(F.col("island") == F.col("_chosen"))
    return counted.select(F.col("owner").alias("session_id"), "pos", "seq", "price")


def completed(spans: DataFrame) -> DataFrame:
    """The rows of each span up to its last with no call open, with ``rest``: the price of the session's rows after them."""
    rows = structure.balanced(spans)
    end = F.max(F.when(F.col("open_after") == 0, F.col("pos"))).over(all_rows())
    rows = rows.withColumn("_end", end).where(F.col("pos") <= F.col("_end"))
    return rows.withColumn("rest", F.min("tail").over(all_rows())).drop("_end", "open_before", "open_after")


def before_recent_rounds(mode: str) -> Callable[[DataFrame, int], DataFrame]:
    """All complete rounds but the last ones, which are kept while what comes after them holds fewer than ``keep`` tokens."""

    def select(entries: DataFrame, keep: int) -> DataFrame:
        rows = completed(per_span(entries))
        rows = rows.withColumn("_n", F.count("*").over(all_rows())).where("_n >= 2").drop("_n")
        rows = structure.rounds(rows, mode)
        later = F.coalesce(F.sum("price").over(W.partitionBy("session_id").orderBy(F.desc("round")).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
        gone = rows.withColumn("_later", later).where(F.col("_later") >= F.greatest(F.lit(0), F.lit(keep) - F.col("rest")))
        return first_span(gone, 2)

    return select


def first_completed_span(entries: DataFrame, keep: int) -> DataFrame:
    """The whole of the first balanced part that holds an answer or a result; ``keep`` is for what users get back."""
    ends = structure.completed_spans(entries).where("rows > 1").select("session_id", "first_pos", "last_pos")
    return entries.join(ends, "session_id").where(F.col("pos").between(F.col("first_pos"), F.col("last_pos"))).select("session_id", "pos", "seq", "price")


def before_turn_tail(entries: DataFrame, keep: int, tail_turns: int | None = None) -> DataFrame:
    """All of a span before its last turns that fit ``keep`` tokens, or before the part of a turn that does."""
    rows = per_span(entries)
    if "json_len" not in rows.columns:
        rows = rows.withColumn("json_len", F.col("price") * 4)
    kept = selection.turn_tail(rows, keep, tail_turns).select("session_id", "kept")
    gone = structure.indexed(rows).join(kept, "session_id").where("idx < kept")
    fresh = F.max((~checkpoint()).cast("int")).over(all_rows())
    return first_span(gone.withColumn("_fresh", fresh).where("_fresh = 1"))


def before_cut(entries: DataFrame, keep: int) -> DataFrame:
    """Rows of the first span that lie before its suffix cut."""
    rows = structure.islands(entries).withColumn("_fresh", F.max(~checkpoint()).over(W.partitionBy("session_id", "island")))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_fresh"), F.col("island"))).over(all_rows()))
    span = rows.where(F.col("island") == F.col("_first")).drop("island", "_fresh", "_first")
    return selection.with_cut(span, keep).where("chosen").select("session_id", "pos", "seq", "price")


def before_kept_rounds(entries: DataFrame, keep: int, tail_rounds: int = 1) -> DataFrame:
    """The balanced start of all rounds but the last ``tail_rounds``, and more of them up to ``keep`` tokens; it has two rounds and an answer."""
    rows = per_span(entries, structure.context_prefix(text_of()))
    kept = selection.keep_rounds(rows, tail_rounds, keep).select("session_id", "keep", "rounds")
    rows = structure.balanced(structure.rounds(rows, "assistant")).join(kept, "session_id").where(F.col("round") < F.col("rounds") - F.col("keep"))
    end = F.max(F.when(F.col("open_after") == 0, F.col("pos"))).over(all_rows())
    rows = rows.withColumn("_end", end).where(F.col("pos") <= F.col("_end"))
    good = structure.enough(rows).select("session_id")
    return first_span(rows.join(good, "session_id", "left_semi"))


def first_whole_span(entries: DataFrame, keep: int) -> DataFrame:
    return first_span(per_span(entries))


def before_typed_cut(entries: DataFrame, keep: int) -> DataFrame:
    """The first safe span: whole if it ends before the latest typed message, else up to its typed cut."""
    latest = F.max(F.when(typed_user(), F.col("pos"))).over(all_rows())
    rows = structure.safe_rows(entries.withColumn("_latest", F.coalesce(latest, F.lit(-1)))).drop("idx", "n", "open_before", "open_after")
    rows = rows.withColumn("owner", F.col("session_id")).withColumn("session_id", F.concat_ws("#", F.col("owner").cast("string"), F.col("island").cast("string")))
    rows = selection.with_typed_cut(rows.withColumn("_last", F.max("pos").over(all_rows())), keep)
    rows = rows.where((F.col("_last") < F.col("_latest")) | (F.col("idx") < F.col("cut")))
    fresh = F.max((~checkpoint()).cast("int")).over(all_rows())
    return first_span(rows.withColumn("_fresh", fresh).where("_fresh = 1"))


#: Per preset: (entries with ``price``, tokens to keep) -> selected rows (session_id, pos, seq, price).
SELECT: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "idle_headroom": before_recent_rounds("message"),
    "user_tail": first_completed_span,
    "turn_tail": before_turn_tail,
    "split_turn": before_cut,
    "image_guard": before_recent_rounds("pending"),
    "round_keep": before_kept_rounds,
    "head_tail": first_whole_span,
    "calibrated": before_typed_cut,
}

# What users get back beside the summary, per preset.


def retained_users(entries: DataFrame, selected: DataFrame, budget: int = 20_000) -> DataFrame:
    """Typed messages of the selection, newest first within ``budget``: session_id, ord, text. The oldest may be cut to its middle's ends."""
    from ..functions.text import middle_truncate

    rows = entries.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    kept = selection.retain_users(rows, budget).join(rows.select("session_id", "pos", text_of("").alias("body")), ["session_id", "pos"])
    body = F.when(F.col("kept_tokens") < F.col("tokens"), middle_truncate(F.col("body"), F.col("kept_tokens").cast("double"))).otherwise(F.col("body"))
    nth = F.row_number().over(session_order())
    return kept.select("session_id", "pos", body.alias("body")).withColumn("ord", nth.cast("long")).select("session_id", "ord", F.concat(F.lit("[Retained user message "), F.col("ord").cast("string"), F.lit("]\n"), F.col("body")).alias("text"))


def retained_with_context(entries: DataFrame, selected: DataFrame, budget: int = 20_000) -> DataFrame:
    """``retained_users`` with the newest context of each state before the last of them, or alone: session_id, ord, text."""
    users = retained_users(entries, selected, budget)
    rows = entries.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    nothing = rows.limit(0).select("session_id", "seq", F.lit(0).alias("nth"), F.lit("").alias("text"))
    context = lookups.retained_state(rows, nothing).where("what = 'context' and text <> ''")
    place = F.row_number().over(W.partitionBy("session_id").orderBy("pos", "nth"))
    last = users.groupBy("session_id").agg(F.max("ord").alias("_last"))
    context = context.join(last, "session_id", "left").select("session_id", ((F.coalesce("_last", F.lit(1)) - 1) * (1 << 20) + place).cast("long").alias("ord"), "text")
    return users.withColumn("ord", F.col("ord") * (1 << 20)).unionByName(context)


def head_and_tail_users(entries: DataFrame, selected: DataFrame, budget: int = 20_000, head: int = 2_000) -> DataFrame:
    """Typed messages as a head, a notice of what is left out, and a tail: session_id, ord, text.

    A message on an edge is cut to the tokens left for it, at its end in the head and at
    its start in the tail; one that lies across both gives a part to each.
    """
    from ..functions.text import weighted_clip

    rows = entries.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    parts = selection.head_tail_users(rows, budget, head).join(rows.select("session_id", "pos", "price", text_of("").alias("body")), ["session_id", "pos"])
    clipped = lambda tokens, from_end: weighted_clip(F.col("body"), tokens.cast("double"), F.lit(from_end))
    left = F.sum("price").over(W.partitionBy("session_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing))
    room = F.greatest(F.lit(0), F.lit(budget - min(head, budget)) - F.coalesce("_left", F.lit(0)))
    parts = parts.withColumn("_left", left).withColumn("_end", F.when(F.col("part") == "split", room))
    item = lambda ord_, text: F.struct(ord_.alias("ord"), text.alias("text"))
    out = (
        F.when(F.col("part").isin("all", "tail"), F.array(item(F.col("pos") * 2 + (1 << 40), F.col("body"))))
        .when(F.col("part") == "head", F.array(item(F.col("pos") * 2, F.col("body"))))
        .when(F.col("part") == "clip", F.array(item(F.col("pos") * 2, clipped(F.col("kept_tokens"), False))))
        .when(F.col("part") == "split", F.array(item(F.col("pos") * 2, clipped(F.col("kept_tokens") - F.col("_end"), False)), item(F.col("pos") * 2 + (1 << 40), clipped(F.col("_end"), True))))
    )
    texts = parts.select("session_id", F.explode(out).alias("i")).select("session_id", "i.*").where("text <> ''")
    cut = parts.where(F.col("part").isin("split", "clip", "gone")).select("session_id").distinct()
    notice = cut.select("session_id", F.lit((1 << 40) - 1).alias("ord"), F.lit("[Earlier user messages were left out here]").alias("text"))
    return texts.unionByName(notice)
