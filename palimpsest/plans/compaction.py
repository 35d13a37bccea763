"""Compaction of many sessions in one plan: price, trigger, select, summarize, check, commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import message_text, transcript
from ..functions.text import file_tags, files_section, u16len
from ..operators import lineage, lookups, selection, state, structure
from ..sources import logs
from ..sources.scratch import materialize
from . import presets, restoration, retries, strategies


def priced(entries: DataFrame, price: Column) -> DataFrame:
    return entries.withColumn("price", price.cast("long"))


def pressured(entries: DataFrame, sessions: DataFrame, strategy: str, settings: strategies.Config | None = None) -> DataFrame:
    """Sessions whose price reaches the strategy's trigger: session_id, tokens, trigger. ``sessions``: session_id, window, output."""
    sums = entries.groupBy("session_id").agg(F.sum("price").alias("tokens"))
    own = settings or strategies.Config()
    trigger, _ = strategies.budget(strategy if strategy in strategies.STRATEGIES else "split_turn", F.col("window"), F.col("output"), own.reserve_tokens, own.threshold_ratio)
    rows = sums.join(sessions, "session_id").withColumn("trigger", trigger)
    return rows.where(strategies.fires(F.col("tokens"), F.col("trigger"), F.lit(strategy == "split_turn"))).select("session_id", "tokens", "trigger")


def select_region(entries: DataFrame, start: int, end: int) -> DataFrame:
    """An explicit range of positions."""
    return entries.where(F.col("pos").between(start, end)).select("session_id", "pos", "seq", "price")


def requests(entries: DataFrame, selected: DataFrame, tool_chars: int = 2_000) -> DataFrame:
    """One prompt for each session: the transcript of its selected rows."""
    rows = entries.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    return transcript(rows, message_text("more", tool_chars)).withColumnRenamed("transcript", "prompt")


def basic_checkpoint(entries: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model-free checkpoint of each session: (session_id, summary, error) and its preserved texts (session_id, ord, text).

    Preserved are earlier checkpoints, what users wrote, context among their messages,
    and the session's last three answers where they are selected; the summary lists
    files and commands.
    """
    chosen = selected.select("session_id", "pos")
    said = F.trim(logs.text_of())
    answers = entries.where((F.col("role") == "assistant") & (said != "")).withColumn("_nth", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("pos")))).where("_nth <= 3")
    rows = entries.join(chosen, ["session_id", "pos"], "left_semi").join(answers.select("session_id", "pos", F.lit(True).alias("recent")), ["session_id", "pos"], "left")
    point, user = structure.checkpoint(), F.col("role") == "user"
    # How preserved texts are introduced.
    head = F.when(point, "").when(structure.typed_user(), "[User request]\n").when(user, "[Recorded context]\n").when(F.col("recent"), "[Recent assistant response]\n")
    preserved = rows.where(head.isNotNull() & (said != "")).select("session_id", F.col("pos").alias("ord"), F.concat(head, logs.text_of()).alias("text"))
    acts = lineage.activity(rows).groupBy("session_id").agg(*[
        F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == k, F.struct("first_pos", "item"))), lambda x: x.isNotNull())), lambda x: x["item"]).alias(k)
        for k in ("read", "edited", "command")
    ])
    sessions = rows.select("session_id").distinct().join(acts, "session_id", "left")
    none = F.array().cast("array<string>")
    commands = F.coalesce(F.nullif(F.array_join(F.transform(F.coalesce("command", none), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("- none"))
    text = F.concat(F.lit("Context record:\n\n"), files_section(F.coalesce("read", none), F.coalesce("edited", none)), F.lit("\n\n## Tool commands\n"), commands, F.lit("\n\nGo on with what is pending. Commands listed were tried; see their results for success."))
    return sessions.select("session_id", text.alias("summary"), F.lit(None).cast("string").alias("error")), preserved


def branch_summaries(entries: DataFrame, wanted: DataFrame, model: Callable[[str], str], budget: int, tool_chars: int = 2_000, max_chars: int = 16_384) -> DataFrame:
    """A summary of each explored branch: session_id, summary, error, rows, tokens.

    ``wanted``: session_id, seq, ord of the branch's rows, all of which must be there;
    the newest within ``budget`` are summarized, and the files that the whole branch
    read or modified are listed.
    """
    # Written before anything is left out of it: a missing row must be seen.
    rows = materialize(lookups.ordered_lookup(wanted, entries).drop("ord"), "branch").where(~structure.protected())
    taken = selection.branch(rows, budget)
    asked = requests(rows, taken, tool_chars)
    files = lineage.activity(rows).groupBy("session_id").agg(F.collect_set(F.when(F.col("kind") == "read", F.col("item"))).alias("r"), F.collect_set(F.when(F.col("kind") == "edited", F.col("item"))).alias("w"))
    out = logs.summarize(asked, model, max_chars).join(files, "session_id", "left").join(taken.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "session_id")
    none = F.array().cast("array<string>")
    text = F.concat(F.lit("What another branch of this conversation explored:\n\n"), F.col("summary"), file_tags(F.coalesce("r", none), F.coalesce("w", none)))
    return out.select("session_id", text.alias("summary"), "error", "rows", "tokens")


def commit(entries: DataFrame, selected: DataFrame, summaries: DataFrame, preserved: DataFrame | None = None, restored: DataFrame | None = None, price: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new entries, verdicts). A checkpoint replaces its range only if it is smaller.

    Its blocks are the texts of ``preserved`` (session_id, ord, text), the summary, and
    the texts of ``restored``, or its column ``block`` where it has one. ``price`` is what the range was priced with: evaluated on
    the checkpoint's own row, so that both sides are measured alike; where it needs what
    only a logged row has (a stored estimate), a text costs a quarter of its
    characters and an image its flat rate.
    """
    good = summaries.where("summary is not null")
    kind = entries.schema["blocks"].dataType
    for name, texts in (("ahead", preserved), ("extra", restored)):
        if texts is None:
            good = good.withColumn(name, F.array().cast(kind))
            continue
        parts = texts if "block" in texts.columns else texts.withColumn("block", logs.block("text", F.col("text")))
        parts = parts.withColumn("block", F.col("block").cast(logs.BLOCK))
        own = parts.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias(name))
        good = good.join(own, "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    good = good.withColumn("blocks", F.concat("ahead", F.array(logs.block("text", F.col("summary"))), "extra"))
    tokens = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.when(b["type"] == "image", restoration.IMAGE_TOKENS).otherwise(F.floor((u16len(F.coalesce(b["text"], F.lit(""))) + 3) / 4)).cast("long"))
    if price is not None:
        point = {"session_id": F.col("session_id"), "blocks": F.col("blocks"), "role": F.lit("user"), "source_kind": F.lit("compact-checkpoint"), "is_error": F.lit(False)}
        own = good.select("session_id", F.struct("ahead", "extra", "summary").alias("_parts"), *[point.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in entries.schema if f.name != "session_id"])
        good = own.withColumns({"_own": price.cast("long")}).select("session_id", "blocks", "_own")
        tokens = F.coalesce("_own", tokens)
    old = selected.groupBy("session_id").agg(F.sum("price").alias("old_tokens"), F.count("*").alias("rows"))
    last = entries.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    verdicts = good.withColumn("tokens", tokens).join(old, "session_id").join(last, "session_id").withColumn("accepted", F.col("tokens") < F.col("old_tokens"))
    points = verdicts.where("accepted").select("session_id", (F.col("last_seq") + 1).alias("seq"), "blocks")
    return logs.compact(entries, selected, points), verdicts.select("session_id", "rows", "old_tokens", "tokens", "accepted")


#: Presets that restore context after the summary.
_RESTORES = ("idle_headroom", "image_guard", "round_keep", "head_tail")


def _restored(strategy: str, rows: DataFrame, selected: DataFrame, files: DataFrame | None, recovery: DataFrame | None, own: strategies.Config) -> DataFrame | None:
    """What the preset puts after the summary; None where it restores nothing or there is nothing to restore from."""
    if strategy not in _RESTORES or own.restore_context is False or (files is None and recovery is None):
        return None
    given = lambda value, default: default if value is None else value
    budget, file_tokens, most = given(own.max_restore_tokens, 50_000), given(own.max_file_tokens, 5_000), given(own.max_restored_files, 5)
    if strategy == "head_tail":
        return restoration.recovery_notes(selected, recovery)
    if strategy == "round_keep":
        return restoration.restore_reads(rows, selected, files, recovery, None, budget, file_tokens, most)
    files = rows.sparkSession.createDataFrame([], "path string, text string") if files is None else files
    limits = (budget, given(own.max_skill_tokens, 5_000), file_tokens, most)
    if strategy == "idle_headroom":
        return restoration.restore(rows, selected, files, *limits)
    return restoration.restore_with_images(rows, selected, files, *limits, given(own.max_restored_images, 3))


_VERSIONED = ["pos", "seq", "role", "blocks"]

#: What stands before the summary, where a preset keeps anything.
_PRESERVED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"user_tail": presets.retained_with_context, "head_tail": presets.head_and_tail_users}


def run(
    entries: DataFrame,
    sessions: DataFrame,
    strategy: str,
    price: Column,
    keep: int | None = None,
    model: Callable[[str], str] | None = None,
    max_chars: int = 8_192,
    settings: strategies.Config | None = None,
    latest: DataFrame | None = None,
    files: DataFrame | None = None,
    owners: DataFrame | None = None,
    manual: bool = False,
    recovery: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole plan for the sessions under pressure: price, trigger, select, summarize, restore, check, commit.

    Without ``model`` the checkpoint needs none. ``keep`` defaults to the setting
    ``keep_recent_tokens``, else to 0. ``settings`` also sets reserve and ratio of the
    trigger. With ``latest``, the log as read again before the commit, sessions that
    changed meanwhile are left as they are: another writer came first. With ``files``
    (path, text) or ``recovery`` (see ``restoration``), presets that restore context put
    it after the summary. With
    ``owners`` (``state.ownership``), sessions that another writer holds, or whose turn
    does not admit this compaction (``manual`` or not), are left as they are. Summaries are
    asked for by the strategy's own flow (``retries``), an own strategy's once; an answer
    that is cut, blank or longer than ``max_chars`` is a fault and never committed.
    """
    own = settings or strategies.Config()
    keep = own.keep_recent_tokens or 0 if keep is None else keep
    rows = materialize(priced(entries, price), "priced")  # read by every step below
    if owners is not None:
        sessions = sessions.join(owners.where(state.refusal(manual).isNull()).select("session_id"), "session_id", "left_semi")
    due = rows.join(pressured(rows, sessions, strategy, own).select("session_id"), "session_id", "left_semi")
    select = strategies.strategy(strategy) if strategy in strategies._REGISTRY else presets.SELECT[strategy]
    selected = materialize(select(due, keep), "selected")
    if model is None:
        summaries, preserved = basic_checkpoint(due, selected)
    else:
        chars = 2_000 if own.summary_tool_chars is None else own.summary_tool_chars
        flow = strategy if strategy in retries.FLOWS else "turn_tail"
        gone = due.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
        units = retries.units_of(gone, message_text("more", chars), flow).join(sessions.select("session_id", F.col("window").alias("_window")), "session_id")
        asked, _ = retries.summarize(retries.opened(units, F.col("_window")), lambda session, number, prompt: model(prompt), flow, attempts=own.max_summary_attempts, base_ms=own.summary_retry_delay_ms, max_chars=max_chars)
        summaries = asked.select("session_id", "summary", "error")
        preserved = _PRESERVED[strategy](due, selected) if strategy in _PRESERVED and own.restore_context is not False else None
        if strategy == "calibrated":  # where the model failed, the checkpoint that needs none
            basic = asked.where("status = 'basic'").select("session_id")
            instead, preserved = basic_checkpoint(due.join(basic, "session_id", "left_semi"), selected.join(basic, "session_id", "left_semi"))
            summaries = summaries.join(basic, "session_id", "left_anti").unionByName(instead)
    if strategy == "head_tail" and model is not None:
        summaries = restoration.with_todos(summaries, due, recovery)
    summaries = materialize(summaries, "summaries")
    if latest is not None:
        summaries = summaries.join(state.unchanged(state.version(entries, _VERSIONED), state.version(latest, _VERSIONED)), "session_id", "left_semi")
    restored = _restored(strategy, due, selected, files, recovery, own)
    return commit(rows, selected, summaries, preserved, restored, price)
