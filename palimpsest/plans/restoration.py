"""What a compacted session gets back, by each preset's own rules.

``restore`` serves ``idle_headroom``, ``restore_with_images`` ``image_guard``,
``restore_reads`` ``round_keep`` and ``recovery_notes`` ``head_tail``; what
``user_tail`` keeps stands before the summary (``presets.retained_with_context``).
Every result has session_id, ord, text, and ``block`` where one is no text.

``recovery`` is what the host observed of a session: session_id and any of reminders
(texts), plan_path, todos, transcript_path, wire_path, window_lines, repl_cleared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normal_name, path_from_json, pretty_json
from ..operators import lineage, lookups, selection, structure
from ..sources import logs

FILE_TOOLS = ("read", "readfile", "edit", "editfile", "write", "writefile")
IMAGE_TOKENS = 1_600
SKILL_TOOLS = ("skill", "loadskill", "skillread")


def state_items(archive: DataFrame, visible: DataFrame, ending: str = " context") -> DataFrame:
    """The newest context of each state that is not visible any more: session_id, pos, label, body, skill.

    Snapshots, plans and sub-agent notes are one state for each kind, others for each
    source. ``skill`` tells whether the kind is a skill's.
    """
    rows = lookups.with_state(archive, forms=("snapshot",), kinds="plan|subagent").where("state_key is not null")
    rows = rows.select("session_id", "pos", "source", "state_key", F.concat(F.lit("Restored "), "source_kind", F.lit(ending)).alias("label"), logs.text_of().alias("body"), F.col("source_kind").rlike("skill").alias("skill"))
    seen = lookups.with_state(visible).select("session_id", "source")
    return lineage.newest_sources(rows, seen).select("session_id", "pos", "label", "body", "skill")


def skill_items(archive: DataFrame) -> DataFrame:
    """The newest successful result of each distinct skill invocation."""
    named = lookups.identify_results(archive).where("not is_error").withColumn("tool", normal_name(F.col("name"), only_letters=True)).where(F.col("tool").isin(*SKILL_TOOLS))
    newest = lineage.distinct_newest(named, "arguments")
    return newest.join(archive.select("session_id", "pos", logs.text_of().alias("body")), ["session_id", "pos"]).select("session_id", "pos", F.concat(F.lit("Invoked skill "), "arguments").alias("label"), "body")


def file_items(selected: DataFrame, remaining: DataFrame | None, archive: DataFrame, files: DataFrame, most: int = 5, file_tokens: int = 5_000, instructions: tuple[str, ...] = ("AGENTS.md",)) -> DataFrame:
    """Files that the selected results touched and no remaining one shows, newest first; files named in ``instructions`` stay out."""
    named = lookups.identify_results(archive).withColumns({"tool": normal_name(F.col("name"), only_letters=True), "path": path_from_json(F.col("arguments"))}).where(F.col("tool").isin(*FILE_TOOLS) & F.col("path").isNotNull())
    mine = named.where("not is_error").join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    if remaining is not None:
        mine = lookups.unprotected_paths(mine, named.join(remaining.select("session_id", "pos"), ["session_id", "pos"], "left_semi"))
    name = F.lower(F.element_at(F.split("path", "[/\\\\]"), -1))
    mine = mine.where(~name.isin(*[n.lower() for n in instructions]))
    wanted = mine.groupBy("session_id", "path").agg((-F.max("pos")).alias("rank"))
    found = lineage.restored_files(wanted, files, most, file_tokens)
    return found.select("session_id", (-F.col("rank")).alias("pos"), F.concat(F.lit("Current file "), "path").alias("label"), F.col("content").alias("body"))


def _in_order(selected: DataFrame, *parts: DataFrame) -> DataFrame:
    """The parts one after another, each newest first, as items of ``selection.append_within``."""
    parts = [p.select("session_id", "pos", "label", "body", "cap", "pooled", "excerpt", F.lit(i).alias("rank")) for i, p in enumerate(parts)]
    items = reduce(DataFrame.unionByName, parts).join(selected.select("session_id").distinct(), "session_id", "left_semi")
    return items.withColumn("ord", F.row_number().over(W.partitionBy("session_id").orderBy("rank", F.desc("pos"), "label")).cast("long"))


def _as_items(rows: DataFrame, cap: Column | int, pooled: Column | bool = False, excerpt: bool = False) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({"cap": lit(cap).cast("long"), "pooled": lit(pooled), "excerpt": F.lit(excerpt)})


def restore(archive: DataFrame, selected: DataFrame, files: DataFrame, budget: int = 50_000, skill_tokens: int = 5_000, file_tokens: int = 5_000, most_files: int = 5, skill_pool: int = 25_000) -> DataFrame:
    """Per session the restored texts under nested budgets: session_id, ord, text, used.

    State comes first, then skills, then files, each newest first. All share ``budget``;
    what is a skill, be it context or the result of a call, has at most ``skill_tokens``
    and shares ``skill_pool`` inside the budget. ``selected``: session_id, pos of the
    rows that a checkpoint is to replace.
    """
    remaining = archive.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_anti")
    items = _in_order(
        selected,
        _as_items(state_items(archive, remaining), F.when(F.col("skill"), skill_tokens).otherwise(budget), F.col("skill")),
        _as_items(skill_items(archive), skill_tokens, pooled=True),
        _as_items(file_items(selected, remaining, archive, files, most_files, file_tokens), file_tokens, excerpt=True),
    )
    return selection.append_within(items.drop("rank", "pos"), budget, skill_pool)


def restore_with_images(
    archive: DataFrame,
    selected: DataFrame,
    files: DataFrame,
    budget: int = 50_000,
    skill_tokens: int = 5_000,
    file_tokens: int = 5_000,
    most_files: int = 5,
    most_images: int = 3,
    media_free: DataFrame | None = None,
    image_tokens: int = IMAGE_TOKENS,
) -> DataFrame:
    """State, skills, files and the last images of the selection under one budget: session_id, ord, text, used, block.

    Files come whether or not they are still shown. Images of failed results and those
    moved out of the log stay out; as many of the last come back as the rest of the
    budget pays for. Sessions in ``media_free``, whose requests were too large with
    media, get their state only.
    """
    remaining = archive.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_anti")
    known = _as_items(state_items(archive, remaining, ""), F.when(F.col("skill"), skill_tokens).otherwise(budget))
    more = [_as_items(skill_items(archive), skill_tokens), _as_items(file_items(selected, None, archive, files, most_files, file_tokens, ()), file_tokens, excerpt=True)]
    rows = archive.join(selected.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
    if media_free is not None:
        bare = media_free.select("session_id").distinct()
        more, rows = [m.join(bare, "session_id", "left_anti") for m in more], rows.join(bare, "session_id", "left_anti")
    texts = selection.append_within(_in_order(selected, known, *more).drop("rank", "pos"), budget)
    texts = texts.withColumn("block", logs.block("text", F.col("text")).cast(logs.BLOCK))
    shown = rows.where(~((F.col("role") == "tool") & F.col("is_error"))).select("session_id", "pos", F.posexplode("blocks").alias("at", "block"))
    shown = shown.where((F.col("block.type") == "image") & ~F.col("block.name").eqNullSafe("offloaded"))
    shown = shown.withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("at"))))
    spent = texts.groupBy("session_id").agg(F.sum("used").alias("spent"))
    room = F.floor((F.lit(budget) - F.coalesce("spent", F.lit(0))) / image_tokens)
    images = shown.where(F.col("back") <= most_images).join(spent, "session_id", "left").where(F.col("back") <= room)
    images = images.select("session_id", (F.lit(1 << 40) - F.col("back")).alias("ord"), F.lit(None).cast("string").alias("text"), F.lit(image_tokens).cast("long").alias("used"), F.col("block").cast(logs.BLOCK).alias("block"))
    return texts.unionByName(images)


def reread_files(archive: DataFrame, selected: DataFrame, since: DataFrame | None = None, budget: int = 50_000, file_tokens: int = 5_000, most: int = 5, tools: tuple[str, ...] = ("read", "readfile")) -> DataFrame:
    """The last texts that reading tools gave for the files read last: session_id, path, nth, tokens, text (null where too large).

    Of each path the last successful result counts, if it is text only and after
    ``since`` (session_id, seq); paths whose call stays visible, and those inside
    ``.git``, do not. A text comes back whole or not at all: one above ``file_tokens``,
    or above what those before it left of ``budget``, is only named.
    """
    seq = F.col("seq")
    gone = selected.select("session_id", "pos", F.lit(True).alias("gone"))
    path = F.replace(path_from_json(F.col("arguments"), ("file_path", "path"), skip_empty=False), F.lit("\\"), F.lit("/"))
    calls = logs.calls_of(archive).withColumn("path", path).where(normal_name(F.col("name"), only_letters=True).isin(*tools) & (F.col("path") != "") & ~F.array_contains(F.split("path", "/"), ".git"))
    calls = calls.join(gone, ["session_id", "pos"], "left").select("session_id", "call_id", "pos", F.struct("path", F.col("gone").isNull().alias("stays")).alias("call"))
    texts = archive.where((F.col("role") == "tool") & ~F.col("is_error") & F.forall("blocks", lambda b: b["type"] == "text"))
    if since is not None:
        texts = texts.join(since.select("session_id", seq.alias("_since")), "session_id", "left").where(F.col("_since").isNull() | (seq > F.col("_since")))
    texts = texts.select("session_id", F.col("tool_call_id").alias("call_id"), "pos", "time_ms", logs.text_of().alias("body"))
    both = calls.unionByName(texts.withColumn("result", F.lit(True)), allowMissingColumns=True)
    # The last call of an id before a result: a later one of the same id tells nothing about it.
    told = F.last("call", ignorenulls=True).over(W.partitionBy("session_id", "call_id").orderBy("pos", F.col("result").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    reads = both.withColumn("call", told).where("result and call is not null").select("session_id", "call.*", "pos", "time_ms", "body")
    last = reads.groupBy("session_id", "path").agg(F.max_by(F.struct("time_ms", "body", "stays"), "pos").alias("r"), F.min("pos").alias("first_pos")).where("not r.stays")
    nth = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("r.time_ms"), "first_pos"))
    last = last.withColumn("nth", nth).where(F.col("nth") <= most).select("session_id", "nth", "path", F.floor((F.length("r.body") + 3) / 4).cast("long").alias("tokens"), F.col("r.body").alias("body"))

    def taken(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("fits"))

        def step(a: Column, i: Column) -> Column:
            fits = (i["tokens"] <= file_tokens) & (a["used"] + i["tokens"] <= budget)
            return F.struct((a["used"] + F.when(fits, i["tokens"]).otherwise(0)).cast("long").alias("used"), F.concat(a["fits"], F.array(fits)).alias("fits"))

        return F.aggregate(items, start, step)["fits"]

    sets = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", "path", "tokens", "body"))).alias("items"))  # ``most`` at most
    out = sets.select("session_id", F.explode(F.arrays_zip("items", taken(F.col("items")).alias("fits"))).alias("z")).select("session_id", "z.items.*", F.col("z.fits").alias("fits"))
    return out.select("session_id", "path", "nth", "tokens", F.when(F.col("fits"), F.col("body")).alias("text"))


_RECOVERY = {"reminders": "array<string>", "plan_path": "string", "todos": "string", "transcript_path": "string", "wire_path": "string", "window_lines": "string", "repl_cleared": "boolean"}
_STEP = 1 << 20


def _observed(sessions: DataFrame, recovery: DataFrame | None) -> DataFrame:
    """One row a session with every field of recovery, null where nothing was observed."""
    if recovery is None:
        return sessions.select("session_id", *[F.lit(None).cast(t).alias(n) for n, t in _RECOVERY.items()])
    known = recovery.select("session_id", *[(F.col(n) if n in recovery.columns else F.lit(None)).cast(t).alias(n) for n, t in _RECOVERY.items()])
    return logs.with_recovery(sessions, known)


def _notes(rows: DataFrame, texts: list[tuple[int, Column]]) -> DataFrame:
    """The reminders of each session, then those of ``texts`` (place, text) that are not null."""
    first = F.transform(F.coalesce("reminders", F.array().cast("array<string>")), lambda t, i: F.struct(i.cast("long").alias("ord"), t.alias("text")))
    own = F.array(*[F.struct(F.lit(place * _STEP).cast("long").alias("ord"), text.alias("text")) for place, text in texts])
    return rows.select("session_id", F.explode(F.filter(F.concat(first, own), lambda x: x["text"].isNotNull())).alias("n")).select("session_id", "n.*")


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def restore_reads(archive: DataFrame, selected: DataFrame, files: DataFrame | None = None, recovery: DataFrame | None = None, since: DataFrame | None = None, budget: int = 50_000, file_tokens: int = 5_000, most_files: int = 5, plan_chars: int = 20_000) -> DataFrame:
    """Reminders, the approved plan, the files read last, todos, where the transcript is, and a last word: session_id, ord, text."""
    rows = _observed(selected.select("session_id").distinct(), recovery)
    if files is not None:
        plans = files.select(F.col("path").alias("plan_path"), F.substring("text", 1, plan_chars).alias("plan"))
        rows = rows.join(plans, "plan_path", "left")
    else:
        rows = rows.withColumn("plan", F.lit(None).cast("string"))
    # How what comes back is introduced.
    plan = F.when(F.trim("plan") != "", F.concat(F.lit("Approved plan file: "), "plan_path", F.lit("\n\n"), "plan", F.lit("\n\nContinue this plan if it remains relevant and unfinished.")))
    todos = F.concat(F.lit("Current task state:\n"), _given(F.col("todos")))
    transcript = F.concat(F.lit("Earlier exact output and messages remain at: "), _given(F.col("transcript_path")))
    cleared = F.when(F.col("repl_cleared"), "The host cleared REPL state during compaction. Recreate variables before using them.")
    last = F.lit("Continue the latest unfinished task directly, preserving the user constraints in the summary.")
    notes = _notes(rows, [(1, plan), (3, todos), (4, transcript), (5, cleared), (6, last)])
    reads = reread_files(archive, selected, since, budget, file_tokens, most_files)
    whole = F.concat(F.lit("Earlier successful Read of "), "path", F.lit(":\n"), "text")
    named = F.concat(F.lit("File read before compaction: "), "path", F.lit(". Its contents exceed the restoration budget; read the file again when needed."))
    return notes.unionByName(reads.select("session_id", (F.lit(2 * _STEP) + F.col("nth")).cast("long").alias("ord"), F.coalesce(whole, named).alias("text")))


def recovery_notes(selected: DataFrame, recovery: DataFrame | None = None) -> DataFrame:
    """Reminders, where the earlier conversation lies, and a last word: session_id, ord, text."""
    rows = _observed(selected.select("session_id").distinct(), recovery)
    lines = F.coalesce(F.concat(F.lit("\n"), _given(F.col("window_lines"))), F.lit(""))
    # How what comes back is introduced.
    path = F.concat(F.lit("## Context Recovery\nEarlier conversation remains in the session log: "), _given(F.coalesce("wire_path", "transcript_path")), lines, F.lit("\nRead the relevant records for exact output, paths, or previous requests."))
    last = F.lit("<system-reminder>Context compaction is complete. Continue the work that was in progress.</system-reminder>")
    return _notes(rows, [(1, path), (2, last)])


def with_todos(summaries: DataFrame, archive: DataFrame, recovery: DataFrame | None = None) -> DataFrame:
    """``summaries`` with the session's todos after the text: those observed, else the newest list that a call wrote."""
    observed = _observed(summaries.select("session_id"), recovery).select("session_id", F.col("todos").alias("observed"))
    rows = summaries.join(observed, "session_id", "left").join(lineage.latest_todos(archive), "session_id", "left")
    todos = F.nullif(F.coalesce("observed", pretty_json(F.col("todos"))), F.lit(""))
    text = F.concat("summary", F.coalesce(F.concat(F.lit("\n\n## TODO List\n"), todos), F.lit("")))
    return rows.withColumn("summary", text).select(*summaries.columns)


def basic_range(entries: DataFrame, target: int, overhead: int = 120) -> DataFrame:
    """Per session ``cut``: the shortest range whose model-free checkpoint is smaller than it and leaves at most ``target`` tokens.

    A checkpoint keeps the text of user messages and of the session's last three answers
    (``price`` tokens each) and ``overhead``. Cuts have nothing open and no result after
    them; without one that fits, the whole session is the range.
    """
    rows = structure.indexed(selection.with_suffix(structure.balanced(entries)))
    nth = F.row_number().over(W.partitionBy("session_id", F.col("role") == "assistant").orderBy(F.desc("pos")))
    kept = F.when((F.col("role") == "user") | ((F.col("role") == "assistant") & (nth <= 3)), F.col("price")).otherwise(0)
    rows = rows.withColumn("_kept", kept)
    rows = rows.withColumns({"_point": F.sum("_kept").over(structure.rows_upto()) + overhead, "_range": F.sum("price").over(structure.rows_upto()), "_next": F.lead("role").over(structure.session_order()), "_fresh": F.max((~structure.checkpoint()).cast("int")).over(structure.rows_upto())})
    fits = (F.col("open_after") == 0) & F.coalesce(F.col("_next") != "tool", F.lit(True)) & (F.col("_fresh") == 1) & (F.col("_point") < F.col("_range")) & (F.col("_point") + F.col("later") <= target)
    return rows.groupBy("session_id").agg(F.coalesce(F.min(F.when(fits, F.col("idx") + 1)), F.max("n")).alias("cut"), F.max("n").alias("rows"))
