"""Session logs as DataFrames: the canonical schema, adapters, scans, lookups and writers.

``entries`` has one row for each message that a session's model can see, in the order
of ``pos``; ``seq`` is the message's number in the append-only log and may be out of
that order after a replacement. Durable plugin state lies in ``records``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import plain_unions

USAGE = T.StructType([T.StructField(n, T.LongType()) for n in ("input", "output", "cache_read", "cache_write", "total")])
BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "id", "name", "arguments", "media_type")])
RECORD = "session_id long, seq long, plugin string, kind string, data string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def block(kind: str, text: Column | None = None, id: Column | None = None, name: Column | None = None, arguments: Column | None = None, media_type: Column | None = None) -> Column:
    parts = {"type": F.lit(kind), "text": text, "id": id, "name": name, "arguments": arguments, "media_type": media_type}
    return F.struct(*[(F.lit(None) if v is None else v).cast("string").alias(k) for k, v in parts.items()])


def entries_from_conversations(conversations: DataFrame) -> DataFrame:
    """A conversation is a session, a turn a message of one text block; rows of user role are typed by the user."""
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "model").otherwise("system-prompt")
    null = F.lit(None)
    return conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.col("turn").alias("seq"),
        F.concat_ws(":", "conv_id", "turn").alias("message_id"), "role", kind.alias("source_kind"), null.cast("string").alias("source_form"),
        null.cast("long").alias("time_ms"), null.cast("long").alias("tokens"), null.cast("string").alias("finish"),
        null.cast("string").alias("tool_call_id"), null.cast("string").alias("tool_name"), null.cast("string").alias("tool_arguments"),
        F.lit(False).alias("is_error"), null.cast(USAGE).alias("usage"), F.array(block("text", F.coalesce("text", F.lit("")))).alias("blocks"),
    )


TOOLS = ("read_file", "write-file", "Bash", "grep")


def entries_from_events(events: DataFrame) -> DataFrame:
    """Our own reading of the ``events`` table as a log of tool use; the table itself has none.

    A user is a session ordered by (ts, event_id). ``view`` is an assistant message that
    calls a tool, ``click`` a result, ``error`` a failed result, ``purchase`` an assistant
    answer with a usage report, ``signup`` a typed request (those whose ``k`` is a
    multiple of 25 are system messages, 1 more than one: checkpoints). ``k % 4`` is the
    call id and the tool, ``k % 20`` the file, and 100 times ``value`` the characters.
    """
    from pyspark.sql import Window as W

    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    call = F.concat(F.lit("c"), (k % 4).cast("string"))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (k % 4 + 1).cast("int"))
    args = F.concat(F.lit('{"path": "src/f'), (k % 20).cast("string"), F.lit('.py"}'))
    chars = F.floor(F.col("value") * 100).cast("long")
    user = kind == "signup"
    role = F.when(user & (k % 25 == 0), "system").when(user, "user").when(kind.isin("view", "purchase"), "assistant").otherwise("tool")
    source = F.when(user & (k % 25 == 0), "system-prompt").when(user & (k % 25 == 1), "compact-checkpoint").when(user, "user").when(kind.isin("view", "purchase"), "model").otherwise("tool")
    body = F.concat(kind, F.lit(" "), k.cast("string"))
    null = F.lit(None)
    total = F.when(kind == "purchase", chars)
    usage = F.when(kind == "purchase", F.struct(F.floor(chars / 2).cast("long").alias("input"), F.floor(chars / 4).cast("long").alias("output"), F.lit(10).cast("long").alias("cache_read"), null.cast("long").alias("cache_write"), F.when(k % 3 > 0, total).when(k % 2 == 0, F.lit(0).cast("long")).alias("total")))
    called = F.when(kind == "view", F.array(block("tool-call", id=call, name=name, arguments=args))).otherwise(F.array(block("text", body)))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_id").alias("seq"),
        F.concat(F.lit("m"), (k % 50).cast("string")).alias("message_id"), role.alias("role"), source.alias("source_kind"),
        F.when(source == "user", F.when(k % 7 == 0, "snapshot").when(k % 7 == 1, "instructions")).alias("source_form"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"), F.floor((chars + 3) / 4).cast("long").alias("tokens"),
        F.when(kind == "purchase", F.when(k % 10 == 0, "error").when(k % 10 == 1, "aborted").otherwise("stop")).alias("finish"),
        F.when(kind.isin("click", "error"), call).alias("tool_call_id"), null.cast("string").alias("tool_name"), null.cast("string").alias("tool_arguments"),
        (kind == "error").alias("is_error"), usage.cast(USAGE).alias("usage"), called.alias("blocks"), chars.alias("chars"), k.alias("k"),
    )


def operations_from_events(entries: DataFrame) -> DataFrame:
    """Replace operations in our reading of ``events``, with a row's place as its number: session_id, seq, start_seq, end_seq, time_ms.

    A checkpoint takes the place of all that is visible before it, a failed result whose
    ``k`` ends in 3 that of the row before it, unless that is the first row or a checkpoint.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("session_id").orderBy("pos")
    point = F.col("source_kind") == "compact-checkpoint"
    earlier = F.coalesce(F.max(F.when(point, F.col("pos"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = F.when(point & (F.col("pos") > 0), earlier).when(F.col("is_error") & (F.col("k") % 10 == 3) & (F.col("pos") > 1) & ~F.lag(point).over(order), F.col("pos") - 1)
    rows = entries.select("session_id", F.col("pos").alias("seq"), start.alias("start_seq"), (F.col("pos") - 1).alias("end_seq"), "time_ms")
    return rows.where("start_seq is not null")


def files_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")


def text_of(separator: str = "\n", kinds: tuple[str, ...] = ("text",), blocks: str = "blocks", keep_slots: bool = False) -> Column:
    """The texts of a message's blocks of some kinds, joined; with ``keep_slots`` other blocks leave an empty part."""
    if keep_slots:
        return F.array_join(F.transform(blocks, lambda b: F.when(b["type"].isin(*kinds), F.coalesce(b["text"], F.lit(""))).otherwise("")), separator)
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin(*kinds)), lambda b: b["text"]), separator)


def calls_of(entries: DataFrame) -> DataFrame:
    """One row for each tool call: session_id, pos, seq, message_id, call_id, name, arguments."""
    calls = entries.select("session_id", "pos", "seq", "message_id", F.explode(F.filter("blocks", lambda b: b["type"] == "tool-call")).alias("b"))
    return calls.select("session_id", "pos", "seq", "message_id", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"), F.col("b.arguments").alias("arguments"))


def results_of(entries: DataFrame) -> DataFrame:
    """One row for each tool result: session_id, pos, seq, call_id, is_error."""
    return entries.where("role = 'tool' and tool_call_id is not null").select("session_id", "pos", "seq", F.col("tool_call_id").alias("call_id"), "is_error")


# --- scans


def snapshot(log: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """The visible messages with tool identity filled in; without ``surface`` the whole archive.

    ``surface`` (session_id, pos, seq) gives the visible order; a number that the log
    does not have is an error. The last call of an id in the log names its results.
    """
    calls = calls_of(log).groupBy("session_id", "call_id").agg(F.max_by(F.struct("name", "arguments"), "pos").alias("call"))
    rows = log
    if surface is not None:
        rows = surface.join(log.drop("pos").withColumn("_there", F.lit(True)), ["session_id", "seq"], "left")
        missing = F.assert_true(F.col("_there").isNotNull(), F.lit("a surface row is missing from the log"))
        rows = rows.where(missing.isNull()).drop("_there")
    rows = rows.join(calls.withColumnRenamed("call_id", "tool_call_id"), ["session_id", "tool_call_id"], "left")
    return rows.withColumns({"tool_name": F.coalesce("tool_name", "call.name"), "tool_arguments": F.coalesce("tool_arguments", "call.arguments")}).drop("call")


def records(state: DataFrame, plugin: str, kind: str) -> DataFrame:
    return state.where((F.col("plugin") == plugin) & (F.col("kind") == kind))


def latest(state: DataFrame, plugin: str, kind: str) -> DataFrame:
    """The last record of each session."""
    return records(state, plugin, kind).groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("data"))


def read_files(wanted: DataFrame, files: DataFrame, max_chars: int | Column) -> tuple[DataFrame, DataFrame]:
    """(``wanted`` with ``content``, bounded to ``max_chars``; the paths that were missing)."""
    n = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    found = wanted.join(files.select("path", F.col("text").alias("content"), F.lit(True).alias("found")), "path", "left")
    out = found.withColumn("content", F.when(n > 0, F.substring("content", F.lit(1), n.cast("int"))).otherwise(F.lit("")))
    return out.drop("found"), found.where("found is null").select(*wanted.columns)


def with_recovery(sessions: DataFrame, recovery: DataFrame) -> DataFrame:
    """External observations of each session, null where none was made."""
    return sessions.join(recovery, "session_id", "left")


# --- writers


def record(df: DataFrame, plugin: str, kind: str, data: list[str]) -> DataFrame:
    """State rows to append: null fields are left out of the JSON."""
    return df.select("session_id", "seq", F.lit(plugin).alias("plugin"), F.lit(kind).alias("kind"), F.to_json(F.struct(*data)).alias("data"))


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("plugin", "kind").parquet(path)


def replace(entries: DataFrame, replacements: DataFrame) -> DataFrame:
    """Entries with the content of ``replacements`` (session_id, seq, blocks) put in place.

    Two replacements of one message, or one of a message that is neither the user's nor
    a tool's, are errors.
    """
    once = replacements.groupBy("session_id", "seq").agg(F.count("*").alias("_n"), F.first("blocks").alias("_new"))
    rows = entries.join(once, ["session_id", "seq"], "left")
    good = F.col("_n").isNull() | ((F.col("_n") == 1) & F.col("role").isin("user", "tool"))
    rows = rows.where(F.assert_true(good, F.lit("a replacement is repeated or not of a user or tool message")).isNull())
    return rows.withColumn("blocks", F.coalesce("_new", "blocks")).select(*entries.columns)


def compact(entries: DataFrame, selected: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Put one checkpoint message in the place of each session's selected range.

    ``selected``: session_id, pos; ``checkpoints``: session_id, seq, blocks. Sessions
    without a checkpoint stay as they are. Write the result as one new table version:
    readers see the old or the new history, never a part.
    """
    done = selected.join(checkpoints.select("session_id"), "session_id", "left_semi")
    kept = entries.join(done.select("session_id", "pos"), ["session_id", "pos"], "left_anti")
    first = done.groupBy("session_id").agg(F.min("pos").alias("pos"))
    new = checkpoints.join(first, "session_id").select("session_id", "pos", "seq", "blocks")
    new = new.withColumns({"role": F.lit("user"), "source_kind": F.lit("compact-checkpoint"), "is_error": F.lit(False), "message_id": F.concat(F.lit("checkpoint:"), F.col("seq"))})
    return kept.unionByName(new, allowMissingColumns=True).select(*entries.columns)


def summarize(requests: DataFrame, model: Callable[[str], str], max_chars: int) -> DataFrame:
    """``requests`` (session_id, prompt) with ``summary`` and ``error``: the pluggable model call.

    A failing call becomes an error row, not a failed job; blank answers are errors, as
    are those of more than ``max_chars`` characters, which are never cut.
    """

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for prompt in part["prompt"]:
                try:
                    text = model(prompt)
                    out.append((None, "empty summary") if not text.strip() else (None, "truncated") if len(text) > max_chars else (text, None))
                except Exception as e:  # noqa: BLE001  whatever the model raises is data here
                    out.append((None, str(e)))
            yield part[["session_id"]].assign(summary=[a for a, _ in out], error=[b for _, b in out])

    return requests.select("session_id", "prompt").mapInPandas(call, "session_id long, summary string, error string")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A Markdown table. A report is small by nature: more than ``limit`` rows are an error, never cut."""
    from ..functions.text import markdown_cell

    shown = rows.select(*[markdown_cell(F.col(c).cast("string")).alias(c) for c in rows.columns]).limit(limit + 1).collect()
    if len(shown) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *[line(["" if v is None else v for v in r]) for r in shown]])
