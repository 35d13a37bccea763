"""Projections of message blocks for a summary request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.logs import text_of
from .text import clip


def _with_text(b: Column, text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name", "arguments", "media_type")])


def media_as_text(blocks: Column | str = "blocks") -> Column:
    """Images and files become text placeholders."""
    image = lambda b: F.concat(F.lit("[Attached "), F.coalesce(b["media_type"], F.lit("unknown")), F.lit(": image]"))
    return F.transform(blocks, lambda b: F.when(b["type"] == "image", _with_text(b, image(b))).when(b["type"] == "file", _with_text(b, F.lit("[Attached file]"))).otherwise(b))


# Sources that only list what is at hand, and the characters a text keeps after a request was too large.
LISTINGS = "skill-list|catalog|discovery"
LARGE_TEXT = 8_000


def asked_about(source_kind: Column) -> Column:
    """Whether a message belongs in a summary request: listings of skills and tools don't."""
    return ~F.coalesce(source_kind.rlike(LISTINGS), F.lit(False))


def summary_input(role: Column, max_chars: int | None, blocks: Column | str = "blocks", image_note: str = "[Image left out of the request]", clip_note: str = "\n[Output shortened for the request]", too_large: bool = False) -> Column:
    """Without reasoning; images as a note; tool text cut at ``max_chars`` (0: not).

    After a request that was ``too_large`` every text is cut, at 8,000 unless ``max_chars`` says otherwise.
    """
    max_chars = (LARGE_TEXT if too_large else 0) if max_chars is None else max_chars
    kept = F.filter(blocks, lambda b: b["type"] != "reasoning")
    cut = lambda b: ((role == "tool") | F.lit(too_large)) & (b["type"] == "text") & F.lit(max_chars > 0) & (F.length(b["text"]) > max_chars)
    return F.transform(kept, lambda b: F.when(b["type"] == "image", _with_text(b, F.lit(image_note))).when(cut(b), _with_text(b, F.concat(F.substring(b["text"], 1, max_chars), F.lit(clip_note)))).otherwise(b))


def shared_budget(role: Column, max_chars: int, blocks: Column | str = "blocks", note: str = "\n[Output left out of the request]") -> Column:
    """Tool text of a message under one budget of code points, used up block by block."""
    start = F.struct(F.lit(max_chars).alias("left"), F.filter(blocks, lambda b: F.lit(False)).alias("out"))

    def step(a: Column, b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        taken = F.substring(text, F.lit(1), a["left"])
        own = F.when(b["type"] == "text", _with_text(b, F.concat(taken, F.when(F.length(taken) < F.length(text), note).otherwise("")))).otherwise(b)
        left = F.when(b["type"] == "text", F.greatest(F.lit(0), a["left"] - F.length(text))).otherwise(a["left"])
        return F.struct(left.cast("int").alias("left"), F.concat(a["out"], F.array(own)).alias("out"))

    limited = (role == "tool") & F.lit(max_chars > 0)
    return F.when(limited, F.aggregate(blocks, start, step)["out"]).otherwise(F.col(blocks) if isinstance(blocks, str) else blocks)


#: How each transcript style names things: result and error labels, call and reasoning labels, clip note.
STYLES = {
    "more": ("[Tool result]: ", "[Tool result]: ", "[Assistant tool calls]: ", "[Assistant thinking]: ", "\n\n[... {} more characters truncated]"),
    "marked": ("[Tool result]: ", "[Tool error]: ", "[Assistant tool call]: ", "[Assistant reasoning]: ", "\n[truncated]"),
}


def message_text(style: str, limit: int) -> Column:
    """One message of a transcript with role prefixes."""
    result, error, call, thought, note = STYLES[style]
    role = F.col("role")
    output = clip(text_of("\n", keep_slots=style == "marked"), limit, note)
    who = F.when(role == "user", "[User]: ").otherwise("[Assistant]: ")
    part = lambda b: F.when(b["type"] == "tool-call", F.concat(F.lit(call), b["name"], F.lit("("), b["arguments"], F.lit(")"))).when(b["type"] == "reasoning", F.concat(F.lit(thought), b["text"])).when(b["type"] == "text", F.concat(who, b["text"]))
    blocks = media_as_text() if style == "marked" else F.col("blocks")
    spoken = F.array_join(F.filter(F.transform(blocks, part), lambda x: x.isNotNull()), "\n")
    return F.when(role == "tool", F.concat(F.when(F.col("is_error"), error).otherwise(result), output)).otherwise(spoken)


def named_message_text(limit: int) -> Column:
    """The style that names the tool in its results and every role in brackets."""
    role = F.when(F.col("role") == "tool", F.concat(F.lit("Tool result ("), F.coalesce("tool_name", "tool_call_id"), F.lit(")"))).otherwise(F.col("role"))
    text = lambda b: F.when(F.col("role") == "tool", clip(b["text"], limit, "\n[{} characters omitted]")).otherwise(b["text"])
    part = lambda b: F.when(b["type"] == "text", F.concat(F.lit("["), role, F.lit("] "), text(b))).when(b["type"] == "reasoning", "").when(b["type"] == "tool-call", F.concat(F.lit("[Tool call] "), b["name"], F.lit("("), b["arguments"], F.lit(")"))).otherwise(F.concat(F.lit("["), role, F.lit(" "), b["type"], F.lit("] "), F.substring(F.to_json(b), 1, 2000)))
    return F.array_join(F.transform("blocks", part), "\n")


def transcript(entries: DataFrame, text: Column, separator: str = "\n\n") -> DataFrame:
    """Per session the messages without checkpoints, in order, as one text. A session's
    visible messages are bounded by its model's window, so one row holds them."""
    rows = entries.where("source_kind is null or source_kind <> 'compact-checkpoint'").select("session_id", "pos", text.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy("session_id").agg(F.array_join(lines, separator).alias("transcript"))
