"""Token prices of messages. The level at which a price is rounded is part of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ceil_div, u16len

_TEXT = ("text", "reasoning")


def _json_text(b: Column) -> Column:
    return F.to_json(b)


def _sum(blocks: Column, of) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(of(b), F.lit(0)).cast("long"))


def _len(c: Column) -> Column:
    return u16len(F.coalesce(c, F.lit("")))


def chars4(blocks: Column, image_chars: int = 4800, others: bool = False) -> Column:
    """A quarter of all characters, rounded up once; images at a flat rate, other blocks free or (``others``) by their JSON."""
    call = lambda b: _len(b["name"]) + _len(b["arguments"])
    other = lambda b: u16len(_json_text(b)) if others else F.lit(0)
    return ceil_div(_sum(blocks, lambda b: F.when(b["type"].isin(*_TEXT), _len(b["text"])).when(b["type"] == "tool-call", call(b)).when((b["type"] == "image") & F.lit(not others), F.lit(image_chars)).otherwise(other(b))), 4)


def block4(blocks: Column, image: int = 2000) -> Column:
    """A quarter of each block's characters, rounded up for each; images at a flat rate of tokens."""
    return _sum(blocks, lambda b: F.when(b["type"] == "image", F.lit(image)).when(b["type"].isin(*_TEXT), ceil_div(_len(b["text"]), 4)).otherwise(ceil_div(u16len(_json_text(b)), 4)))


def bytes4(blocks: Column, role: Column, tool: Column, image_bytes: int = 7373) -> Column:
    """A quarter of the UTF-8 bytes, rounded up once; reasoning is free, results also pay their id and name (``tool``).

    Images have a flat rate. A file, and an image that was moved out of the log (``name`` is
    ``offloaded``), costs the JSON of its attachment only, which stands in ``arguments``.
    """
    size = lambda c: F.octet_length(F.coalesce(c, F.lit(""))).cast("long")
    body = _sum(blocks, lambda b: F.when(b["type"] == "text", size(b["text"])).when(b["type"] == "tool-call", size(b["name"]) + size(b["arguments"])).when((b["type"] == "file") | ((b["type"] == "image") & (b["name"] == "offloaded")), size(b["arguments"])).when(b["type"] == "image", F.lit(image_bytes)).otherwise(F.lit(0)))
    return ceil_div(body + F.when(role == "tool", size(tool)).otherwise(F.lit(0)), 4)


def slice_json4(total_json: Column, messages: Column) -> Column:
    """Price of a run of messages as one JSON array: lengths, commas and brackets, a quarter of it rounded half up."""
    return F.floor((total_json + F.greatest(messages - 1, F.lit(0)) + 2 + 2) / 4).cast("long")


def weighted(text: Column) -> Column:
    """A token for four ASCII characters (rounded up), one for every other."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, "[\\x00-\\x7F]", ""))
    return (ceil_div(F.length(t) - other, 4) + other).cast("long")


def weighted_message(blocks: Column, role: Column, image: int = 2000) -> Column:
    return weighted(role) + _sum(blocks, lambda b: F.when(b["type"].isin(*_TEXT), weighted(b["text"])).when(b["type"] == "tool-call", weighted(b["name"]) + weighted(b["arguments"])).when(b["type"] == "image", F.lit(image)).otherwise(weighted(_json_text(b))))


def json3(message_json: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), ceil_div(u16len(message_json), 3))


def cjk(text: Column) -> Column:
    """One and a half for each CJK character, a quarter for every other, rounded up once."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t) - F.length(F.regexp_replace(t, "[\\u3400-\\u9fff\\uf900-\\ufaff]", ""))
    return ceil_div(n * 6 + (u16len(t) - n), 4)


def usage_total(usage: Column, zero_is_absent: bool) -> Column:
    """The stated total, else the sum of the parts."""
    zero = F.lit(0).cast("long")
    parts = usage["input"] + usage["output"] + F.coalesce(usage["cache_read"], zero) + F.coalesce(usage["cache_write"], zero)
    return F.coalesce(F.nullif(usage["total"], zero) if zero_is_absent else usage["total"], parts)


def metered(measured: Column, estimate: Column) -> Column:
    return F.coalesce(measured, estimate)
