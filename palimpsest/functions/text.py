"""String functions whose length is counted in UTF-16 units, code points or UTF-8 bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def u16len(c: Column) -> Column:
    """Length in UTF-16 units: two for each character beyond the basic plane."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def ceil_div(n: Column, k: int) -> Column:
    return F.floor((n + (k - 1)) / k).cast("long")


def clip(c: Column, n: int, note: str) -> Column:
    """The first ``n`` characters and a note with ``{}`` for the number left out; 0 is no limit."""
    head, _, tail = note.partition("{}")
    out = F.concat(F.substring(c, 1, n), F.lit(head), (F.length(c) - n).cast("string"), F.lit(tail)) if "{}" in note else F.concat(F.substring(c, 1, n), F.lit(note))
    return F.when((F.lit(n) > 0) & (F.length(c) > n), out).otherwise(c)


def normal_name(c: Column, last_segment: bool = False, only_letters: bool = False) -> Column:
    """Tool name in lower case without ``-`` and ``_`` (``only_letters``: without anything but a-z and 0-9)."""
    if last_segment:
        c = F.element_at(F.split(c, "[./]"), -1)
    return F.regexp_replace(F.lower(c), "[^a-z0-9]" if only_letters else "[-_]", "")


def session_path(c: Column) -> Column:
    """A session id made safe for a file name."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def markdown_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\\r?\\n", "<br>")


def _continues(raw: Column, at: Column) -> Column:
    """Whether the byte at this place (from 1) goes on with a character that began before it."""
    return F.hex(F.substring(raw, at, F.lit(1))).between("80", "BF")


def middle_truncate(text: Column, tokens: Column) -> Column:
    """Both ends of a text within ``tokens`` of four UTF-8 bytes, cut between characters, and how many tokens went."""
    raw, n = text.cast("binary"), F.octet_length(text)
    room = (F.greatest(F.lit(0), F.floor(tokens)) * 4).cast("int")
    front = F.floor(room / 2).cast("int")
    back = n - (room - front) + 1
    # A character has at most four bytes, so its edge is at most three away.
    last = F.when(~_continues(raw, front + 1), front).when(~_continues(raw, front), front - 1).when(~_continues(raw, front - 1), front - 2).otherwise(front - 3)
    first = F.when(~_continues(raw, back), back).when(~_continues(raw, back + 1), back + 1).when(~_continues(raw, back + 2), back + 2).otherwise(back + 3)
    gone = ceil_div(n - room, 4).cast("string")
    ends = F.concat(F.substring(raw, F.lit(1), last).cast("string"), F.lit("…"), gone, F.lit(" tokens truncated…"), F.substring(raw, first, n).cast("string"))
    return F.when(n <= room, text).otherwise(ends)


def clip_weighted(text: str, budget: float, from_end: bool = False) -> str:
    """The longest start (or end) whose price is within ``budget``: a token for four ASCII characters or one other."""
    most = int(max(0, min(4 * budget, len(text))))  # no more characters than that can fit
    part = text[max(0, len(text) - most) :] if from_end else text[:most]
    wide = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4") >= 128
    other = np.cumsum(wide[::-1] if from_end else wide)
    price = (np.arange(1, len(part) + 1) - other + 3) // 4 + other
    n = int(np.searchsorted(price, budget, "right"))
    return part[len(part) - n :] if from_end else part[:n]


def _clips(text: pd.Series, budget: pd.Series, from_end: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or pd.isna(b) else clip_weighted(t, b, e) for t, b, e in zip(text, budget, from_end, strict=True)], dtype=object)


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object that stands in prose, as compact JSON; null without one."""
    decoder, at = json.JSONDecoder(), 0
    while text and (at := text.find("{", at)) >= 0:
        try:
            found, _ = decoder.raw_decode(text, at)
            return json.dumps(found, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            at += 1
    return None


def _objects(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([first_object(t) for t in part], dtype=object)


def weighted_clip(text: Column, budget: Column, from_end: Column) -> Column:
    """``clip_weighted`` of each row; null where the text or the budget is."""
    return F.pandas_udf(_clips, T.StringType())(text, budget, from_end)


def json_object(text: Column) -> Column:
    return F.pandas_udf(_objects, T.StringType())(text)


def collect_paths(arguments: Column) -> Column:
    return F.pandas_udf(_paths, T.ArrayType(T.StringType()))(arguments)


def _pretty(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False))


def pretty_json(value: Column) -> Column:
    """Valid JSON with an item a line, indented by two."""
    return F.pandas_udf(_pretty, T.StringType())(value)


# --- paths


def path_from_json(arguments: Column, keys: tuple[str, ...] = ("file_path", "path", "filePath"), skip_empty: bool = True) -> Column:
    """The first of ``keys`` that holds a non-empty string, or any string unless ``skip_empty``; null for anything else, bad JSON too."""
    v = F.try_parse_json(arguments)
    out = []
    for k in keys:
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING"
        value = F.try_variant_get(v, f"$.{k}", "string")
        out.append(F.when(is_text, F.nullif(value, F.lit("")) if skip_empty else value))
    return F.coalesce(*out)


def patch_paths(patch: Column) -> Column:
    return F.regexp_extract_all(patch, F.lit("(?m)^\\*\\*\\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1))


def tagged_paths(text: Column, tag: str) -> Column:
    """Paths listed in ``<tag>`` elements, one a line."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>\\n(.*?)\\n</{tag}>"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, lambda x: F.split(x, "\n"))), lambda p: p != ""))


PATH_KEYS = ("path", "file_path", "target_file", "new_file_path", "old_file_path", "file_paths", "files")


def nested_paths(value: object) -> list[str]:
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [p for v in value for p in nested_paths(v)]
    return [p for k in PATH_KEYS for p in nested_paths(value.get(k))] if isinstance(value, dict) else []


def _paths(arguments: pd.Series) -> pd.Series:
    """Paths under the known keys at any depth of the JSON; none for bad JSON."""

    def own(a: str | None) -> list[str]:
        try:
            value = json.loads(a or "")
        except ValueError:
            return []
        return nested_paths(value) if isinstance(value, dict) else []

    return pd.Series([own(a) for a in arguments], dtype=object)


def file_tags(read: Column, modified: Column) -> Column:
    part = lambda tag, paths: F.when(F.size(paths) > 0, F.concat(F.lit(f"\n\n<{tag}>\n"), F.array_join(paths, "\n"), F.lit(f"\n</{tag}>"))).otherwise("")
    return F.concat(part("read-files", F.array_sort(F.array_except(read, modified))), part("modified-files", F.array_sort(F.array_distinct(modified))))


def files_section(read: Column, edited: Column) -> Column:
    part = lambda p: F.when(F.size(p) > 0, F.array_join(F.transform(p, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- none")
    return F.concat(F.lit("## Files\nRead:\n"), part(read), F.lit("\nEdited:\n"), part(edited))


# --- summaries and errors


def stripped_summary(text: Column, strict: bool = True) -> Column:
    """The text without ``<analysis>``, inside ``<summary>`` if there is one; ``strict``: null where a tag is left open."""
    clean = F.trim(F.regexp_replace(text, "(?is)<analysis>.*?</analysis>", ""))
    inner = F.trim(F.regexp_extract(clean, "(?is)<summary>(.*?)</summary>", 1))
    closed = clean.rlike("(?is)<summary>.*?</summary>")
    if not strict:
        return F.when(closed, inner).otherwise(clean)
    return F.when(clean.rlike("(?i)<analysis>"), None).when(closed, inner).when(clean.contains("<summary>"), None).otherwise(clean)


def state_snapshot(text: Column) -> Column:
    """The content of a complete, non-blank ``<state_snapshot>``; else null."""
    return F.nullif(F.trim(F.regexp_extract(text, "(?s)<state_snapshot>(.*?)</state_snapshot>", 1)), F.lit(""))


def token_gap(message: Column, commas: bool = False) -> Column:
    """By how much the first number of ``N tokens > M`` is larger (``commas``: digits may be grouped, the gap must be positive)."""
    digits = "[\\d,]+" if commas else "\\d+"
    number = lambda i: F.regexp_replace(F.regexp_extract(message, f"(?i)({digits})\\s*tokens?\\s*>\\s*({digits})", i), ",", "").cast("long")
    found = message.rlike(f"(?i){digits}\\s*tokens?\\s*>\\s*{digits}")
    gap = number(1) - number(2)
    return F.when(found, F.when(gap > 0, gap) if commas else F.greatest(gap, F.lit(0)))


def response_fault(finish: Column, kinds: Column, text: Column) -> Column:
    """Why a summary answer can't be used; null if it can."""
    media = F.exists(kinds, lambda k: ~k.isin("text", "reasoning"))
    return F.when(finish.isin("max-tokens", "length"), "truncated").when(finish.isin("error", "aborted"), finish).when(media, "not text").when(~F.coalesce(text, F.lit("")).rlike("(?U)\\S"), "empty")
