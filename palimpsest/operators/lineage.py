"""What a history did to files, and the newest of what it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clip, collect_paths, normal_name, patch_paths, path_from_json, tagged_paths
from ..sources.logs import calls_of
from .lookups import failed_calls

READS, WRITES = ("read", "readfile"), ("write", "writefile", "edit", "editfile")


def touched(entries: DataFrame) -> DataFrame:
    """Distinct (session_id, path, action) of read and write calls with a path; first_pos is the first time."""
    rows = calls_of(entries).withColumns({"tool": normal_name(F.col("name"), last_segment=True), "path": path_from_json(F.col("arguments"), ("path",))})
    action = F.when(F.col("tool").isin(*READS), "read").when(F.col("tool").isin(*WRITES), "modified")
    return rows.withColumn("action", action).where("action is not null and path is not null").groupBy("session_id", "path", "action").agg(F.min("pos").alias("first_pos"))


def tagged(texts: DataFrame) -> DataFrame:
    """(session_id, path, action) from file tags in ``text``."""
    part = lambda tag, action: texts.select("session_id", F.explode(tagged_paths(F.col("text"), tag)).alias("path"), F.lit(action).alias("action"))
    return part("read-files", "read").unionByName(part("modified-files", "modified")).distinct()


def lineage(*parts: DataFrame) -> DataFrame:
    """The union of several sources of (session_id, path, action), without repeats."""
    out = parts[0].select("session_id", "path", "action")
    for p in parts[1:]:
        out = out.unionByName(p.select("session_id", "path", "action"))
    return out.distinct()


def only_read(files: DataFrame) -> DataFrame:
    """Per session the paths read and never modified."""
    read = files.where("action = 'read'").select("session_id", "path")
    return read.distinct().join(files.where("action = 'modified'").select("session_id", "path"), ["session_id", "path"], "left_anti")


def activity(entries: DataFrame) -> DataFrame:
    """(session_id, kind, item, first_pos): read, edited, command; items of failed calls say so."""
    rows = failed_calls(entries).withColumns({"tool": normal_name(F.col("name")), "paths": collect_paths(F.col("arguments"))})
    patch = F.coalesce(F.get_json_object("arguments", "$.patch"), F.get_json_object("arguments", "$.patchText"), F.lit(""))
    kinds = {
        "read": (("read", "readfile", "readfiles"), F.col("paths")),
        "edited": (("editor", "edit", "editfile", "write", "writefile", "applypatch"), F.concat("paths", patch_paths(patch))),
        "command": (("runcommands", "executecommand", "execcommand", "bash", "shell"), F.array(clip(F.trim(F.coalesce(F.get_json_object("arguments", "$.command"), F.get_json_object("arguments", "$.cmd"), F.lit(""))), 100, "\n[{} characters omitted]"))),
    }
    # A tool is of one kind, so one pass over the calls gives all three.
    kind, items = F.lit(None), F.lit(None)
    for name, (tools, own) in kinds.items():
        mine = F.col("tool").isin(*tools)
        kind, items = F.when(mine, name).otherwise(kind), F.when(mine, own).otherwise(items)
    rows = rows.select("session_id", "pos", kind.alias("kind"), F.explode(F.filter(items, lambda x: x != "")).alias("item"), F.when(F.col("failed"), " (failed)").otherwise("").alias("s"))
    return rows.groupBy("session_id", "kind", F.concat("item", "s").alias("item")).agg(F.min("pos").alias("first_pos"))


def latest_by_key(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def top_recent(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The ``k`` most recent keys of each session; equal times keep the order of their first rows."""
    last = rows.groupBy("session_id", key).agg(F.max(order).alias(order), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc(order), "first_pos"))
    return last.withColumn("rank", rank).where(F.col("rank") <= k)


def newest_sources(rows: DataFrame, visible: DataFrame) -> DataFrame:
    """The newest row of each state key, unless that very source is visible; an older one never takes its place.

    ``rows``: session_id, pos, state_key, source; ``visible``: session_id, source.
    """
    newest = rows.withColumn("_nth", F.row_number().over(W.partitionBy("session_id", "state_key").orderBy(F.desc("pos")))).where("_nth = 1").drop("_nth")
    return newest.join(visible.select("session_id", "source").distinct(), ["session_id", "source"], "left_anti")


def distinct_newest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key of a session, the newest."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy("session_id", key).orderBy(F.desc("pos")))).where("_nth = 1").drop("_nth")


def prior_summary(checkpoints: DataFrame, saved: DataFrame) -> DataFrame:
    """Per session the distinct checkpoint texts in order, else the saved summary.

    ``checkpoints``: session_id, pos, text; ``saved``: session_id, summary.
    """
    texts = checkpoints.where("text <> ''").groupBy("session_id", "text").agg(F.min("pos").alias("pos"))
    joined = texts.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("committed"))
    return joined.join(saved, "session_id", "full").select("session_id", F.coalesce("committed", "summary", F.lit("")).alias("prior"))


def restored_files(wanted: DataFrame, files: DataFrame, most: int, file_tokens: int) -> DataFrame:
    """The first ``most`` wanted files (session_id, path, rank) that can be read, cut to ``file_tokens``; unreadable ones take no place."""
    found = wanted.join(files.select("path", F.col("text").alias("content")), "path").withColumn("nth", F.row_number().over(W.partitionBy("session_id").orderBy("rank")))
    return found.where(F.col("nth") <= most).select("session_id", "path", "rank", "nth", F.substring("content", 1, file_tokens * 4).alias("content"))


def last_images(images: Column, budget: int, each: int = 1600, most: int = 3) -> Column:
    """The last images that the budget allows, three at most."""
    k = min(most, budget // each)
    return F.slice(images, F.greatest(F.size(images) - k + 1, F.lit(1)), F.lit(max(k, 0)))


def latest_todos(entries: DataFrame) -> DataFrame:
    """Per session the list of the newest todo call that succeeded and holds a list."""
    from .lookups import succeeded_calls

    calls = succeeded_calls(entries).where(F.lower("name").rlike("^todo_?write$"))
    todos = F.get_json_object("arguments", "$.todos")
    return calls.withColumn("todos", todos).where(F.startswith("todos", F.lit("["))).groupBy("session_id").agg(F.max_by("todos", "pos").alias("todos"))
