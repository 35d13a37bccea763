"""URL rules and exact listed-key filtering by a Bloom filter cascade.

The first filter of a cascade holds the listed keys of the corpus. Keys outside
the list that pass it by accident go into the second; listed keys that pass the
second go into the third, and so on until nothing passes by accident. As the
levels are built over the complete key universe of the corpus, the first level
that turns a key away decides it exactly: an odd level says "not listed", an even
one "listed". Rows are judged by expressions on their own key: no join.

Everything here is DataFrame expressions; only filter bytes, whose number is
checked against a bound, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if null or without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; nulls if none does.

    Equally long rules that both fit are tried in code-point order of their text.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _masks() -> Column:
    return F.array(*[F.lit(1 << i) for i in range(8)])


@dataclass(frozen=True)
class _Level:
    bits: int
    probes: int
    seed: int
    data: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits)) for i in range(self.probes)]

    def passes(self, key: Column) -> Column:
        data, masks, out = F.lit(self.data), _masks(), F.lit(True)
        for pos in self.positions(key):
            byte = F.conv(F.hex(F.substring(data, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (byte.bitwiseAND(F.element_at(masks, (pos % 8 + 1).cast("int"))) > 0)
        return out


_CHUNK = 1 << 15


class LevelTooLarge(ValueError):
    """A level of a cascade is beyond its bound."""


def _chunks(pos: DataFrame) -> DataFrame:
    """chunk, data: the bytes of a bit field in pieces of 32 KB, from the positions of its set bits."""
    # Words of 64 bits whose hexadecimal digits are the field's bytes in order, the lowest bit of a byte first.
    bit = F.lit(56) - 8 * F.floor(F.col("pos") % 64 / 8) + F.col("pos") % 8
    words = pos.groupBy(F.floor(F.col("pos") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))).alias("bits"))
    per = _CHUNK // 8
    own = words.groupBy(F.floor(F.col("word") / per).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % per).cast("int").alias("at"), "bits"))).alias("words"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("words", i), F.lit(0).cast("long"))), 16, "0"))
    return own.select("chunk", F.unhex(F.array_join(digits, "")).alias("data"))


def _build_level(keys: DataFrame, n: int, fpp: float, seed: int, max_bytes: int) -> _Level:
    probes = max(1, round(-math.log2(fpp)))
    size = max(8, math.ceil(n * probes / math.log(2) / 8))
    if size > max_bytes:
        raise LevelTooLarge(f"a level of the cascade needs {size} bytes; the bound is {max_bytes}. Use listed_by_join")
    level = _Level(size * 8, probes, seed, b"")
    pos = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("pos"))
    data = bytearray(size)
    for r in _chunks(pos).collect():  # a row for each 32 KB of at most `max_bytes`
        own = bytes(r["data"])[: size - r["chunk"] * _CHUNK]
        data[r["chunk"] * _CHUNK : r["chunk"] * _CHUNK + len(own)] = own
    return _Level(level.bits, probes, seed, bytes(data))


class BloomCascade:
    """Exact membership of a key in a list, for every key of a universe."""

    def __init__(self, levels: list[_Level], last_listed: bool):
        self.levels, self.last_listed = levels, last_listed

    @property
    def size_bytes(self) -> int:
        return sum(len(x.data) for x in self.levels)

    @classmethod
    def build(cls, universe: DataFrame, max_bytes: int = 16 << 20) -> BloomCascade:
        """``universe``: distinct ``key`` with the boolean ``listed``, every key of the corpus.

        Null keys are never listed. ``max_bytes`` bounds each level, and so what is
        sent to every task. An empty list gives a cascade without levels.
        """
        left = universe.where("key is not null")
        counts = {r["listed"]: r["n"] for r in left.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        inside, outside = counts.get(True, 0), counts.get(False, 0)
        levels: list[_Level] = []
        own = True  # whether the level to come holds listed keys
        while inside and outside:
            first = min(0.5, inside / (outside * math.sqrt(2))) if not levels else 0.5
            n = inside if own else outside
            level = _build_level(left.where(F.col("listed") == own), n, max(first, 1e-6), len(levels) + 1, max_bytes)
            levels.append(level)
            left = left.where((F.col("listed") == own) | level.passes(F.col("key")))
            passed = left.where(F.col("listed") != own).count()
            inside, outside = (inside, passed) if own else (passed, outside)
            own = not own
            if len(levels) % 4 == 0:
                left = materialize(left, "cascade")
        # What no level turns away belongs to the side that still has keys.
        return cls(levels, bool(inside))

    def listed(self, key: Column) -> Column:
        out = F.lit(self.last_listed)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def listed_by_join(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The way beyond the size bound: a left join with the distinct listed keys."""
    marks = listed.select(F.col(listed.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("listed", F.lit(True))
    return df.join(marks, key, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def spam_hosts(pages: DataFrame, labels: Sequence[str], url: str = "url") -> DataFrame:
    """A list to filter by: the hosts of ``pages`` that have one of ``labels`` among their dot-separated labels."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
    return hosts.where(F.arrays_overlap(F.split("host", "\\."), F.array(*[F.lit(x) for x in labels])))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    listed: DataFrame,
    key: str = "page_id",
    url: str = "url",
    max_bytes: int = 16 << 20,
) -> DataFrame:
    """Verdict for every url: the longest fitting rule's, else the cascade's, which blocks listed hosts.

    ``listed`` holds blocked hosts in its first column, lower-cased; hosts that the
    corpus has not, nulls and repeats change nothing. Null urls and urls without
    ``://`` have an empty host and path and fit no rule; the empty host is never listed.
    Repeated rows give repeated rows; an empty table gives an empty one, an empty list
    allows whatever no rule blocks. Urls of any length are judged whole. Where a level of
    the cascade would be beyond ``max_bytes``, listed hosts are joined instead. Columns:
    key, host, path, rule, verdict.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    hosts = rows.select(F.col("host").alias("key")).distinct()
    marks = listed.select(F.col(listed.columns[0]).alias("key")).where("key <> ''").distinct().withColumn("mark", F.lit(True))
    # One row for each host: the only join, on distinct keys, to build the cascade.
    universe = materialize(hosts.join(marks, "key", "left").select("key", F.coalesce("mark", F.lit(False)).alias("listed")), "hosts")
    try:
        blocked = BloomCascade.build(universe, max_bytes).listed(F.col("host"))
    except LevelTooLarge:
        rows, blocked = listed_by_join(rows, "host", universe.where("listed").select("key")), F.col("listed")
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(key, "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
