"""SimHash near-duplicates by a Gray-order hierarchical index.

1. A text's fingerprint has a bit for each of 64 positions at which over half of its
   shingles' hashes have one. Rows of one fingerprint become one entry with a count.
2. Two fingerprints within distance ``d`` agree on at least one of ``d + 1`` runs of bit
   positions, so entries are dealt by each run's value. A crowded group is dealt again
   by the runs of the positions it doesn't agree on yet (which suits many unlike
   entries) or in pairs of blocks (which suits a dense crowd), whichever sends less.
3. In a group, fingerprints are sorted by Gray rank and every ``fanout`` of them hang
   under a node. A node holds the pattern (mask and bits) on which all below it agree,
   less what a node above holds already. A query descends from the group's root and
   adds up its differences to the patterns: above ``d`` the whole node is left out;
   if even all open positions can't lift it above ``d``, the whole node is linked.
4. Each group returns a spanning set of links, never the pairs; the components of all
   links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_hot, materialize
from .components import components

_BITS, _SLICE = 64, 1024
_GROUP = ["mask", "value", "a", "b"]


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint: words are runs of non-white-space with A-Z lower-cased, shingles are
    ``n`` words joined by spaces (all of them, if fewer), repeats count; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    votes, digest = np.zeros(_BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), 1 << 15):
        a, b = begins[at : at + (1 << 15)], ends[at : at + (1 << 15)]
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)), dtype="<u8", count=len(a))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(begins), bitorder="little")
    return int(bits.view("<u8")[0])


def gray_rank(bits: Column) -> Column:
    """The place of a fingerprint in Gray order, as an unsigned number with its top bit turned so that it sorts as a long."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, s))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def runs(mask: int, parts: int) -> list[int]:
    """``mask`` widened by each of ``parts`` runs of the positions it leaves open (signed 64-bit numbers)."""
    left = [i for i in range(_BITS) if not (mask >> i) & 1]
    cuts = [len(left) * k // parts for k in range(parts + 1)]
    return [_signed((mask % (1 << 64)) | sum(1 << i for i in left[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


class GrayIndex:
    """The index of fingerprints in Gray order within groups: levels of nodes, the groups' roots last."""

    def __init__(self, bits: np.ndarray, group: np.ndarray, fanout: int = 8):
        self.bits = bits
        every = np.arange(len(bits))
        level = {"low": every, "high": every + 1, "and": bits, "or": bits, "group": group}
        self.levels = [level]
        while len(level["group"]) > (np.diff(level["group"]) != 0).sum() + 1:
            own = level["group"]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            begin = np.flatnonzero(place % fanout == 0)
            level["up"] = np.cumsum(place % fanout == 0) - 1
            level = {
                "low": level["low"][begin],
                "high": np.maximum.reduceat(level["high"], begin),
                "and": np.bitwise_and.reduceat(level["and"], begin),
                "or": np.bitwise_or.reduceat(level["or"], begin),
                "group": own[begin],
                "child": begin,
                "end": np.append(begin[1:], len(own)),
            }
            self.levels.append(level)
        for k, level in enumerate(self.levels):
            level["same"] = ~(level["and"] ^ level["or"])
            level["open"] = np.bitwise_count(~level["same"]).astype(np.int64)
        for k, level in enumerate(self.levels):
            above = self.levels[k + 1]["same"][level["up"]] if "up" in level else np.uint64(0)
            level["mask"] = level["same"] & ~above  # what no node above holds

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (lower, higher) that connect all fingerprints within ``distance`` in a group."""
        low, high = [], []
        for at in range(0, len(self.bits), _SLICE):
            query = np.arange(at, min(at + _SLICE, len(self.bits)))
            top = self.levels[-1]
            node = np.searchsorted(top["group"], self.levels[0]["group"][query])
            differ = np.zeros(len(query), dtype=np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                level = self.levels[k]
                differ = differ + np.bitwise_count((self.bits[query] ^ level["and"][node]) & level["mask"][node])
                near = (differ <= distance) & (level["high"][node] > query + 1)
                query, node, differ = query[near], node[near], differ[near]
                whole = differ + level["open"][node] <= distance
                low.append(query[whole])
                high.append(np.maximum(level["low"][node[whole]], query[whole] + 1))
                query, node, differ = query[~whole], node[~whole], differ[~whole]
                if k:
                    many = level["end"][node] - level["child"][node]
                    begin = np.repeat(level["child"][node] - np.cumsum(many) + many, many)
                    node = begin + np.arange(int(many.sum()))
                    query, differ = np.repeat(query, many), np.repeat(differ, many)
        return np.concatenate(low), np.concatenate(high)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one it is connected with."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        least, most = np.minimum(a, b), np.maximum(a, b)
        apart = least < most
        u, v = u[apart], v[apart]
        np.minimum.at(root, most[apart], least[apart])
        while (root != root[root]).any():
            root = root[root]
    return root


def _linked(part: pd.DataFrame, distance: int) -> pd.DataFrame:
    """u, v: each fingerprint of whole units (sorted by unit and Gray rank) with the first one it is connected with there."""
    bits = part["bits"].to_numpy().view(np.uint64)
    own = part[_GROUP].to_numpy()
    group = np.cumsum(np.concatenate(([False], (own[1:] != own[:-1]).any(axis=1))))
    root = _roots(len(bits), *GrayIndex(bits, group).links(distance))
    own = np.flatnonzero(root != np.arange(len(bits)))
    return pd.DataFrame({"u": bits[own].view(np.int64), "v": bits[root[own]].view(np.int64)})


def links(entries: DataFrame, distance: int = 4, block: int = 1024) -> DataFrame:
    """u, v: links that connect all fingerprints (column ``bits``, each once) within ``distance`` of each other.

    A group of more than ``block`` entries is dealt again by its open positions, or in
    pairs of blocks, whichever sends fewer rows, so no task holds more than two blocks in one piece.
    """
    if not 0 <= distance < 16 or block < 1 << distance:
        raise ValueError("distance is 0 to 15 and block at least 2 ** distance")
    spark, parts = entries.sparkSession, []
    value = lambda mask: F.col("bits").bitwiseAND(F.col(mask)).alias("value")
    rows = entries.select("bits", F.explode(F.array(*map(F.lit, runs(0, distance + 1)))).alias("mask")).select("mask", value("mask"), "bits")
    total = entries.count() * (distance + 1)
    cost = lambda n: F.sum(F.col(n) * F.ceil(F.col(n) / block))  # noqa: E731  rows sent in pairs of blocks
    while True:
        sizes = materialize(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "groups")
        crowded = sizes.where(F.col("n") > block)
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # at most (distance + 1) ** rounds
        sized = join_hot(rows, sizes.withColumn("size", F.col("n")), ["mask", "value"], total=total).where("size is not null")
        if not masks:
            parts.append(sized.select("mask", "value", "bits", F.lit(1).alias("blocks")))
            break
        sized = materialize(sized, "grouped")
        wider = F.broadcast(spark.createDataFrame([(m, x) for m in masks for x in runs(m, distance + 1)], "mask long, deeper long"))
        again = sized.where(F.col("size") > block).join(wider, "mask").withColumn("deep", F.col("bits").bitwiseAND(F.col("deeper")))
        inner = again.groupBy("mask", "value", "deeper", "deep").agg(F.count("*").alias("m")).where("m > 1").groupBy("mask", "value").agg(cost("m").alias("inner"))
        plan = crowded.join(inner, ["mask", "value"], "left").select("mask", "value", "n", (F.coalesce("inner", F.lit(0)) < F.col("n") * F.ceil(F.col("n") / block)).alias("again"))
        plan = materialize(plan, "plan")
        parts.append(sized.where(F.col("size") <= block).select("mask", "value", "bits", F.lit(1).alias("blocks")))
        dealt = join_hot(sized.where(F.col("size") > block), plan, ["mask", "value"])
        parts.append(dealt.where("not again").select("mask", "value", "bits", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
        deeper = dealt.where("again").join(wider, "mask").select(F.col("deeper").alias("mask"), value("deeper"), "bits")
        rows = materialize(deeper, "dealt")
        total = rows.count()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            more = int(np.any([held[c] != last[c] for c in _GROUP], axis=0).sum())
            if more:  # the last group may go on in the next batch
                yield _linked(held.iloc[:more], distance)
                held = held.iloc[more:].reset_index(drop=True)
        if held is not None and len(held):
            yield _linked(held, distance)

    every = reduce(DataFrame.unionByName, parts).withColumn("own", F.pmod(F.xxhash64("bits"), "blocks").cast("int"))
    # A pair of blocks is one unit, which also links each of them within itself.
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("own"))
    pair = F.transform(others, lambda i: F.struct(F.least(i, "own").alias("a"), F.greatest(i, "own").alias("b")))
    unit = F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(pair)).alias("unit")
    sent = every.select("mask", "value", unit, "bits").select("mask", "value", "unit.a", "unit.b", "bits")
    # A unit's rows must stay together: an explicit exchange is never split for skew.
    return sent.repartition(*_GROUP).sortWithinPartitions(*_GROUP, gray_rank(F.col("bits"))).mapInPandas(solve, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, n: int = 4, seed: int = 42, block: int = 1024) -> DataFrame:
    """Per row of ``docs``: key, fingerprint (16 lowercase hex digits), component_id.

    Texts whose fingerprints differ in at most ``distance`` bits are linked;
    ``component_id`` is the smallest key reachable by links, the own included. Null, empty
    and blank texts have the fingerprint zero, which is linked like any other. Every row is
    kept; rows of a null key link others but name no component unless all its keys are null.
    Rows of one key count each with its own text. Other columns may have any name.
    """
    kind = docs.schema[key].dataType.simpleString()

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bits = np.array([fingerprint(t, n, seed) for t in part["own_text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": part["own_key"], "bits": bits.view(np.int64)})
        give_back()

    own = docs.select(F.col(key).alias("own_key"), F.col(text).alias("own_text"))
    signed = materialize(own.mapInPandas(describe, f"id {kind}, bits long"), "fingerprints")
    entries = materialize(signed.groupBy("bits").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "entries")
    found = components(links(entries.select("bits"), distance, block), "simhash")
    linked = materialize(found.join(entries.withColumnRenamed("bits", "node"), "node"), "linked")
    names = materialize(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "names")
    named = join_hot(linked.select("node", "root"), names, "root").select(F.col("node").alias("bits"), "component_id")
    entries = materialize(entries.join(named, "bits", "left").select("bits", "n", F.coalesce("component_id", "rep").alias("component_id")), "named")
    out = join_hot(signed, entries, "bits")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
