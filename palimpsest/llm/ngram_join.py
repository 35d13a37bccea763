"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes the set of its five-word n-grams (64-bit hashes), a digest of
   that set, and one hash for each of ``b`` bands of ``r`` MinHash rows. ``b`` and
   ``r`` are the most selective scheme, within a number of hashes, that finds a pair of
   the threshold similarity with the target recall.
2. Documents with the same set are one representative with a count.
3. Representatives that meet in a band are tied to the smallest one there (rows
   linear in the members of a band's bucket) and the ties' components are the
   candidate groups: every candidate pair lies within one.
4. A group's members are dealt in blocks, or, where that sends fewer rows, those of
   each of its buckets: a group that hangs together by chains costs what its buckets
   cost, not its square. Each pair of blocks is verified by exact set intersections in
   one task of bounded size, a pair of documents once, in the first band they share.
   It returns counts of links and a spanning set of edges, never the pairs.
5. The components of the edges are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, join_hot, materialize
from .components import components

_BLOCK = 128
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache
def bands_for(threshold: float, recall: float = 0.999, most: int = 320) -> tuple[int, int]:
    """(bands, rows) of the most selective scheme of at most ``most`` hashes with the recall at the threshold."""
    best = None
    for r in range(1, 17):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)) if threshold < 1 else 1
        if b * r <= most:
            best = (b, r)
    if best is None:
        raise ValueError("no banding reaches this recall within the number of hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(31))


class _Shingler:
    """N-gram sets of texts; hashes of words are kept for the next text."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def _hash(self, word: bytes) -> int:
        if len(self.words) > 200_000:
            self.words.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self.words[word] = h
        return h

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer than n words is one n-gram, one without words none."""
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        h = np.array([known.get(w) or self._hash(w) for w in words], dtype=np.uint64)
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = _mix(out * _M1 + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def _signer(bands: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(20240917))
    mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    fold = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _M1)

    def sign(grams: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 512):  # a piece at a time: it stays in the cache
            part = grams[at : at + 512]
            np.minimum(least, ((part[None, :] * mult[:, None]) + add[:, None]).min(axis=1), out=least)
        out = np.full(bands, 7, dtype=np.uint64)
        for row in np.moveaxis(_mix(least).reshape(bands, rows) * fold[None, :], 1, 0):
            out = _mix(out * _M1 + row)
        return (out ^ salt).view(np.int64)

    return sign


def _links(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix left x right: whether the Jaccard similarity reaches the threshold."""
    sizes = np.array([len(g) for g in grams], dtype=np.int64)
    every = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(grams)), sizes)
    values, code, seen = np.unique(every, return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # other n-grams are in no intersection
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    place_l, place_r = np.full(len(grams), -1), np.full(len(grams), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step, total = 4096, int(code[-1]) + 1 if len(code) else 0
    for at in range(0, total, step):
        a, b = np.searchsorted(code, [at, at + step])
        c, o = code[a:b] - at, owner[a:b]
        l, r = place_l[o] >= 0, place_r[o] >= 0
        ml, mr = np.zeros((len(left), step), dtype=np.float32), np.zeros((len(right), step), dtype=np.float32)
        ml[place_l[o[l]], c[l]] = 1
        mr[place_r[o[r]], c[r]] = 1
        common += ml @ mr.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * union - 1e-6


def _digest(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def with_digest(docs: DataFrame, text: str = "text", n: int = 5) -> DataFrame:
    """``docs`` with ``grams``: the digest of each row's n-gram set, null without one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = _Shingler(n)
        for part in parts:
            part["grams"] = [_digest(shingler.set_of(t)) for t in part[text]]
            yield part
        del shingler
        give_back()

    return docs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", grams binary")


def ngram_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    block: int = _BLOCK,
) -> DataFrame:
    """Per row of ``docs``: key, class_id, n_links, n_ngrams.

    Two documents are linked if the Jaccard similarity of their n-gram sets reaches
    ``threshold``; ``class_id`` is the smallest key of those connected by links, and
    ``n_links`` the number of other documents linked directly (exact copies count).
    Words are case-sensitive runs of non-white space. A text of 1 to n-1 words is a
    single n-gram of all its words. Null, empty and blank texts have no n-gram: no
    link, own class. Rows of the same key count as one document for each different
    n-gram set. Null keys are left out. Any number of copies, near copies or members
    of a band is handled, in blocks; nothing is capped.
    """
    return row_classes(docs, key, text, n, threshold, recall, block).drop("grams", "root")


def row_classes(docs: DataFrame, key: str, text: str, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = _BLOCK) -> DataFrame:
    """``ngram_classes`` with ``grams``, the digest of the row's n-gram set, and ``root``, which
    names its class also where keys repeat; both null without an n-gram."""
    bands, rows = bands_for(threshold, recall)
    kind = docs.schema[key].dataType.simpleString()

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, sign = _Shingler(n), _signer(bands, rows)
        for part in parts:
            keys, sets, sizes, signs = [], [], [], []
            for k, t in zip(part["own_key"], part["own_text"], strict=True):
                g = shingler.set_of(t)
                keys.append(k)
                sizes.append(len(g))
                sets.append(_digest(g))
                signs.append(sign(g).tobytes() if len(g) else None)
            yield pd.DataFrame({"id": pd.Series(keys, dtype=part["own_key"].dtype), "own_hash": part["own_hash"], "grams": sets, "n_ngrams": sizes, "bands": signs})
        del shingler
        give_back()

    own = docs.select(F.col(key).alias("own_key"), F.col(text).alias("own_text"), F.xxhash64(F.col(text)).alias("own_hash")).where("own_key is not null")
    signed = materialize(own.mapInPandas(describe, f"id {kind}, own_hash long, grams binary, n_ngrams long, bands binary"), "signatures")
    # One representative for each set: partial aggregation meets the copies before the shuffle.
    ids = signed.where("grams is not null").groupBy("grams", "id").agg(F.min("own_hash").alias("own_hash"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    reps = ids.groupBy("grams").agg(F.min(F.struct("id", "own_hash")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.sum("rows").alias("rows"))
    reps = materialize(reps.select("grams", F.col("rep.id").alias("rep"), F.col("rep.own_hash").alias("rep_hash"), "copies", "rows", "bands"), "representatives")
    hashes = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("bands", i * 8 + 1, F.lit(8)))
    # The 16 bytes of the set identify a representative also where keys repeat.
    members = reps.select("grams", F.posexplode(hashes).alias("band", "hash"))
    hubs = materialize(members.groupBy("band", "hash").agg(F.min("grams").alias("v"), F.count("*").alias("n")).where("n > 1"), "buckets")
    ties = members.join(hubs, ["band", "hash"]).select(F.col("grams").alias("u"), "v").where("u <> v").distinct()
    groups = materialize(components(ties, "candidates"), "candidate-groups")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    # What a group costs in rows sent: by blocks of the whole, and by blocks of its buckets.
    by_bucket = hubs.join(groups.withColumnRenamed("node", "v"), "v").groupBy("root").agg(F.sum(F.col("n") * blocks("n")).alias("by_bucket"))
    plan = groups.groupBy("root").agg(F.count("*").alias("size")).join(by_bucket, "root")
    plan = materialize(plan.select("root", "size", blocks("size").alias("blocks"), (F.col("by_bucket") < F.col("size") * blocks("size")).alias("split")), "plan")
    dealt = join_hot(groups, plan, "root", "size").join(reps.withColumnRenamed("grams", "node"), "node")
    mine = lambda own, k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high")))
    unit = lambda band, hash_, own, k: F.transform(mine(own, k), lambda x: F.struct(band.alias("band"), hash_.alias("hash"), x["low"].alias("low"), x["high"].alias("high"), k.alias("of")))
    place = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    whole = dealt.where("not split").select("node", "root", "rep", "rep_hash", "copies", F.lit(None).cast("binary").alias("bands"), unit(F.lit(-1), F.lit(b""), place(F.col("blocks")), F.col("blocks")).alias("units"))
    parts = dealt.where("split").select("node", F.posexplode(hashes).alias("band", "hash")).join(hubs.select("band", "hash", "n"), ["band", "hash"])
    parts = parts.groupBy("node").agg(F.flatten(F.collect_list(unit(F.col("band"), F.col("hash"), place(blocks("n")), blocks("n")))).alias("units"))
    parts = dealt.where("split").join(parts, "node").select("node", "root", "rep", "rep_hash", "copies", "bands", "units")
    work = materialize(whole.unionByName(parts), "work")
    # The texts of the candidates only, one for each set; each set is sent where its member is verified.
    # Never broadcast: plan and costs are the same at every size.
    texts = own.join(work.hint("merge"), (F.col("own_key") == F.col("rep")) & F.col("own_hash").eqNullSafe(F.col("rep_hash"))).dropDuplicates(["own_key", "own_hash", "node"])

    def shingle(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler = _Shingler(n)
        for own_text, node in parts:
            sets = [shingler.set_of(t) for t in own_text]
            yield pd.Series([g.tobytes() if _digest(g) == bytes(u) else None for g, u in zip(sets, node, strict=True)], dtype=object)
        del shingler
        give_back()

    own_set = F.pandas_udf(shingle, "binary").asNondeterministic()
    sets = texts.select("root", "node", "copies", "bands", "units", own_set("own_text", "node").alias("grams")).where("grams is not null")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        low, high, band = int(group["low"].iloc[0]), int(group["high"].iloc[0]), int(group["band"].iloc[0])
        nodes, copies, where = group["node"].tolist(), group["copies"].to_numpy(), group["own"].to_numpy()
        grams = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
        left, right = np.flatnonzero(where == low), np.flatnonzero(where == high)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "other": [], "links": []})
        linked = _links(grams, left, right, threshold)
        if band >= 0:  # pairs that share an earlier band are verified there
            signs = np.array([np.frombuffer(x, dtype=np.int64) for x in group["bands"]])
            for b in range(band):
                linked &= signs[left, b][:, None] != signs[right, b][None, :]
        if low == high:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(nodes), dtype=np.int64)
        links[left] += linked @ copies[right]
        if low != high:
            links[right] += linked.T @ copies[left]
        root = list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(left[i])), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
        hit = np.flatnonzero(links > 0)
        return pd.DataFrame({"node": [nodes[i] for i in hit], "other": [nodes[find(int(i))] for i in hit], "links": links[hit]})

    sent = sets.select("root", "node", "copies", "bands", "grams", F.explode("units").alias("unit")).select("root", "node", "copies", "bands", "grams", "unit.*")
    sent = sent.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).drop("of")
    found = materialize(sent.groupBy("root", "band", "hash", "low", "high").applyInPandas(verify, "node binary, other binary, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")), "classes")
    linked = materialize(classes.join(links, "node").join(reps.select(F.col("grams").alias("node"), "rep"), "node"), "linked")
    names = materialize(linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")), "class-names")
    named = join_hot(linked.select("node", "root", "links"), names, "root").select(F.col("node").alias("grams"), "class_id", "root", "links")
    reps = materialize(reps.join(named, "grams", "left").select("grams", "rows", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("root", "grams").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = join_hot(signed.select("id", "grams", "n_ngrams"), reps, "grams", "rows")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_ngrams", "grams", "root")
