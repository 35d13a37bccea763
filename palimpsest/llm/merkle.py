"""Merkle dataset manifest: trees over ordered leaves, built by mountain ranges of partitions.

1. Leaves are ordered within their group by a range partitioning; a block is one of its
   partitions, and counts of blocks give every leaf its index in the group.
2. A block goes through its leaves with a stack of peaks. Counting in the base of the
   fanout, a carry means that the runs below are complete: they are hashed into their
   node, which is emitted as a record and may complete the next run. The group's last
   run may be short and is hashed as it is, without padding, as the group's size is known.
3. What no block can complete alone, because its edge is not a multiple of the fanout's
   powers, stays a peak: a number logarithmic in the block's leaves. Ranges of blocks
   merge their peaks by the same stack in rounds, many at a time, until a peak is left
   for each group, its subroot. Subroots, in order, are the leaves of the last tree.
4. A leaf's siblings outside its block are peaks or nodes of the merging rounds only, so
   proofs need each block's leaves and a number of other nodes logarithmic in all leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

_MERGED, _ROWS, _BLOCKS = 64, 8192, 20_000
_NODE = "grp string, size long, level int, node long, digest string, part long, peak boolean"
_STEP = "struct<before:string,after:string>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf_text(*columns: Column) -> Column:
    """The columns as one string without ambiguity: ``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    own = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in own])


def widths(size: int, fanout: int) -> list[int]:
    """Number of nodes on each level, the leaves first and the root last."""
    out = [size]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Range:
    """The stack of peaks of consecutive nodes of one tree of ``size`` leaves; ``made`` gets the records of completed nodes."""

    def __init__(self, size: int, fanout: int):
        self.fanout, self.widths, self.peaks, self.made = fanout, widths(size, fanout), [], []

    def add(self, level: int, node: int, digest: str) -> None:
        """The next node in order. A run that ends with it and whose first node is a peak too becomes its parent."""
        self.peaks.append((level, node, digest))
        while level + 1 < len(self.widths):
            begin = node - node % self.fanout
            if node + 1 != min(begin + self.fanout, self.widths[level]):
                return
            run = self.peaks[begin - node - 1 :]
            if len(run) != node - begin + 1 or run[0][:2] != (level, begin):
                return  # it began in an earlier block
            del self.peaks[begin - node - 1 :]
            level, node, digest = level + 1, node // self.fanout, sha256("".join(x[2] for x in run))
            self.peaks.append((level, node, digest))
            self.made.append((level, node, digest))


def _stacked(rows: Iterator[tuple[int, int, str]], size: int, fanout: int) -> Range:
    own = Range(size, fanout)
    for level, node, digest in rows:
        own.add(level, node, digest)
    return own


def _records(of: dict[tuple, Range], part: int) -> pd.DataFrame:
    """What a part leaves: its completed nodes, and its peaks."""
    out = []
    for (grp, size), own in of.items():
        peaks = {x[:2] for x in own.peaks}
        out += [(grp, size, *x, part, x[:2] in peaks) for x in own.made]
        known = {x[:2] for x in own.made}
        out += [(grp, size, *x, part, True) for x in own.peaks if x[:2] not in known]
    return pd.DataFrame(out, columns=["grp", "size", "level", "node", "digest", "part", "peak"])


def _by_group(part: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for (grp, size), own in part.groupby(["grp", "size"], dropna=False, sort=False):
        yield (None if pd.isna(grp) else grp, int(size)), own


@dataclass(frozen=True)
class Forest:
    """``leaves``: grp, size, block, node (the index in the group), digest and the columns kept.
    ``outer``: records of peaks and of nodes that the merging rounds made; ``inner``: those that blocks made."""

    leaves: DataFrame
    inner: DataFrame
    outer: DataFrame
    fanout: int

    def nodes(self) -> DataFrame:
        """grp, level, node, digest: every node above the leaves, each once."""
        outer = self.outer.where("level > 0").dropDuplicates(["grp", "size", "level", "node"])
        return self.inner.unionByName(outer).select("grp", "level", "node", "digest")

    def roots(self) -> DataFrame:
        """grp, size, digest: a row for each group."""
        top = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.col("size").alias("n"), F.lit(0).alias("k")), lambda s, _: F.when(s["n"] <= 1, s).otherwise(F.struct(F.ceil(s["n"] / self.fanout).cast("long").alias("n"), (s["k"] + 1).alias("k"))))["k"]
        return self.outer.where((F.col("node") == 0) & (F.col("level") == top)).select("grp", "size", "digest").distinct()


def build(leaves: DataFrame, order: list[str], fanout: int = 2, block_rows: int = _ROWS, name: str = "merkle") -> Forest:
    """One tree for each ``grp`` of ``leaves`` (grp string, digest string, and other columns, which are kept).

    Leaves ascend by ``order``, nulls first, then by digest. Every ``fanout`` consecutive
    nodes become their parent, the last run as it is.
    """
    if fanout < 2:
        raise ValueError("fanout is at least 2")
    n = leaves.count()
    blocks = max(1, min(_BLOCKS, -(-n // block_rows)))
    # Equal leaves are spread by their place in the input: their order among themselves changes no node.
    own = leaves.withColumn("own_place", F.monotonically_increasing_id())
    keys = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("digest").asc(), F.col("own_place").asc()]
    ranged = own.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys)
    ranged = ranged.drop("own_place").withColumn("block", F.spark_partition_id().cast("long")).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = materialize(ranged, f"{name}-ordered")
    counts = ranged.groupBy("block", "grp").agg(F.count("*").alias("held"), F.min("place").alias("begin"))
    earlier = F.coalesce(F.sum("held").over(W.partitionBy("grp").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.withColumn("start", earlier).withColumn("size", F.sum("held").over(W.partitionBy("grp"))), f"{name}-blocks")  # a row for each block and group
    same = (F.col("r.block") == F.col("c.block")) & F.col("r.grp").eqNullSafe(F.col("c.grp"))
    kept = [F.col(f"r.`{c}`") for c in ranged.columns if c != "place"]
    indexed = materialize(ranged.alias("r").join(counts.alias("c"), same).select(*kept, (F.col("r.place") - F.col("c.begin") + F.col("c.start")).alias("node"), "c.size", "c.start", "c.held"), f"{name}-indexed")

    def stack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        of = {key: _stacked(zip([0] * len(own), own["node"], own["digest"], strict=True), key[1], fanout) for key, own in _by_group(part)}
        return _records(of, int(part["block"].iloc[0]))

    records = materialize(indexed.select("grp", "size", "block", "node", "digest").groupBy("block").applyInPandas(stack, _NODE), f"{name}-records")
    outer, peaks = records.where("peak"), records.where("peak")
    parts = (counts.agg(F.max("block")).first()[0] or 0) + 1  # as dealt, whatever was asked for

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        # In order of leaves: by the part they come from, and within it as the stack held them.
        part = part.assign(first=[n * fanout**k for n, k in zip(part["node"], part["level"], strict=True)]).sort_values("first")
        of = {key: _stacked(zip(own["level"], own["node"], own["digest"], strict=True), key[1], fanout) for key, own in _by_group(part)}
        return _records(of, int(part["into"].iloc[0]))

    while parts > 1:
        parts = -(-parts // _MERGED)
        merged = peaks.withColumn("into", F.floor(F.col("part") / _MERGED)).groupBy("into").applyInPandas(merge, _NODE)
        peaks = materialize(merged, f"{name}-merged")
        outer, peaks = outer.unionByName(peaks), peaks.where("peak")
    return Forest(indexed, records.where("not peak").drop("part", "peak"), outer.drop("part", "peak"), fanout)


def _needed(forest: Forest) -> DataFrame:
    """block, grp, size, level, node, digest: the nodes outside a block that its leaves' proofs take."""
    f = F.lit(forest.fanout).cast("long")
    spans = forest.leaves.select("block", "grp", "size", "start", "held").distinct().withColumn("spans", _spans(F.col("start"), F.col("start") + F.col("held") - 1, F.col("size"), f))
    runs = spans.select("block", "grp", "size", F.explode("spans").alias("s")).select("block", "grp", "size", "s.level", F.explode(F.sequence(F.col("s.low"), F.col("s.high"))).alias("node"))
    known = forest.outer.distinct()
    same = (F.col("n.grp").eqNullSafe(F.col("k.grp"))) & (F.col("n.level") == F.col("k.level")) & (F.col("n.node") == F.col("k.node"))
    return materialize(runs.alias("n").join(known.alias("k"), same).select("n.block", "n.grp", "n.size", "n.level", "n.node", "k.digest"), "needed")


def _spans(low: Column, high: Column, size: Column, f: Column) -> Column:
    """For each level but the root's, the two runs at the edges of the nodes above leaves ``low`` to ``high``."""
    span = lambda k, a, b: F.struct(k.alias("level"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    begin = F.struct(F.lit(0).alias("k"), low.cast("long").alias("a"), high.cast("long").alias("b"), size.cast("long").alias("n"), F.array().cast("array<struct<level:int,low:bigint,high:bigint>>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        first = lambda x: x - x % f
        last = lambda x: F.least(first(x) + f - 1, s["n"] - 1)
        edges = F.when(first(s["a"]) == first(s["b"]), F.array(span(s["k"], first(s["a"]), last(s["a"])))).otherwise(F.array(span(s["k"], first(s["a"]), last(s["a"])), span(s["k"], first(s["b"]), last(s["b"]))))
        up = F.struct((s["k"] + 1).alias("k"), F.floor(s["a"] / f).cast("long").alias("a"), F.floor(s["b"] / f).cast("long").alias("b"), F.ceil(s["n"] / f).cast("long").alias("n"), F.concat(s["out"], edges).alias("out"))
        return F.when(s["n"] <= 1, s).otherwise(up)

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), begin, step)["out"]


def paths(own: pd.DataFrame, known: pd.DataFrame, size: int, fanout: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block (sorted by node) its steps to the root: what stands before and after it in its run."""
    levels = widths(size, fanout)
    digests: list[dict[int, str]] = [{} for _ in levels]
    for level, node, digest in zip(known["level"], known["node"], known["digest"], strict=True):
        digests[level][node] = digest
    stack = Range(size, fanout)
    for node, digest in zip(own["node"].tolist(), own["digest"], strict=True):
        digests[0][node] = digest
        stack.add(0, node, digest)
    for level, node, digest in stack.made:
        digests[level][node] = digest
    steps: list[tuple[int, tuple[str, str]]] = [(-1, ("", ""))] * (len(levels) - 1)
    for node in own["node"].tolist():
        for level in range(len(levels) - 1):
            at = node // fanout**level
            if steps[level][0] == at:
                break  # what is above has not changed either
            begin = at - at % fanout
            run = [digests[level][i] for i in range(begin, min(begin + fanout, levels[level]))]
            steps[level] = (at, ("".join(run[: at - begin]), "".join(run[at - begin + 1 :])))
        yield [s for _, s in steps]


def folded(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in steps:
        digest = sha256(before + digest + after)
    return digest


def with_paths(forest: Forest, finish: Callable[[pd.DataFrame, list], pd.DataFrame], columns: list[str], schema: str) -> DataFrame:
    """``finish(leaves, their paths)`` for each block's leaves of a group; ``columns`` of the leaves are passed on."""
    names = list(dict.fromkeys(["grp", "size", "node", "digest", *columns]))
    fanout = forest.fanout

    def prove(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        of, out = dict(_by_group(known)), []
        for key, some in _by_group(own):
            some = some.sort_values("node").reset_index(drop=True)
            out.append(finish(some, paths(some, of.get(key, known.iloc[:0]), key[1], fanout)))
        return pd.concat(out) if out else finish(own, iter(()))

    return forest.leaves.select("block", *names).groupBy("block").cogroup(_needed(forest).groupBy("block")).applyInPandas(prove, schema)


def manifest(docs: DataFrame, key: str, columns: list[str], by: str, tampered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = 2, block_rows: int = _ROWS) -> DataFrame:
    """Per row of ``docs``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``leaf_text`` of ``columns``. The rows of each value of ``by`` (null
    is one) are a tree, ascending by key (nulls first, then by leaf); the trees' roots, in the
    order of ``by`` (null first, bytewise), are the leaves of the last one. ``proof_sha256``
    hashes all siblings from the leaf up, left to right. For rows for which ``where`` holds
    (null does not), ``folded_root`` starts from a leaf with the ``tampered`` columns instead;
    ``verified`` says whether it equals the root. A lone leaf is its tree's root, and its
    proof is the hash of nothing if its tree is alone too. Equal rows are leaves of their
    own. No row gives no row. Other columns may have any name.
    """
    kind = docs.schema[key].dataType.simpleString()
    plain = {c: F.col(f"`{c}`") for c in columns}
    other = plain | (tampered or {})
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    leaf = F.sha2(leaf_text(*plain.values()), 256)
    leaves = docs.select(F.col(f"`{by}`").cast("string").alias("grp"), F.col(key).alias("key"), leaf.alias("digest"), F.when(hit, F.sha2(leaf_text(*other.values()), 256)).alias("changed"))
    trees = build(materialize(leaves, "leaves"), ["key"], fanout, block_rows, "leaves")
    # Subroots in order of their groups: one more tree, built in the same way.
    roots = materialize(trees.roots(), "subroots")
    top = build(roots.select(F.lit("all").alias("grp"), F.col("grp").alias("own"), "digest"), ["own"], fanout, block_rows, "top")

    def upper(own: pd.DataFrame, steps: Iterator[list]) -> pd.DataFrame:
        return pd.DataFrame({"own": own["own"], "subroot": own["digest"], "steps": [[{"before": b, "after": a} for b, a in s] for s in steps]}, columns=["own", "subroot", "steps"])

    root = next(iter(top.roots().select("digest").collect()), [None])[0]  # one row
    above = materialize(with_paths(top, upper, ["own"], f"own string, subroot string, steps array<{_STEP}>").withColumn("root", F.lit(root).cast("string")), "above")
    # Each block's groups carry their way from subroot to root.
    blocks = trees.leaves.select("block", "grp").distinct()
    way = blocks.alias("b").join(above.alias("a"), F.col("b.grp").eqNullSafe(F.col("a.own"))).select(F.col("b.block"), F.col("b.grp"), F.lit(0).cast("long").alias("size"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("string").alias("digest"), "a.subroot", "a.root", "a.steps")
    inside = _needed(trees)
    for c, t in (("subroot", "string"), ("root", "string"), ("steps", f"array<{_STEP}>")):
        inside = inside.withColumn(c, F.lit(None).cast(t))
    known = materialize(inside.unionByName(way), "known")
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def prove(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ways = {None if pd.isna(g) else g: (s, r, [(x["before"], x["after"]) for x in w]) for g, s, r, w in known.loc[known["level"] < 0, ["grp", "subroot", "root", "steps"]].itertuples(index=False)}
        inner, out = dict(_by_group(known[known["level"] >= 0])), []
        for (grp, size), some in _by_group(own):
            some = some.sort_values("node").reset_index(drop=True)
            subroot, root, rest = ways[grp]
            tail = "".join(b + a for b, a in rest)
            proofs, ends = [], []
            for digest, changed, steps in zip(some["digest"], some["changed"], paths(some, inner.get((grp, size), known.iloc[:0]), size, fanout), strict=True):
                proofs.append(sha256("".join(b + a for b, a in steps) + tail))
                ends.append(folded(folded(changed if isinstance(changed, str) else digest, steps), rest))
            out.append(pd.DataFrame({"key": some["key"], "leaf": some["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": ends}))
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    own = trees.leaves.select("block", "grp", "size", "node", "digest", "key", "changed")
    out = own.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(prove, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
