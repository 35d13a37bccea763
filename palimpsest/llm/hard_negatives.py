"""Hard negatives by partial products in an orthogonal PCA rotation.

1. Vectors become integers. An orthogonal rotation to the principal components of a
   bounded sample keeps every inner product and puts most of it in the leading
   components; any rotation gives the same results, a good one only discards earlier.
2. Anchors and data meet in blocks. In a block, products are accumulated over the
   leading components; what is left of a product is at most the product of the two
   residual norms, and a slack covers all rounding. A pair whose product can't reach
   the anchor's window, or its best so far, is discarded early.
3. What survives all stages is verified with exact integer products.
4. A first pass searches each anchor in one block only, which gives the scores that its
   k-th best can't be below; the second one sends it to the others with these.
5. The best rows of the same label are the positives; each gives a window of scores, in
   which the best rows of other labels are the negatives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, materialize
from .topk_join import quantized

_DATA, _ASKS, _ROWS, _ANCHORS, _SAMPLE, _WIDEST, _PAIRS = 4096, 4096, 1024, 256, 8192, 1024, 1 << 15
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_ANCHOR, _UNIT = ["anchor_id", "anchor_row"], ["width", "part", "block", "slice"]


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """width -> orthogonal matrix, fitted on at most 8,192 vectors, those of the smallest hashes.

    Vectors of a length that is rare there, or above 1,024, are not rotated.
    """
    taken: dict[int, list] = {}
    for r in rows.where(F.size("v") <= _WIDEST).select("id", "v").orderBy(F.xxhash64("id", F.lit("rotation")), "id", "v").limit(_SAMPLE).select("v").collect():
        taken.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for width, some in taken.items():
        if width > 1 and len(some) >= 2 * width:
            x = np.array(some, dtype=np.float64)
            x /= max(1.0, np.abs(x).max())
            out[width] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def _integers(column: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column]) if len(column) else np.zeros((0, width), dtype=np.int64)


def _exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; one beyond 64 bits is the nearest 64-bit integer."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    out = np.zeros(len(i), dtype=np.int64)
    for at in range(0, len(i), _PAIRS):
        u, v = a[i[at : at + _PAIRS]], x[j[at : at + _PAIRS]]
        if most < 2.0**62:
            out[at : at + _PAIRS] = (u * v).sum(axis=1)
        else:
            out[at : at + _PAIRS] = np.clip((u.astype(object) * v.astype(object)).sum(axis=1) if u.shape[1] else 0, _LEAST, _MOST).astype(np.int64)
    return out


class _Side:
    """Integers, rotated components, and the norm of what is left after each stage."""

    def __init__(self, vectors: pd.Series, rotation: np.ndarray | None, width: int, cuts: list[int]):
        self.v = _integers(vectors, width)
        x = self.v.astype(np.float64)
        self.y = x if rotation is None else x @ rotation
        self.norm = np.sqrt((x * x).sum(axis=1))
        squares = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        squares = np.concatenate([squares, np.zeros((len(x), 1))], axis=1)
        self.left = [np.sqrt(squares[:, c]) * (1 + 1e-12) for c in cuts]


def survivors(a: _Side, x: _Side, cuts: list[int], need: np.ndarray, most: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (anchor, row) whose product may lie in [need, most], and how many were left after each stage.

    ``fit``: which pairs are asked for at all. Stages go over all pairs while many are left, then pair by pair.
    """
    need, most = need.astype(np.float64), most.astype(np.float64)
    slack = lambda u, v: 1e-10 * u * v + 1e-6  # noqa: E731  far above what sums of this length can lose by rounding
    dense, done, counts = np.zeros((len(a.v), len(x.v))), 0, []
    i = j = p = None
    for k, cut in enumerate(cuts):
        if i is None:
            dense += a.y[:, done:cut] @ x.y[:, done:cut].T
            rest = np.outer(a.left[k], x.left[k]) + slack(a.norm[:, None], x.norm[None, :])
            fit = fit & (dense + rest >= need[:, None]) & (dense - rest <= most[:, None])
            n = int(np.count_nonzero(fit))
            if 8 * n < fit.size or cut == cuts[-1]:
                i, j = np.nonzero(fit)
                p = dense[i, j]
        else:
            for at in range(0, len(i), _PAIRS):
                some = slice(at, at + _PAIRS)
                p[some] += np.einsum("ij,ij->i", a.y[i[some], done:cut], x.y[j[some], done:cut])
            rest = a.left[k][i] * x.left[k][j] + slack(a.norm[i], x.norm[j])
            ok = (p + rest >= need[i]) & (p - rest <= most[i])
            i, j, p = i[ok], j[ok], p[ok]
            n = len(i)
        done = cut
        counts.append(n)
    return i, j, counts


def _best(window: np.ndarray, score: np.ndarray, key: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Places of each window's k best rows (with copies), in order."""
    order = np.lexsort((key, -score, window))
    w, c = window[order], copies[order]
    before = np.cumsum(c) - c
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, dtype=int)
    before -= np.repeat(before[first], np.diff(np.append(first, len(w))))
    return order[before < k]


def _search(asked: DataFrame, rows: DataFrame, same: bool, k: int, turns: dict[int, np.ndarray], key_kind: str) -> DataFrame:
    """anchor_id, anchor_row, slot, id, copies, score: each window's k best rows of the anchor's label, or of any other.

    ``asked``: anchors with ``windows``, an array of (slot, low, high).
    """
    part = F.col("label").cast("long") if same else F.lit(0).cast("long")
    spread = lambda df: df.withColumn("width", F.size("v")).withColumn("part", part)
    on, data, asks = ["width", "part"], spread(rows), spread(asked)
    grid = data.groupBy(*on).agg(F.count("*").alias("n")).join(asks.groupBy(*on).agg(F.count("*").alias("m")), on)
    upper = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    grid = materialize(grid.withColumn("blocks", upper("n", _DATA)).withColumn("slices", upper("m", _ASKS)), "grid")
    nth = lambda m, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.col(m)).cast("int")
    data = join_hot(data, grid.drop("m"), on).where("blocks is not null").withColumn("block", nth("blocks", "row"))
    asks = join_hot(asks.withColumn("id", F.col("anchor_id")), grid.drop("n"), on, "m").where("blocks is not null")
    asks = materialize(asks.withColumn("slice", nth("slices", "slice")).withColumn("home", nth("blocks", "home")), "asks")
    sent = data.select(*on, "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "label", "v", "copies")
    kind = f"anchor_id {key_kind}, anchor_row long, slot int, id {key_kind}, copies long, score long"

    def solve(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"anchor_id": [], "anchor_row": [], "slot": [], "id": [], "copies": [], "score": []})
        width = len(mine["v"].iloc[0])
        cuts = sorted({min(width, max(1, width // part)) for part in (8, 4, 2, 1)})
        found = []
        for at in range(0, len(mine), _ANCHORS):
            some = mine.iloc[at : at + _ANCHORS].reset_index(drop=True)
            a = _Side(some["v"], turns.get(width), width, cuts)
            lists = [list(w) for w in some["windows"]]
            first = np.cumsum([0, *map(len, lists)])[:-1]
            many = np.array([len(w) for w in lists])
            slot, low, high = (np.array([w[c] for own in lists for w in own], dtype=np.int64) for c in ("slot", "low", "high"))
            least = low.copy()
            held = [np.zeros(0, dtype=np.int64) for _ in range(4)]  # window, score, place in theirs, copies
            for begin in range(0, len(theirs), _ROWS):
                rows_ = theirs.iloc[begin : begin + _ROWS]
                x = _Side(rows_["v"], turns.get(width), width, cuts)
                fit = some["id"].to_numpy()[:, None] != rows_["id"].to_numpy()[None, :]
                fit &= (some["label"].to_numpy()[:, None] == rows_["label"].to_numpy()[None, :]) == same
                i, j, _ = survivors(a, x, cuts, np.minimum.reduceat(least, first), np.maximum.reduceat(high, first), fit)
                score = _exact(a.v, x.v, i, j)
                each = np.repeat(np.arange(len(i)), many[i])
                window = np.repeat(first[i] - np.cumsum(many[i]) + many[i], many[i]) + np.arange(len(each))
                ok = (score[each] >= least[window]) & (score[each] <= high[window])
                each, window = each[ok], window[ok]
                new = (window, score[each], begin + j[each], rows_["copies"].to_numpy()[j[each]])
                held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
                keep = _best(held[0], held[1], theirs["id"].to_numpy()[held[2]], held[3], k)
                held = [h[keep] for h in held]
                full = np.bincount(held[0], weights=held[3], minlength=len(slot)) >= k
                worst = np.full(len(slot), _MOST)
                np.minimum.at(worst, held[0], held[1])
                least = np.where(full, np.maximum(low, worst), low)
            owner = np.repeat(np.arange(len(some)), many)[held[0]]
            found.append(pd.DataFrame({"anchor_id": some["anchor_id"].to_numpy()[owner], "anchor_row": some["anchor_row"].to_numpy()[owner], "slot": slot[held[0]], "id": theirs["id"].to_numpy()[held[2]], "copies": held[3], "score": held[1]}))
        return pd.concat(found)

    def met(asks: DataFrame, sent: DataFrame) -> DataFrame:
        mine = asks.select(*_UNIT, *_ANCHOR, "id", "label", "v", "windows")
        return mine.groupBy(*_UNIT).cogroup(sent.select(*_UNIT, "id", "label", "v", "copies").groupBy(*_UNIT)).applyInPandas(solve, kind)

    first = materialize(_kept(met(asks.withColumn("block", F.col("home")), sent), k), "home-pass")
    full = first.groupBy(*_ANCHOR, "slot").agg(F.when(F.sum("copies") >= k, F.min("score")).alias("kth"))
    full = full.groupBy(*_ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("known"))  # at most a window's slots
    others = asks.where("blocks > 1").join(full, _ANCHOR, "left")
    others = others.withColumn("windows", F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), F.greatest(w["low"], F.col("known")[w["slot"]]).alias("low"), w["high"].alias("high"))))
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> home")
    return materialize(_kept(first.unionByName(met(others, sent.where("blocks > 1"))), k), "found")


def _kept(found: DataFrame, k: int) -> DataFrame:
    """Each window's k best of what its blocks returned."""
    order = W.partitionBy(*_ANCHOR, "slot").orderBy(F.desc("score"), "id", "copies").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).where(F.col("before") < k).drop("before")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``found`` with a row for each copy and ``rank`` in its window."""
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(W.partitionBy(*_ANCHOR, "slot").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    A score is the inner product of two rows' ``floor(scale * component)``; higher ones come
    first, ties by smaller key. For each row for which ``anchor`` holds, its positives are its
    first other rows of the same (integer) label; for each of them the first rows of other labels whose
    score is ``low`` to ``high`` per cent of the positive's are returned, fewer if there are fewer.

    Rows with a null key, label or vector, or a null or non-finite component, take no part.
    Rows of the anchor's own key are none of its candidates; other keys' rows count each, also
    equal ones. Equal anchor rows are one anchor, different ones of one key have results of their
    own. Only vectors of one length are compared; a score beyond 64 bits is the nearest 64-bit
    integer. Other columns may have any name. Without anchors or rows the result is empty.
    """
    key_kind = rows.schema[key].dataType.simpleString()
    item = F.struct(F.col(key).alias("id"), F.col(label).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = quantized(rows.select(item.alias("item"), F.col(vector).alias("vector")), "item", "vector", scale)
    own = own.select("id.id", "id.label", "id.anchor", "v").where("id is not null and label is not null")
    own = materialize(own.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor"), F.count("*").alias("copies")), "labelled-vectors")
    turns = rotations(own)
    anchors = own.where("anchor").select(F.col("id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor_row"), "label", "v")
    window = lambda slot, a, b: F.struct(slot.cast("int").alias("slot"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    any_score = F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_MOST)))
    best = _ranked(_search(anchors.withColumn("windows", any_score), own, True, positives, turns, key_kind), positives)
    exact = F.col("score").cast("decimal(20,0)")
    best = best.select(*_ANCHOR, F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high"))
    best = materialize(best.where("low <= high"), "positives")
    asked = best.groupBy(*_ANCHOR).agg(F.collect_list(window(F.col("slot"), F.col("low"), F.col("high"))).alias("windows"))  # at most `positives` each
    found = _ranked(_search(anchors.join(asked, _ANCHOR), own, False, negatives, turns, key_kind), negatives)
    out = found.join(best, [*_ANCHOR, "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
