"""Exact top-k search by a Voronoi kNN join on inner products.

1. Pivots are taken from the data by hash, their number grows with the root of its
   size up to a bound; every vector goes to the cell of its nearest pivot, every query
   to the cell of the pivot with which it has the largest product.
2. Summaries: for each cell its number of vectors, radius and largest norm, a few rows
   for each pivot. For a pivot ``p`` and a vector ``v`` of its cell, no product ``q v``
   exceeds ``q p + |q| |v - p|`` or ``|q| |v|``.
3. A first pass searches each query in its own cell, which gives a score that its k-th
   best can't be below. A query is then sent only to cells whose bound reaches that
   score, and of a cell only vectors far enough from its pivot are sent.
4. Small cells share a block and crowded ones are several, so a task has a bounded
   number of vectors and queries. A vector is sent once in each pass, and again only
   for each further slice of queries. Blocks are solved locally with exact integers;
   the best k of all remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

_PIVOTS, _QUERY_BLOCK, _DATA_BLOCK, _CHUNK, _LIMIT = 1024, 8192, 4096, 512, 1 << 53


def quantized(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v) with v = floor(scale * component) as longs; null vectors and those with
    null or non-finite components are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = df.select(F.col(key).alias("id"), x.alias("x")).where("x is not null and id is not null").where(~F.coalesce(F.exists("x", bad), F.lit(True)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column]) if len(column) else np.zeros((0, width), dtype=np.int64)


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where no sum can leave its exact range,
    by integers of any size (then the nearest 64-bit one) where a sum could leave 64 bits."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(d.astype(np.float64)).max(initial=0)) * max(q.shape[1], 1)
    if most < _LIMIT:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ d.T
    return np.clip(q.astype(object) @ d.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0))


def topk(queries: DataFrame, data: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pivots: int = _PIVOTS) -> DataFrame:
    """query_id, rank (from 1), key, score: each query's k best by integer inner product.

    Ties go to the smaller key; a query's own key is no candidate. Null vectors and those
    with null or non-finite components take no part. Vectors of each length are searched
    among their own, one search a length.
    Pairs are of rows: each row of a repeated key is a candidate, and the rows of a
    repeated query key share one ranking.
    A query with fewer than k candidates gets all of them. An empty side gives an empty
    result. Scores are exact; one beyond 64 bits is given as the nearest 64-bit integer,
    as is a component. Other columns may have any name.
    """
    key_kind = data.schema[key].dataType.simpleString()
    # Equal rows are held once, with their number.
    d = materialize(quantized(data, key, vector, scale).groupBy("id", "v").agg(F.count("*").alias("copies")), "vectors")
    q = materialize(quantized(queries, key, vector, scale).groupBy("id", "v").agg(F.count("*").alias("copies")), "queries")
    asked = {r["width"] for r in q.select(F.size("v").alias("width")).distinct().collect()}
    counts = {r["width"]: r["n"] for r in d.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).collect()}
    pairs = [_pairs(d.where(F.size("v") == w), q.where(F.size("v") == w), w, counts[w], k, key, key_kind, pivots) for w in sorted(asked & counts.keys())]
    if not pairs:
        return data.sparkSession.createDataFrame([], f"query_id {key_kind}, rank int, {key} {key_kind}, score long")
    return _best(reduce(DataFrame.unionByName, pairs), k, key).select("query_id", "rank", key, "score")


def _best(pairs: DataFrame, k: int, key: str) -> DataFrame:
    """``pairs`` with ``rank``: the k best of each query_id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _units(sizes: dict[int, int]) -> dict[int, int]:
    """cell -> unit: cells in order share a unit while it holds at most a block of vectors."""
    out, unit, held = {}, 0, 0
    for cell in sorted(sizes):
        if held and held + sizes[cell] > _DATA_BLOCK:
            unit, held = unit + 1, 0
        out[cell] = unit
        held += sizes[cell]
    return out


def _pairs(d: DataFrame, q: DataFrame, width: int, n: int, k: int, key: str, key_kind: str, pivots: int) -> DataFrame:
    """query_id, key, score: among vectors of one length, what holds the k best pairs of each query row."""
    spark = d.sparkSession
    some = min(pivots, max(8, math.isqrt(n) // 2))
    chosen = d.orderBy(F.xxhash64("id", F.lit("pivot")), "id", "v").limit(some).collect()  # at most `pivots` rows
    distinct = sorted({tuple(r["v"]) for r in chosen})  # in one order
    points = np.array(distinct, dtype=np.int64).astype(np.float64).reshape(len(distinct), width)

    def celled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _matrix(part["v"], width).astype(np.float64)
            far = _distances(x, points)
            cell = far.argmin(axis=1)
            yield part.assign(cell=cell.astype(np.int32), far=far[np.arange(len(cell)), cell], norm=_norms(x))

    kind = f"id {key_kind}, v array<long>, copies long"
    cells = materialize(d.mapInPandas(celled, f"{kind}, cell int, far double, norm double"), "vector-cells")
    # Summaries: a row for each pivot.
    sums = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    held = sorted(sums)
    unit_of = _units({c: sums[c]["n"] for c in held})
    sizes: dict[int, int] = {}
    for c, u in unit_of.items():
        sizes[u] = sizes.get(u, 0) + sums[c]["n"]
    centres, radius, norm = points[held], np.array([sums[c]["far"] for c in held]), np.array([sums[c]["norm"] for c in held])

    def homes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            near = (_matrix(part["v"], width).astype(np.float64) @ centres.T).argmax(axis=1)
            yield part.assign(units=[[unit_of[held[i]]] for i in near], cells=[[] for _ in near], needs=[[] for _ in near])

    def reached(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _matrix(part["v"], width).astype(np.float64)
            own, at = _norms(x)[:, None], x @ centres.T
            slack = 1e-7 * (1 + own * (norm + radius)[None, :])  # rounding in the bounds only lets more through
            kth = part["kth"].astype(float).fillna(-np.inf).to_numpy()[:, None]
            ok = np.minimum(at + own * radius[None, :], own * norm[None, :]) + slack >= kth
            need = (kth - at - slack) / np.where(own > 0, own, np.inf) - 1e-7 * (1 + radius + norm)[None, :]
            need = np.where(own > 0, need, -np.inf)
            out: dict[str, list] = {"units": [], "cells": [], "needs": []}
            for row, far, home in zip(ok, need, part["units"], strict=True):
                mine = [j for j in np.flatnonzero(row) if unit_of[held[j]] != home[0]]
                out["units"].append(sorted({unit_of[held[j]] for j in mine}))
                out["cells"].append([held[j] for j in mine])
                out["needs"].append([float(far[j]) for j in mine])
            yield part[["id", "v", "copies"]].assign(**out)

    def searched(asked: DataFrame, wanted: DataFrame | None) -> DataFrame:
        """The k best pairs in each block that ``asked`` (id, v, copies, units) is sent to; ``wanted``: cell, need."""
        each = asked.select("id", "v", "copies", F.explode("units").alias("unit"))
        asks = {r["unit"]: r["n"] for r in each.groupBy("unit").agg(F.count("*").alias("n")).collect()}  # a row for each unit
        if not asks:
            return spark.createDataFrame([], f"query_id {key_kind}, {key} {key_kind}, score long")
        grid = [(u, -(-m // _QUERY_BLOCK), -(-sizes[u] // _DATA_BLOCK)) for u, m in asks.items()]
        grid = spark.createDataFrame(grid, "unit int, slices int, blocks int")  # at most as many rows as pivots
        of_cell = spark.createDataFrame([(c, u) for c, u in unit_of.items()], "cell int, unit int")
        sent = cells.join(F.broadcast(of_cell), "cell").join(F.broadcast(grid), "unit")
        if wanted is not None:
            sent = sent.join(F.broadcast(wanted), "cell").where("far >= need")
        nth = lambda m: F.pmod(F.xxhash64("id", "v"), m).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        sent = sent.select("unit", nth(F.col("blocks")).alias("block"), every(F.col("slices")).alias("slice"), "id", "v", "copies")
        each = each.join(F.broadcast(grid), "unit").select("unit", every(F.col("blocks")).alias("block"), nth(F.col("slices")).alias("slice"), "id", "v", "copies")
        on = ["unit", "block", "slice"]
        return each.groupBy(*on).cogroup(sent.groupBy(*on)).applyInPandas(solve, f"query_id {key_kind}, {key} {key_kind}, score long")

    def solve(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], key: [], "score": []}
        if len(mine) and len(theirs):
            theirs = theirs.sort_values("id")
            ids, copies, data = theirs["id"].to_numpy(), theirs["copies"].to_numpy(), _matrix(theirs["v"], width)
            for at in range(0, len(mine), _CHUNK):
                some = mine.iloc[at : at + _CHUNK]
                for own, times, row in zip(some["id"], some["copies"], _products(_matrix(some["v"], width), data), strict=True):
                    ok = np.flatnonzero(ids != own)
                    s = row[ok]
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        ok, s = ok[s >= least], s[s >= least]
                    best = np.lexsort((ids[ok], -s))[:k]
                    best = np.repeat(best, np.minimum(copies[ok][best] * times, k))[:k]
                    out["query_id"] += [own] * len(best)
                    out[key] += ids[ok][best].tolist()
                    out["score"] += s[best].tolist()
        return pd.DataFrame(out)

    at_home = materialize(q.mapInPandas(homes, f"{kind}, units array<int>, cells array<int>, needs array<double>"), "query-homes")
    first = materialize(_best(searched(at_home, None), k, key).drop("rank"), "first-pass")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asked = at_home.drop("cells", "needs").join(kth, "id", "left")
    asked = materialize(asked.mapInPandas(reached, f"{kind}, units array<int>, cells array<int>, needs array<double>"), "query-cells")
    wanted = asked.select(F.explode(F.arrays_zip("cells", "needs")).alias("w")).groupBy(F.col("w.cells").alias("cell")).agg(F.min("w.needs").alias("need"))
    return first.unionByName(searched(asked, wanted))
