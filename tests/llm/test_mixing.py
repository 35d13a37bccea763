"""Rates of the mixture against a plain solver of the dual, and tables where one id or one row repeats."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing


def plain_tilt(sizes, target, cap=2.0):
    """The lambda at which the expected words meet the target, by bisection on the plain sum."""
    mean = sum(sizes) / len(sizes)
    rate = lambda lam, n: cap / (1 + math.exp(min(-lam * n / mean, 700.0)) * (cap - 1))
    low, high = -200.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * rate(mid, n) for n in sizes) < target else (low, mid)
    return lambda n: rate((low + high) / 2, n)


def entropy(rates, cap=2.0):
    """Of copies between 0 and ``cap``, relative to each copy taken with equal odds of 1 in ``cap``."""
    out = 0.0
    for r in rates:
        p = r / cap
        for q, prior in ((p, 1 / cap), (1 - p, 1 - 1 / cap)):
            out -= q * math.log(q / prior) if q > 0 else 0.0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rates_solve_the_dual(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 9)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    source = {i: s for i, _, s in rows}
    by = defaultdict(list)
    for r in got:
        by[source[r.doc_id]].append(r)
    bent = 0
    for own in by.values():
        sizes, target = [r["size"] for r in own], own[0].target
        if target >= 2 * sum(sizes) * (1 - 1e-9):
            assert all(r.rate == 2.0 for r in own)
            continue
        want = plain_tilt(sizes, target)
        for r in own:
            assert r.rate == pytest.approx(want(r["size"]), abs=1e-6)
        assert sum(r.rate * r["size"] for r in own) == pytest.approx(target, rel=1e-6)
        bent += max(r.rate for r in own) - min(r.rate for r in own) > 1e-3
        # No other rates with the same words have more entropy: words moved between two documents lose some.
        rates = [r.rate for r in own]
        best = entropy(rates)
        for _ in range(50):
            i, j = rng.sample(range(len(own)), 2)
            words = 0.01 * min(sizes[i], sizes[j])
            other = list(rates)
            other[i], other[j] = rates[i] + words / sizes[i], rates[j] - words / sizes[j]
            if 0 < min(other[i], other[j]) and max(other[i], other[j]) < 2:
                assert entropy(other) <= best + 1e-9
    assert bent


def test_rows_of_one_id_are_dealt_in_runs(spark):
    rows = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),  # null on a third of the rows
        F.when(F.col("id") % 3 == 1, F.lit("same words here")).otherwise(F.repeat(F.lit("w "), (F.col("id") % 90).cast("int"))).alias("text"),
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("source"),
    )
    rows = rows.unionByName(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one row often").alias("text"), F.lit("a").alias("source")))
    got = mixing.mix(rows.repartition(6)).cache()
    assert got.count() == 50_000
    want = Counter((r.doc_id, r.words) for r in rows.select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("words")).collect())
    assert Counter((r.doc_id, r["size"]) for r in got.collect()) == want
    assert got.where("copies not in (0, 1, 2) or taken <> copies * size").count() == 0
    for r in got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target
    again = mixing.mix(rows.repartition(11))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_runs_hold_every_row_once(spark):
    rows = spark.createDataFrame([("x", 5)] * 2500 + [("y", 5)] * 3 + [(None, 1)] * 1024 + [(None, 2)], "own_key string, size long")
    runs = mixing.runs_of(rows, ["own_key", "size"], 1024).collect()
    assert Counter({(r.own_key, r["size"]): sum(x.n for x in runs if (x.own_key, x["size"]) == (r.own_key, r["size"])) for r in runs}) == {("x", 5): 2500, ("y", 5): 3, (None, 1): 1024, (None, 2): 1}
    assert max(r.n for r in runs) == 1024 and len(runs) == 6 and len({(r.own_key, r["size"], r.part) for r in runs}) == 6
