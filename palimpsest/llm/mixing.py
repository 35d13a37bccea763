"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``cap``. Among all rates whose expected
words meet each source's target, the ones of largest entropy relative to equal
rates are exponentially tilted: ``rate = cap / (1 + exp(-lambda_s * x) (cap - 1))``
with ``x`` the document's size in units of its source's mean size. ``lambda_s``
minimises the convex dual; Newton steps, kept within a bracket that shrinks, find
it for all sources at once. A step is one aggregation over (source, size, count),
which holds all documents exactly but is far smaller than they are.

Rates become whole copies by systematic sampling down the sizes within blocks, so
the words taken follow the expected words closely and a rerun takes the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, whole_rows, word_count

_STEPS, _TOLERANCE, _BLOCK, _STARTS, _RUN = 100, 1e-9, 2048, 32, 1024


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (1 + F.exp(F.least(-lam * x, F.lit(700.0))) * (cap - 1))


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def source_targets(hist: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: size_sum, target. ``hist``: source, size, n.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``cap`` times its source's size, and
    what is above is shared again by weight among the rest. The level at which that
    ends comes from running sums over the sources in order of capacity by weight.
    """
    sums = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))  # one row for each source
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    sums = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    sums = sums.withColumn("room", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    sums = sums.withColumns({
        "full": F.coalesce(F.sum("room").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
        "all": F.sum("source_size").over(W.partitionBy()) * float(share),
    })
    # The level of the first source that it does not fill holds for all after it.
    level = (F.col("all") - F.col("full")) / F.col("open")
    sums = sums.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("null"), "source", "level"))).over(W.partitionBy())
    sums = sums.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
    return sums.select("source", "source_size", F.least(F.col("room"), F.col("weight") * F.col("level")).alias("target"))


def tilts(hist: DataFrame, targets: DataFrame, cap: float, name: str = "tilt") -> DataFrame:
    """``targets`` with ``lam`` and ``mean`` of each source (lam null: rate 0 or ``cap`` throughout)."""
    spark = hist.sparkSession
    means = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.join(means, targets["source"].eqNullSafe(means["source"])).drop(means["source"])
    fill = F.try_divide("target", "source_size")
    inner = (F.col("source_size") > 0) & (fill > 1e-12) & (fill < cap * (1 - 1e-12))
    state = materialize(state.select("*", F.when(inner, F.lit(0.0)).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(1.0).alias("off")), name)
    for step in range(_STEPS):
        s = state.alias("s")
        h = hist.where("size > 0").alias("h")
        x, lam = F.col("h.size") / F.col("s.mean"), F.col("s.lam")
        rate = _rate(lam, x, cap)
        slope = rate * (1 - rate / cap)  # d rate / d (lam x)
        words = F.col("h.size") * F.col("h.n")
        sums = (
            h.join(s.where("lam is not null"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("of"))
            .agg(_exact_sum(words * rate).alias("got"), _exact_sum(words * x * slope).alias("bend"))
        )
        nxt = state.join(sums, state["source"].eqNullSafe(sums["of"]) & state["lam"].isNotNull(), "left")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(gap, F.col("bend"))
        # A step out of the bracket is replaced: by its middle, or by a doubling while one end is still open.
        middle = F.when((high < 1e9) & (low > -1e9), (low + high) / 2).otherwise(F.when(gap < 0, F.greatest(F.col("lam") * 2, F.lit(1.0))).otherwise(F.least(F.col("lam") * 2, F.lit(-1.0))))
        bad = (F.col("bend") <= 0) | (newton <= low) | (newton >= high) | (F.abs(newton - F.col("lam")) > 4 + F.abs(F.col("lam"))) | newton.isNull() | F.isnan(newton)
        new = F.when(F.col("lam").isNull() | (F.col("off") <= _TOLERANCE) | F.col("got").isNull(), F.col("lam")).otherwise(F.when(bad, middle).otherwise(newton))
        nxt = nxt.select("source", "source_size", "target", "mean", new.alias("lam"), low.alias("low"), high.alias("high"), F.coalesce(F.try_divide(F.abs(gap), F.col("target")), F.lit(0.0)).alias("off"))
        state = materialize(nxt, f"{name}{step}")
        left = state.agg(F.max("off").alias("off")).first()["off"] or 0.0
        if left <= _TOLERANCE:
            return state
    raise RuntimeError(f"entropy balancing did not converge in {_STEPS} steps: a source is off its target by {left:.3g} of it")


def runs_of(rows: DataFrame, same: Sequence[str], most: int = _RUN) -> DataFrame:
    """Rows that agree in all of ``same`` as runs of at most ``most``: ``same``, part (number of the run), n (its rows).

    Counting comes before any sort, so rows that repeat, whatever share of the table they
    hold, are never gathered: their runs are dealt like other rows.
    """
    counts = rows.groupBy(*same).agg(F.count("*").alias("all"))
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / most))))
    return parts.withColumn("n", F.least(F.lit(most).cast("long"), F.col("all") - F.col("part") * most)).drop("all")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per document: key, size (words), source_size, target, rate, copies, taken (words).

    With ``carry`` these columns of ``docs`` come as the struct ``row`` beside them; keep
    them small, as rows are sorted. Other columns of ``docs`` may have any name.

    A null text has size 0, a null source is a source of its own. Documents of size 0
    take no part in balancing and are taken once if their source's target is above 0
    or the source has no words. Repeated rows are separate documents that are counted
    and dealt out in runs, so neither one id, nor null ids, nor one row on a large share
    of the table makes a large task. An empty table gives an empty one. Reruns agree.
    """
    row = [whole_rows(docs.select(*[f"`{c}`" for c in carry])).alias("row")] if carry else []
    rows = materialize(docs.select(F.col(key).alias("own_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *row), "sizes")
    hist = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    state = tilts(hist, source_targets(hist, weights, share, cap), cap)
    blocks = hist.groupBy("source").agg(F.ceil(F.sum("n") / _BLOCK).alias("blocks"))
    state = state.join(blocks.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "low", "high", "off")
    state = state.withColumnRenamed("source", "of")
    # One row for each source: Spark broadcasts it while it is under the size threshold, else joins by shuffle.
    rows = runs_of(rows, ["source", "own_key", "size", *(["row"] if carry else [])]).join(state, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNotNull(), _rate(F.col("lam"), F.col("size") / F.col("mean"), cap))
    rate = F.coalesce(rate, F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0))
    same = ["own_key", *(["row"] if carry else [])]
    rows = rows.withColumns({"rate": rate, "block": F.pmod(F.xxhash64("size", "part", *same), F.col("blocks"))})
    order = W.partitionBy("source", "block").orderBy(F.desc("size"), F.xxhash64("own_key"), *same, "part")
    upto = F.sum(F.col("rate") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = materialize(rows.withColumn("upto", upto), "rates")

    def copies(start: Column, first: Column, last: Column) -> Column:
        """Copies of a run's rows after its ``first`` up to its ``last``: the whole numbers that their rates pass."""
        place = lambda i: F.floor(F.col("upto") - F.col("rate") * (F.col("n") - i) + start + 1e-9)
        return place(last) - place(first)

    # Of the evenly spaced starts, each block takes the one whose words come nearest to the expected ones.
    starts = [(k + 0.5) / _STARTS for k in range(_STARTS)]
    took = [F.sum(F.col("size") * copies(F.lit(u), F.lit(0), F.col("n"))) for u in starts]
    off = [F.struct(F.abs(t - _exact_sum(F.col("size") * F.col("rate") * F.col("n"))).alias("off"), F.lit(u).alias("start")) for t, u in zip(took, starts, strict=True)]
    best = rows.groupBy(F.col("source").alias("of"), F.col("block").alias("nth")).agg(F.array_min(F.array(*off))["start"].alias("start"))
    rows = rows.join(best, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nth")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    own = copies(F.col("start"), F.col("i") - 1, F.col("i"))
    rows = rows.withColumn("copies", F.least(F.greatest(own, F.lit(0)), F.lit(cap)).cast("int"))
    return rows.select(F.col("own_key").alias(key), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if carry else []))
