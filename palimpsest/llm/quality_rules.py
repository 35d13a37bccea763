"""Quality rules: text statistics, fixed base limits, and a learned decision list.

The list is learned by sequential covering. Each rule is a conjunction of threshold
conditions, grown greedily by information gain on two thirds of the labelled rows,
pruned from its end on the other third, kept if precise enough on both, and emitted
as a branch of one ordered Spark conditional expression. Learning sees only the
numeric statistics of a bounded number of labelled rows; all texts are handled by
DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, labelled_sample, whole_rows

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WINDOW = 8
_SPACES = " \t\n\x0b\x0c\r"


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five statistics of the whole text as long columns (columns of their names are replaced).

    Null and empty texts have zeros. A text of fewer than eight words has no window.
    Repeated windows are found by hash and then counted on their exact words, so a
    hash collision changes nothing.
    """
    kept = [c for c in df.columns if c not in STATS]
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_t": t, "_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0))})
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    df = df.withColumns({"_n": F.size("_words"), "_lines": lines, "_hashes": F.transform("_words", lambda w: F.xxhash64(w))})
    windows = F.transform(F.sequence(F.lit(0), F.col("_n") - _WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(_WINDOW)]))
    df = df.withColumn("_windows", F.when(F.col("_n") >= _WINDOW, windows))
    # Windows whose hash occurs again, by one sort of (hash, place); then the exact words of only those.
    ranked = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn("_ranked", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked))
    near = lambda name, field, x, j: F.coalesce(F.get(name, j + 1)[field] == x[field], F.lit(False)) | F.coalesce(F.get(name, j - 1)[field] == x[field], F.lit(False))
    again = F.filter("_ranked", lambda x, j: near("_ranked", "h", x, j))
    df = df.withColumn("_sorted", F.array_sort(F.transform(again, lambda x: F.struct(F.concat_ws(" ", F.slice("_words", x["at"] + 1, _WINDOW)).alias("w"), x["at"].alias("at")))))
    starts = F.array_sort(F.transform(F.filter("_sorted", lambda x, j: near("_sorted", "w", x, j)), lambda x: x["at"]))
    df = df.withColumn("_starts", starts)
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-_WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(_WINDOW), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    symbols = F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))
    out = {
        "n_words": F.col("_n"),
        "word_chars": F.length(F.translate("_t", _SPACES, "")),
        "n_symbols": symbols,
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # A generated row stops later filters on the statistics from being pushed down as their whole
    # expressions, which would compute each array anew for every element of another.
    row = F.struct(*[v.cast("long").alias(k) for k, v in out.items()])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline_outer(F.array(row)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


#: What the learned conditions compare: a name and its expression over the statistics.
def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "n_dup_lines": F.col("n_dup_lines").cast("double"),
        "repeated_share": F.col("n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n or not p:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for name in x:
            values = np.searchsorted(cuts[name], x[name][inside], side="left")  # value > cut[i] iff index > i
            bads = np.bincount(values[bad[inside]], minlength=len(cuts[name]) + 1)
            goods = np.bincount(values[~bad[inside]], minlength=len(cuts[name]) + 1)
            low_p, low_n = np.cumsum(bads)[:-1], np.cumsum(goods)[:-1]
            for above, ps, ns in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = np.where(ps > 0, ps * (np.log2(np.maximum(ps, 1) / np.maximum(ps + ns, 1)) - before), -1)
                i = int(np.argmax(gain)) if len(gain) else -1
                if i >= 0 and gain[i] > best[0]:
                    best = (float(gain[i]), Condition(name, above, float(cuts[name][i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, prune_part: np.ndarray, max_rules: int = 8, max_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """The ordered rules that reject; no rule if there are no rejected rows to learn from."""
    cuts = {}
    for name, v in x.items():
        own = np.unique(v)
        middle = (own[:-1] + own[1:]) / 2
        cuts[name] = middle if len(middle) <= 256 else np.unique(np.quantile(middle, np.linspace(0, 1, 256)))
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    take = lambda part: {k: v[part] for k, v in x.items()}
    while len(rules) < max_rules and (left & bad).any():
        grow, prune = left & ~prune_part, left & prune_part
        conditions = _grow(take(grow), bad[grow], cuts, max_conditions)
        if not conditions:
            break
        held, held_bad = take(prune), bad[prune]

        def worth(k: int, own: list[Condition] = conditions, held=held, held_bad=held_bad) -> float:
            hit = Rule(tuple(own[:k])).holds(held)
            p, n = int((hit & held_bad).sum()), int((hit & ~held_bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        size = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(conditions[:size]))
        hit = rule.holds(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < least or p / (p + n) < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 20_000, key: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learn from the statistics of at most ``bound`` labelled documents (label 0: reject).

    Rows that the base limits reject are left out: the list is for the others. Of the
    rows of a repeated key, the one with the smallest statistics is learned from; null
    keys and labels are not. No labelled row or an empty table gives an empty list.
    """
    sample = labelled_sample(docs.select(F.col(key).alias("own_key"), F.col(text).alias("text")), labels, label, bound, key)
    stats = with_stats(sample).where(~base_failed())
    names = list(features())
    third = F.pmod(F.xxhash64("own_key", F.lit("prune")), F.lit(3)) == 0
    rows = stats.select("own_key", *[c.alias(n) for n, c in features().items()], (F.col("own_label") == 0).alias("bad"), third.alias("third"))
    rows = rows.groupBy("own_key").agg(F.min(F.struct(*names, "bad", "third")).alias("row")).select("row.*").collect()  # a row a key: at most `bound`
    if not rows:
        return []
    # In one order whatever the partitioning: learning depends on the set of rows only.
    data = np.array(sorted(tuple(float(r[n]) for n in [*names, "bad", "third"]) for r in rows))
    return learn_list({n: data[:, i] for i, n in enumerate(names)}, data[:, -2] > 0, data[:, -1] > 0)


def verdict(rules: Sequence[Rule]) -> Column:
    """True to keep: the ordered conditional expression of the list."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``row`` (its columns, as a struct), the statistics, ``base_failed`` and ``kept``.

    Columns of ``docs`` may have any name: they stay apart in ``row``. Null and empty
    texts fail the base limits; repeated rows are judged alike; an empty table gives an
    empty one.
    """
    rows = docs.select(whole_rows(docs).alias("row"), F.col(text).alias("text"))
    judged = with_stats(rows).drop("text")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
