"""Quality classifier by co-training of a text view and a metadata view.

Two additive logistic models see disjoint parts of a document: what its text looks
like, and what is recorded about it (source, language, stated size). In each round
each of them goes over all unlabelled documents and labels for the other one some of
those that it is sure of. Held-out labels then calibrate both, and a final logistic
model combines the two log odds.

Texts are read once: ``featured`` writes their numbers, which the rounds and the final
scores read. What is fitted on is bounded (``bound`` labelled keys and ``confident``
pseudo-labels for each class, view and round); what it is chosen from is not.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, labelled_sample, materialize, whole_rows

_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_DIGITS = str.maketrans("", "", "0123456789")
_ENDS = str.maketrans("", "", ".!?,;:")
TEXT_FEATURES = ("words", "mean_chars", "symbols", "digits", "marks", "capitals", "all_capitals", "non_ascii", "distinct", "top_word", "dup_lines", "line_words", "long_words", "adjacent")
META_FEATURES = ("stated_chars",)


def text_features(text: str | None) -> list[float]:
    """Numbers about the whole text; all zero for null and empty ones."""
    if not text:
        return [0.0] * len(TEXT_FEATURES)
    words = text.split()
    n, chars = max(len(words), 1), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    heads = [w[0] for w in words]
    upper = "".join(heads)
    letters = sum(map(len, words))
    return [
        np.log1p(len(words)),
        letters / n,
        (chars - len(text.translate(_SYMBOLS))) / n,
        (chars - len(text.translate(_DIGITS))) / chars,
        (chars - len(text.translate(_ENDS))) / n,
        sum(map(str.isupper, upper)) / n,
        sum(map(str.isupper, words)) / n,
        (len(text.encode("utf-8", "replace")) - chars) / chars,
        len(counts) / n**0.9,
        max(counts.values(), default=0) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        sum(1 for w in counts if len(w) > 14) / max(len(counts), 1),
        sum(map(operator.eq, words, words[1:])) / n,
    ]


@dataclass
class View:
    """An additive logistic model over quantile bins of numbers and hashed categories."""

    bins: int = 10
    buckets: int = 64
    l2: float = 2.0
    edges: list[np.ndarray] | None = None
    weights: np.ndarray | None = None

    def _design(self, numbers: np.ndarray, cats: np.ndarray) -> np.ndarray:
        """Column numbers of the active features of each row."""
        cols, at = [np.zeros((len(numbers), 1), dtype=np.int64)], 1
        for j, e in enumerate(self.edges or []):
            cols.append((np.searchsorted(e, numbers[:, j], side="left") + at)[:, None])
            at += self.bins + 2
        for j in range(cats.shape[1]):
            cols.append((cats[:, j] % self.buckets + at)[:, None])
            at += self.buckets
        return np.hstack(cols), at

    def fit(self, numbers: np.ndarray, cats: np.ndarray, y: np.ndarray) -> View:
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([np.quantile(numbers[:, j], cuts), np.quantile(numbers[y == 0, j], [0.25, 0.75]) if (y == 0).any() else []])) for j in range(numbers.shape[1])]
        cols, width = self._design(numbers, cats)
        x = np.zeros((len(y), width))
        np.put_along_axis(x, cols, 1.0, axis=1)
        w = np.zeros(width)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + self.l2 * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + self.l2 * np.eye(width), grad)
            w -= step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w
        return self

    def log_odds(self, numbers: np.ndarray, cats: np.ndarray) -> np.ndarray:
        cols, _ = self._design(numbers, cats)
        return np.clip(self.weights[cols].sum(axis=1), -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _bucket(value: str | None) -> int:
    return zlib.crc32(("\0" if value is None else value).encode("utf-8", "replace"))


@dataclass
class CoTrained:
    text: View
    meta: View
    text_cal: np.ndarray
    meta_cal: np.ndarray
    both: np.ndarray

    def scores(self, text_x: np.ndarray, meta_x: np.ndarray, cats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros((len(text_x), 0), dtype=np.int64)
        a = self.text_cal[0] + self.text_cal[1] * self.text.log_odds(text_x, none)
        b = self.meta_cal[0] + self.meta_cal[1] * self.meta.log_odds(meta_x, cats)
        c = self.both[0] + self.both[1] * a + self.both[2] * b
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(a), p(b), p(c)


@dataclass
class Rows:
    """Feature rows: numbers of the text view, numbers and categories of the metadata view, and a mark of them all."""

    text_x: np.ndarray
    meta_x: np.ndarray
    cats: np.ndarray
    mark: np.ndarray

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Rows:
        return cls(frame[_TEXT].to_numpy(dtype=float), frame[["chars"]].to_numpy(dtype=float), frame[["c1", "c2"]].to_numpy(dtype=np.int64), frame["mark"].to_numpy(dtype=np.int64))

    def view(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.text_x, np.zeros((len(self.text_x), 0), dtype=np.int64)) if k == 0 else (self.meta_x, self.cats)


def sure_rows(frame: pd.DataFrame, views: Sequence[View], taken: Sequence[set[int]], most: int, sure: float) -> pd.DataFrame:
    """Of rows that a view is sure of, those of the ``most`` smallest marks for each view and class, equal rows once.

    The column ``grp`` is twice the view that labels plus the class. ``taken[k]`` holds
    the marks that view ``k`` has learned from.
    """
    if not len(frame):
        return frame.assign(grp=pd.Series(dtype=np.int32))
    rows, out = Rows.of(frame), []
    for k in (0, 1):
        odds = views[k].log_odds(*rows.view(k))
        fresh = ~np.isin(rows.mark, np.fromiter(taken[1 - k], dtype=np.int64, count=len(taken[1 - k])))
        for label, hit in ((0, odds < -sure), (1, odds > sure)):
            own = frame[hit & fresh].drop_duplicates("mark").nsmallest(most, "mark")
            out.append(own.assign(grp=np.int32(2 * k + label)))
    return pd.concat(out)


def co_train(known: Rows, y: np.ndarray, confident: Callable[[Sequence[View], Sequence[set[int]]], pd.DataFrame], rounds: int = 4) -> CoTrained | None:
    """Co-train from labelled rows. None if a class has no labelled row.

    ``confident(views, taken)`` gives what each view labels for the other in a round:
    feature rows with ``grp`` as in ``sure_rows``.
    """
    if not (y == 1).any() or not (y == 0).any():
        return None
    # A fifth of the labels is kept for calibration.
    held = np.arange(len(y)) % 5 == 0
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = train = np.ones(len(y), dtype=bool)
    else:
        train = ~held
    own = [[(*(p[train] for p in known.view(k)), y[train].astype(float))] for k in (0, 1)]  # what each view learns from
    taken: list[set[int]] = [set(), set()]

    def views() -> list[View]:
        return [View().fit(*(np.concatenate(p) for p in zip(*own[k], strict=True))) for k in (0, 1)]

    for _ in range(rounds):
        frame = confident(views(), taken)
        for k in (0, 1):
            mine = frame[frame["grp"] // 2 == 1 - k].sort_values(["grp", "mark"])
            if len(mine):
                own[k].append((*Rows.of(mine).view(k), (mine["grp"] % 2).to_numpy(dtype=float)))
                taken[k] |= set(mine["mark"].tolist())
    final = views()
    yh = y[held].astype(float)
    a, b = (final[k].log_odds(*known.view(k))[held] for k in (0, 1))
    text_cal, meta_cal = _logistic(a[:, None], yh), _logistic(b[:, None], yh)
    za, zb = text_cal[0] + text_cal[1] * a, meta_cal[0] + meta_cal[1] * b
    return CoTrained(*final, text_cal, meta_cal, _logistic(np.stack([za, zb], axis=1), yh))


_TEXT = [f"f{i}" for i in range(len(TEXT_FEATURES))]
_COLUMNS = [*_TEXT, "chars", "c1", "c2", "mark"]
_KINDS = ", ".join([f"{c} double" for c in [*_TEXT, "chars"]] + [f"{c} long" for c in ("c1", "c2", "mark")])


def _marks(values: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    out = np.zeros(len(values), dtype=np.uint64)
    for column in np.ascontiguousarray(values, dtype=np.float64).view(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _numbers(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, source, lang, chars in parts:
        x = np.array([text_features(t) for t in text], dtype=float).reshape(len(text), len(TEXT_FEATURES))
        out = pd.DataFrame(x, columns=_TEXT)
        out["chars"] = np.log1p(np.maximum(chars.fillna(0).to_numpy(dtype=float), 0))
        out["c1"] = np.array([_bucket(s) for s in source], dtype=np.int64)
        out["c2"] = np.array([_bucket(s) for s in lang], dtype=np.int64)
        out["mark"] = _marks(out.to_numpy(dtype=float))
        yield out
    give_back()


def featured(docs: DataFrame, carry: Sequence[str] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", chars: str = "n_chars") -> DataFrame:
    """``docs`` written with the numbers of both views: ``row`` (the columns ``carry``, or all), own_key and the features.

    Columns of ``docs`` may have any name: they stay apart in ``row``. Null and empty
    texts have all-zero text features, null metadata is a category of its own, and a
    null or negative stated size counts as 0.
    """
    row = whole_rows(docs if carry is None else docs.select(*[f"`{c}`" for c in carry]))
    numbers = F.pandas_udf(_numbers, _KINDS).asNondeterministic()  # else a later filter would run it once more
    rows = docs.select(row.alias("row"), F.col(key).alias("own_key"), numbers(F.col(text), F.col(source), F.col(lang), F.col(chars).cast("double")).alias("x"))
    return materialize(rows.select("row", "own_key", "x.*"), "features")


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", bound: int = 12_000, confident: int = 150, rounds: int = 4, sure: float = 2.2, key: str = "doc_id") -> CoTrained | None:
    """Co-train on ``rows`` (of ``featured``) and the labels of their keys.

    Labelled rows are those of at most ``bound`` keys, the ones with the smallest hashes
    (of a repeated key's rows the one with the smallest numbers). In each round all rows
    whose key has no label are candidates; of those that a view is ``sure`` of (log
    odds), it labels the ``confident`` ones with the smallest hashes in each class, equal
    rows once. Reruns and other partitionings agree. Null keys and labels don't count.
    None if a class has no labelled row.
    """
    narrow = rows.select("own_key", *_COLUMNS)
    sample = labelled_sample(narrow, labels, label, bound, key)
    known = sample.groupBy("own_key").agg(F.min(F.struct(*_COLUMNS, "own_label")).alias("r")).select("own_key", "r.*").toPandas()  # a row a key
    if not len(known):
        return None
    known = known.sort_values("own_key", kind="stable")
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("own_key")).distinct()
    free = materialize(narrow.join(marked, "own_key", "left_anti").select(*_COLUMNS), "unlabelled")

    def surest(views: Sequence[View], taken: Sequence[set[int]]) -> pd.DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for part in parts:
                own = sure_rows(part, views, taken, confident, sure)
                best = own if best is None else pd.concat([best, own]).drop_duplicates(["grp", "mark"]).sort_values(["grp", "mark"]).groupby("grp").head(confident)
            if best is not None:
                yield best

        found = free.mapInPandas(run, f"{_KINDS}, grp int").dropDuplicates(["grp", "mark"])
        nth = F.row_number().over(W.partitionBy("grp").orderBy("mark"))  # each task sends at most `confident` a group
        return found.withColumn("nth", nth).where(F.col("nth") <= confident).drop("nth").toPandas()

    return co_train(Rows.of(known), known["own_label"].to_numpy(), surest, rounds)


def score(rows: DataFrame, model: CoTrained | None, threshold: float = 0.35) -> DataFrame:
    """Per row of ``featured``: row, text_score, meta_score, score (probability of good quality), kept.

    Repeated rows get the same score. Without a model (no labels of one class) scores
    are null and everything is kept. An empty table gives an empty one.
    """
    if model is None:
        null = F.lit(None).cast("double")
        return rows.select("row", null.alias("text_score"), null.alias("meta_score"), null.alias("score"), F.lit(True).alias("kept"))

    @F.pandas_udf("text_score double, meta_score double, score double")
    def judged(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in parts:
            own = Rows.of(pd.concat(columns, axis=1, keys=_COLUMNS))
            a, b, c = model.scores(own.text_x, own.meta_x, own.cats)
            yield pd.DataFrame({"text_score": a, "meta_score": b, "score": c})

    out = rows.select("row", judged.asNondeterministic()(*_COLUMNS).alias("s")).select("row", "s.*")
    return out.withColumn("kept", F.col("score") >= threshold)
