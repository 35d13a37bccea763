"""Language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts with counts from the training texts. A symbol
(a byte or the end of the text) is predicted in its longest known context; if it is
new there, the escape probability (method C: one count for each distinct symbol,
plus the counts of pruned ones) is paid and the next shorter context is tried with
the symbols already refused excluded. Below the empty context all symbols left are
equally likely. The code length of a text is the sum over its symbols.

``score`` prunes nothing. The strings of ``order + 1`` symbols of all texts are counted
and each gets its log probability once, by joins with the tables of the shorter
strings (``gram_logs``). Strings with at least ``1 / nodes`` of all symbols, so at most
``nodes`` of them whatever the corpus, are broadcast and looked up while the texts are
read; the others are joined. A joined string is rarer than that, so no key is hot.

``fit`` is the bounded form in memory, for strings that no text holds: it keeps the
strings of each length whose share of all training symbols is at least ``1 / nodes``
and counts rarer ones as escapes in their context.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_END, _PAD, _BITS = 256, 257, 9
_SYMBOLS = 257  # bytes and the end
_SLICE, _NODES, _HEAD = 1 << 20, 1 << 21, 1 << 20


class _Index:
    """A hash table from distinct non-negative integers to their places in an array."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.place = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        self.mask = size - 1
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.place[slot[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), dtype=bool)
            left[put] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not there."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.place[slot], -1)
        on = np.flatnonzero((at != keys) & (at >= 0))
        while len(on):
            slot_on = (slot[on] + 1) & self.mask
            slot[on] = slot_on
            at = self.keys[slot_on]
            hit = at == keys[on]
            out[on[hit]] = self.place[slot_on[hit]]
            on = on[~hit & (at >= 0)]
        return out


@dataclass
class PpmModel:
    """strings[L]: strings of L symbols and their counts; contexts[L]: what precedes
    their last symbol, with its total, kept total and number of kept symbols."""

    order: int
    strings: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ready(self) -> _Scorer:
        if self.uid not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[self.uid] = _Scorer(self)
        return _SCORERS[self.uid]


class _Scorer:
    def __init__(self, model: PpmModel):
        self.order = model.order
        self.of_string, self.of_context = [None], [None]
        self.log, self.count, self.total, self.rare, self.kinds, self.below = [None], [None], [None], [None], [None], [None]
        for size in range(1, model.order + 2):
            keys, n = model.strings[size]
            ctx, total, kept, kinds = model.contexts[size]
            self.of_string.append(_Index(keys))
            own = _Index(ctx)
            self.of_context.append(own)
            of = own.find(keys >> _BITS)
            excluded = np.zeros(len(ctx))
            if size > 1 and len(keys):  # what the context's symbols count in the context shorter by one
                short = self.of_string[size - 1].find(keys & ((1 << _BITS * (size - 1)) - 1))
                np.add.at(excluded, of, model.strings[size - 1][1][short])
            self.below.append(excluded)
            self.count.append(n.astype(float))
            self.total.append(total.astype(float))
            self.rare.append((total - kept).astype(float))
            self.kinds.append(kinds.astype(float))
            self.log.append(np.log10(n / self._weight(size, of, 0.0, 0.0)) if len(keys) else np.zeros(0))

    def _weight(self, size: int, of: np.ndarray, mass: np.ndarray | float, kinds: np.ndarray | float) -> np.ndarray:
        """The sum of counts that a context divides: without the excluded, with one more for each symbol left."""
        new = np.where(self.kinds[size][of] == _SYMBOLS, 0.0, self.kinds[size][of] - kinds)
        return self.total[size][of] - mass + new

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each string of order + 1 symbols."""
        out = np.zeros(len(grams))
        on = np.arange(len(grams))
        mass, kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for size in range(self.order + 1, 0, -1):
            keys = grams[on] & ((1 << _BITS * size) - 1)
            at = self.of_string[size].find(keys)
            hit = at >= 0
            if size == self.order + 1:
                out[on[hit]] = self.log[size][at[hit]]
            elif hit.any():
                of = self.of_context[size].find(keys[hit] >> _BITS)
                out[on[hit]] += np.log10(self.count[size][at[hit]] / self._weight(size, of, mass[hit], kinds[hit]))
            miss = ~hit
            on, keys, mass, kinds = on[miss], keys[miss], mass[miss], kinds[miss]
            of = self.of_context[size].find(keys >> _BITS)
            known = of >= 0
            ctx = of[known]
            escape = self.rare[size][ctx] + np.where(self.kinds[size][ctx] == _SYMBOLS, 0.0, self.kinds[size][ctx] - kinds[known])
            weight = self._weight(size, ctx, mass[known], kinds[known])
            # Nothing left in a context: it refuses nothing more and costs nothing.
            out[on[known]] += np.log10(np.where(weight > 0, escape, 1.0) / np.where(weight > 0, weight, 1.0))
            mass[known], kinds[known] = self.below[size][ctx], self.kinds[size][ctx]
        left = _SYMBOLS - (self.kinds[1][0] if len(self.kinds[1]) else 0)
        out[on] -= math.log10(max(left, 1))
        return out


_SCORERS: dict[str, _Scorer] = {}


def _stream(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each after ``order`` pads and before an end, and where each begins."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + order + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(starts[-1], _PAD, dtype=np.uint16)
    for t, at in zip(texts, starts[:-1], strict=True):
        out[at + order : at + order + len(t)] = np.frombuffer(t, dtype=np.uint8)
        out[at + order + len(t)] = _END
    return out, starts


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """The string of order + 1 symbols that ends at each symbol from the order-th on."""
    wide = symbols.astype(np.int64)
    out = wide[: len(wide) - order].copy()
    for i in range(1, order + 1):
        out <<= _BITS
        out |= wide[i : len(wide) - order + i]
    return out


def _slices(symbols: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(order, len(symbols), _SLICE):
        yield at, _grams(symbols[at - order : at + _SLICE], order)


def _batches(texts: list[str | None], most: int = 1 << 22) -> Iterator[list[bytes]]:
    own, size = [], 0
    for t in texts:
        own.append((t or "").encode("utf-8", "replace"))
        size += len(own[-1])
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counted(order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for frame in frames:
            for texts in _batches(frame["own_text"].tolist()):
                symbols, _ = _stream(texts, order)
                for _, grams in _slices(symbols, order):
                    keys, n = np.unique(grams[(grams & ((1 << _BITS) - 1)) != _PAD], return_counts=True)
                    parts.append((keys, n))
                    held += len(keys)
                if held > 4_000_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 3_000_000:
                        yield pd.DataFrame({"gram": parts[0][0], "n": parts[0][1]})
                        parts, held = [], 0
        if parts:
            keys, n = _merged(parts)
            for at in range(0, len(keys), 200_000):
                yield pd.DataFrame({"gram": keys[at : at + 200_000], "n": n[at : at + 200_000]})

    return run


def fit(texts: DataFrame, order: int = 4, nodes: int = _NODES) -> PpmModel:
    """The model of the column ``own_text`` of ``texts``; null texts count as empty."""
    grams = materialize(texts.select("own_text").mapInPandas(_counted(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // nodes))
    strings, contexts = [None], [None]
    for size in range(1, order + 2):
        own = grams
        if size <= order:
            own = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << _BITS * size) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        own = materialize(own, f"grams{size}")
        kept = own.where(F.col("n") >= least).orderBy("gram").toArrow()  # at most `nodes` rows
        assert kept.num_rows <= nodes
        strings.append((kept["gram"].to_numpy().astype(np.int64), kept["n"].to_numpy().astype(np.int64)))
        good = F.col("n") >= least
        sums = own.groupBy(F.shiftright("gram", _BITS).alias("ctx")).agg(F.sum("n").alias("total"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("kept"), F.count_if(good).alias("kinds"))
        sums = sums.where("kinds > 0").orderBy("ctx").toArrow()
        contexts.append(tuple(sums[c].to_numpy().astype(np.int64) for c in ("ctx", "total", "kept", "kinds")))
    return PpmModel(order, strings, contexts)


def gram_logs(rows: DataFrame, order: int = 4) -> DataFrame:
    """gram, m, log: each string of order + 1 symbols of ``rows``, how often they hold it,
    and log10 of its last symbol's probability under all rows with ``own_train``.

    ``rows``: own_text, own_train (neither null).
    """

    def counted(part: DataFrame) -> DataFrame:
        return part.select("own_text").mapInPandas(_counted(order), "gram long, n long")

    heard = counted(rows.where("own_train")).select("gram", "n", F.col("n").alias("m"))
    other = counted(rows.where("not own_train")).select("gram", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    grams = materialize(heard.unionByName(other).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")

    def tail(size: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << _BITS * size) - 1))

    strings: dict[int, DataFrame] = {order + 1: grams.where("n > 0").select("gram", "n")}
    for size in range(order, 0, -1):
        strings[size] = materialize(strings[size + 1].groupBy(tail(size).alias("gram")).agg(F.sum("n").alias("n")), f"grams{size}")
    contexts: dict[int, DataFrame] = {}
    for size in range(order + 1, 0, -1):  # below: what the context's symbols count in the context shorter by one
        own = strings[size].withColumn("ctx", F.shiftright("gram", _BITS))
        if size > 1:
            shorter = strings[size - 1].select(F.col("gram").alias("short"), F.col("n").alias("short_n"))
            own = own.withColumn("short", tail(size - 1)).join(F.broadcast(shorter) if size <= 3 else shorter, "short")
        below = F.sum("short_n") if size > 1 else F.lit(0).cast("long")
        contexts[size] = materialize(own.groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("own_kinds"), below.alias("below")), f"contexts{size}")

    def weight(mass: Column, kinds: Column) -> Column:
        return F.col("total") - mass + F.when(F.col("own_kinds") == _SYMBOLS, F.lit(0)).otherwise(F.col("own_kinds") - kinds)

    none = F.lit(0).cast("long")
    top = grams.where("n > 0").withColumn("ctx", F.shiftright("gram", _BITS)).join(contexts[order + 1], "ctx")
    top = top.select("gram", "m", F.log10(F.col("n") / weight(none, none)).alias("log"))
    # Strings never learned: from context to shorter context, with what was refused so far.
    new = grams.where("n = 0").select("gram", "m", F.lit(0.0).alias("log"), none.alias("mass"), none.alias("kinds"), F.lit(False).alias("found"))
    for size in range(order + 1, 0, -1):
        # Tables of at most two symbols are bounded by the alphabet, and their keys may be hot.
        context = contexts[size]
        new = new.withColumn("ctx", F.shiftright(tail(size), _BITS)).join(F.broadcast(context) if size <= 3 else context, "ctx", "left").drop("ctx")
        if size <= order:
            string = strings[size].select(F.col("gram").alias("short"), F.col("n").alias("short_n"))
            new = new.withColumn("short", tail(size)).join(F.broadcast(string) if size <= 2 else string, "short", "left").drop("short")
        else:
            new = new.withColumn("short_n", F.lit(None).cast("long"))
        new = new.withColumn("w", weight(F.col("mass"), F.col("kinds")))
        hit = F.col("short_n").isNotNull()
        # Nothing left in a context: it refuses nothing more and costs nothing.
        factor = F.when(hit, F.col("short_n") / F.col("w")).when(F.col("w") > 0, (F.col("own_kinds") - F.col("kinds")) / F.col("w")).otherwise(1.0)
        on = ~F.col("found") & F.col("total").isNotNull()
        new = new.select(
            "gram",
            "m",
            F.when(on, F.col("log") + F.log10(factor)).otherwise(F.col("log")).alias("log"),
            F.when(on, F.col("below")).otherwise(F.col("mass")).alias("mass"),
            F.when(on, F.col("own_kinds")).otherwise(F.col("kinds")).alias("kinds"),
            (F.col("found") | hit).alias("found"),
        )
    left = F.greatest(F.lit(_SYMBOLS) - F.col("kinds"), F.lit(1))
    new = new.select("gram", "m", F.when(F.col("found"), F.col("log")).otherwise(F.col("log") - F.log10(left)).alias("log"))
    return materialize(top.unionByName(new), "gram-logs")


@dataclass
class _Frequent:
    """The strings that are looked up, with their log probabilities."""

    keys: np.ndarray
    logs: np.ndarray
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def ready(self) -> _Index:
        if self.uid not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[self.uid] = _Index(self.keys)
        return _INDEXES[self.uid]


_INDEXES: dict[str, _Index] = {}


def _text_sums(texts: list[bytes], order: int, index: _Index, logs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text: the sum over its strings in ``index``, and its other strings with how often it has them."""
    symbols, starts = _stream(texts, order)
    sums = np.zeros(len(texts))
    owners, others = [], []
    for at, grams in _slices(symbols, order):
        real = np.flatnonzero(symbols[at : at + len(grams)] != _PAD)
        own, grams = np.searchsorted(starts, at + real, side="right") - 1, grams[real]
        place = index.find(grams)
        hit = place >= 0
        sums += np.bincount(own[hit], weights=logs[place[hit]], minlength=len(texts))
        owners.append(own[~hit])
        others.append(grams[~hit])
    own, grams = np.concatenate(owners), np.concatenate(others)
    order_by = np.lexsort((grams, own))
    own, grams = own[order_by], grams[order_by]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])])) if len(own) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.concatenate([first, [len(own)]]))
    cuts = np.searchsorted(own[first], np.arange(1, len(texts)))
    return sums, np.split(grams[first], cuts), np.split(n, cuts)


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[bytes] = Counter()
    for frame in frames:
        for t in frame["own_text"]:
            counts.update((t or "").encode("utf-8", "replace").lower().split())
            if len(counts) > 1_000_000:
                yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})
                counts.clear()
    if counts:
        yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 4, nodes: int = _NODES, head: int = _HEAD) -> DataFrame:
    """Per row: key, trained (whether it was learned from), n_tokens, n_known, train_tokens,
    base_score, score.

    ``score`` is the model's log10 probability of the whole text's UTF-8 bytes and its
    end. ``base_score`` is that of a smoothed unigram model over lower-cased (A-Z) words
    and an end. Null and empty texts consist of their end. Without any training row
    every symbol is equally likely and ``train_tokens`` is 0. Repeated rows are scored
    alike; a null key is allowed.

    Words with at least ``1 / head`` of all training tokens, at most ``head`` of them,
    are looked up in a broadcast table, the others by a join; so are strings of symbols
    with at least ``1 / nodes`` of all symbols. Neither number changes a score.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("own_key"), F.coalesce(F.col(text), F.lit("")).alias("own_text"), F.coalesce(train, F.lit(True)).alias("own_train"))
    learned = rows.where("own_train")
    grams = gram_logs(rows, order)
    symbols = grams.agg(F.sum("m")).first()[0] or 0
    often = F.col("m") >= max(1, -(-symbols // nodes))
    kept = grams.where(often).orderBy("gram").toArrow()  # at most `nodes` rows
    assert kept.num_rows <= nodes
    frequent_grams = _Frequent(kept["gram"].to_numpy().astype(np.int64), kept["log"].to_numpy().astype(float))
    words = materialize(learned.select("own_text").mapInPandas(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    ends = learned.count()
    total, distinct = sums["c"] + ends, sums["v"] + (1 if ends else 0)
    weight = total + 0.1 * (distinct + 1)
    frequent = words.where(F.col("c") >= max(1, -(-total // head))).toArrow()
    assert frequent.num_rows <= head
    logs = dict(zip((w.encode() for w in frequent["word"].to_pylist()), np.log10((frequent["c"].to_numpy() + 0.1) / weight).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((frequent_grams, logs))
    end_log = math.log10((ends + 0.1) / weight)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = shared.value
        index = table.ready()
        for frame in frames:
            out: dict[str, list] = {"n_tokens": [], "known": [], "base": [], "rare": [], "rare_n": []}
            scores: list[float] = []
            others: dict[str, list] = {"grams": [], "grams_n": []}
            for texts in _batches(frame["own_text"].tolist()):
                sums, rest, rest_n = _text_sums(texts, order, index, table.logs)
                scores += sums.tolist()
                others["grams"] += rest
                others["grams_n"] += rest_n
                for t in texts:
                    counts = Counter(t.lower().split())
                    base, hits, n, rare, rare_n = end_log, 1 if ends else 0, 1, [], []
                    for w, c in counts.items():
                        n += c
                        v = known.get(w)
                        if v is None:
                            rare.append(w.decode())
                            rare_n.append(c)
                        else:
                            base += c * v
                            hits += c
                    for name, v in zip(out, (n, hits, base, rare, rare_n), strict=True):
                        out[name].append(v)
            yield pd.DataFrame({"own_key": frame["own_key"], "own_train": frame["own_train"], "score": scores, **out, **others})

    schema = f"own_key {kind}, own_train boolean, score double, n_tokens long, known long, base double, rare array<string>, rare_n array<long>, grams array<long>, grams_n array<long>"
    # Written once: the row numbers hold for all reads below.
    done = materialize(rows.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = done.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("t")).select("row", F.col("t.rare").alias("word"), F.col("t.rare_n").alias("n"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(words, "word", "left").select("row", (F.col("n") * F.log10((c + 0.1) / F.lit(float(weight)))).alias("more"), F.when(F.col("c").isNotNull(), F.col("n")).alias("more_known"), F.lit(0.0).alias("more_score"))
    rest = done.select("row", F.explode(F.arrays_zip("grams", "grams_n")).alias("t")).select("row", F.col("t.grams").alias("gram"), F.col("t.grams_n").alias("n"))
    rest = rest.join(grams.where(~often).select("gram", "log"), "gram").select("row", F.lit(0.0).alias("more"), F.lit(None).cast("long").alias("more_known"), (F.col("n") * F.col("log")).alias("more_score"))
    more = rare.unionByName(rest).groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more", "more_known", "more_score")])
    out = done.drop("rare", "rare_n", "grams", "grams_n").join(more, "row", "left")
    return out.select(
        F.col("own_key").alias(key),
        F.col("own_train").alias("trained"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
