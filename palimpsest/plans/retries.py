"""Summary requests in Spark rounds: what is due is asked, answers are written, each strategy decides what comes next.

No task waits: a request that has to wait has a due time, and the driver starts the
next round when the first one is due. A round's answers stand in a table of the shared
folder before anything is made of them, so a lost executor repeats at most the requests
that its tasks had not written yet, under the same number. What follows an answer is a
table of conditions and changes for each strategy, evaluated as expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import faults
from ..functions.text import response_fault, token_gap, u16len
from ..operators import graph, state, structure
from ..sources import logs
from ..sources.scratch import materialize


@dataclass(frozen=True)
class Reply:
    """A model's answer: its text, how it ended, and the kinds of its blocks."""

    text: str
    finish: str = "stop"
    kinds: tuple[str, ...] = ("text",)


@dataclass(frozen=True)
class Flow:
    """How a strategy asks: by ``rounds`` of a mode or by rows, how often, and how it waits."""

    rounds: str | None = None
    attempts: int = 1
    base_ms: int = 0
    cap_ms: int = 0
    low: float = 1.0
    high: float = 1.0


# Attempts, delays and their spread of each strategy, and the shares to which ``head_tail`` shrinks a request.
FLOWS = {
    "idle_headroom": Flow("message", 4),
    "user_tail": Flow(None, 6, 200, 60_000, 0.9, 1.1),
    "turn_tail": Flow(),
    "split_turn": Flow(None, 4, 2_000, 60_000),
    "image_guard": Flow("pending", 4),
    "round_keep": Flow("assistant", 3),
    "head_tail": Flow(None, 5, 500, 32_000, 1.0, 1.25),
    "calibrated": Flow(),
}
SHRINK = (0.7, 0.5, 0.35)

UNIT = "struct<text:string,plain:string,tokens:bigint,tool:boolean,tie:bigint>"
#: What is known of a request. ``units``: what it holds, oldest first; ``spare``: what was put back to the kept history.
STATE = {
    "units": f"array<{UNIT}>", "spare": f"array<{UNIT}>", "asked": "int", "attempt": "int", "inputs": "int", "waits": "int", "series": "int",
    "bare": "boolean", "main": "boolean", "window": "bigint", "due": "bigint", "status": "string", "summary": "string", "error": "string",
}
_CHAIN = "array<struct<code:string,message:string,name:string>>"
Ask = Callable[[object, int, str], "str | Reply"]


def units_of(selected: DataFrame, text: Column, strategy: str, plain: Column | None = None) -> DataFrame:
    """session_id, units: each session's selected rows (or their rounds) as parts of a request.

    ``plain`` is a part's text without media, ``text`` itself unless given. Parts that
    must go together share a ``tie``, the place of the first row tied to them by calls.
    """
    mode = FLOWS[strategy].rounds
    rows = selected if mode is None else structure.rounds(selected, mode)
    rows = rows.select("session_id", "pos", (F.col("round") if mode else F.col("pos")).alias("unit"), F.col("price").cast("long").alias("price"), (F.col("role") == "tool").alias("tool"), text.alias("text"), (text if plain is None else plain).alias("plain"))
    if strategy == "user_tail":
        steps = structure.call_events(selected).select("session_id", "pos", "call_id")
        hubs = steps.groupBy("session_id", "call_id").agg(F.min("pos").alias("v"))
        tied = graph.components(steps.join(hubs, ["session_id", "call_id"]).select("session_id", F.col("pos").alias("u"), "v"))
        rows = rows.join(tied.withColumnRenamed("node", "pos"), ["session_id", "pos"], "left").withColumn("tie", F.coalesce("root", "pos")).drop("root")
    else:
        rows = rows.withColumn("tie", F.col("pos"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "\n\n").alias(c)
    own = rows.groupBy("session_id", "unit").agg(lines("text"), lines("plain"), F.sum("price").alias("tokens"), F.min("tool").alias("tool"), F.min("tie").alias("tie"))
    every = F.array_sort(F.collect_list(F.struct("unit", "text", "plain", "tokens", "tool", "tie")))
    fields = ("text", "plain", "tokens", "tool", "tie")
    return own.groupBy("session_id").agg(F.transform(every, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("units"))


def opened(units: DataFrame, window: int | Column = 0) -> DataFrame:
    """A request for each session, to be asked at once."""
    zero, window = F.lit(0), window if isinstance(window, Column) else F.lit(window)
    start = {"units": F.col("units"), "spare": F.array(), "asked": zero, "attempt": zero, "inputs": zero, "waits": zero, "series": zero, "bare": F.lit(False), "main": F.lit(False), "window": window, "due": zero, "status": F.lit("open"), "summary": F.lit(None), "error": F.lit(None)}
    return units.select("session_id", *[v.cast(STATE[k]).alias(k) for k, v in start.items()])


def _answers(due: DataFrame, ask: Ask, main: Ask | None) -> DataFrame:
    """session_id, text, finish, kinds, chain (null without an error), retryable: what the model says to each request."""
    session = due.schema["session_id"].dataType.simpleString()
    texts = F.transform("units", lambda u: F.when(F.col("bare"), u["plain"]).otherwise(u["text"]))
    prompt = F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for session_id, number, text, own in zip(part["session_id"], part["asked"], part["prompt"], part["main"], strict=True):
                try:
                    said = (main if own and main is not None else ask)(session_id, int(number), text)
                    said = said if isinstance(said, Reply) else Reply(said or "")
                    out.append((session_id, said.text, said.finish, list(said.kinds), None, True))
                except Exception as e:  # noqa: BLE001  whatever the model raises is data here
                    chain = [{"code": c, "message": m, "name": n} for c, m, n in faults.causes_of(e)]
                    out.append((session_id, None, None, None, chain, bool(getattr(e, "retryable", True))))
            yield pd.DataFrame(out, columns=["session_id", "text", "finish", "kinds", "chain", "retryable"])

    asked = due.select("session_id", "asked", "main", prompt.alias("prompt"))
    return asked.mapInPandas(call, f"session_id {session}, text string, finish string, kinds array<string>, chain {_CHAIN}, retryable boolean")


def _total(units: Column) -> Column:
    return F.aggregate(units, F.lit(0).cast("long"), lambda a, u: a + u["tokens"])


def _covering(units: Column, tokens: Column, most: Column) -> Column:
    """How many units from the first on hold ``tokens``, at most ``most``."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"))
    more = lambda a, u: F.when((a["held"] < tokens) & (a["n"] < most), F.struct((a["held"] + u["tokens"]).alias("held"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(units, start, more)["n"]


def _recent(units: Column, tokens: Column) -> Column:
    """The longest run of last units within ``tokens``; one goes if all fit, and results at its head go."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"), F.lit(True).alias("on"))
    more = lambda a, u: F.struct(F.when(a["on"] & (a["held"] + u["tokens"] <= tokens), a["held"] + u["tokens"]).otherwise(a["held"]).alias("held"), F.when(a["on"] & (a["held"] + u["tokens"] <= tokens), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (a["held"] + u["tokens"] <= tokens)).alias("on"))
    kept = F.least(F.aggregate(F.reverse(units), start, more)["n"], F.size(units) - 1)
    return _without_results(_last(units, kept))


def _last(units: Column, n: Column) -> Column:
    return F.slice(units, F.size(units) - n + 1, n)


def _without_results(units: Column) -> Column:
    """From the first unit on that is no result."""
    first = F.array_position(F.transform(units, lambda u: F.coalesce(u["tool"], F.lit(False))), F.lit(False))
    return F.when(first > 0, F.slice(units, first.cast("int"), F.size(units))).otherwise(F.slice(units, 1, 0))


def following(strategy: str, now: int, attempts: int | None = None, base_ms: int | None = None, fallback: bool = False, overhead: int = 0, max_chars: int | None = None, seed: int = 0) -> dict[str, Column]:
    """The new state of requests that were answered: columns of ``STATE`` and of the answer are at hand.

    ``fallback``: whether there is a main model to fall back to; ``overhead``: tokens that
    a request has besides its units.
    """
    flow = FLOWS[strategy]
    most, base = attempts or flow.attempts, flow.base_ms if base_ms is None else base_ms
    c = {k: F.col(k) for k in STATE}
    units, n, text = c["units"], F.size("units"), F.coalesce("text", F.lit(""))
    requested = _total(units) + overhead
    raised = F.col("chain").isNotNull()
    # What is wrong with an answer, as an error of its own.
    fault = response_fault(F.coalesce("finish", F.lit("stop")), F.coalesce("kinds", F.array(F.lit("text"))), text)
    if max_chars is not None:
        fault = F.coalesce(fault, F.when(u16len(text) > max_chars, "truncated"))
    full = F.coalesce(F.col("finish").rlike("(?i)context.*(exceed|overflow)"), F.lit(False)) if strategy in ("round_keep", "head_tail") else F.lit(False)
    # The codes by which faulty answers are known.
    code = F.when(full, "CONTEXT_WINDOW_EXCEEDED").when(fault == "truncated", "MAX_TOKENS").when(fault == "empty", "EMPTY_RESPONSE").when(fault.isNotNull(), "INVALID_SUMMARY")
    own = F.when(code.isNotNull(), F.array(F.struct(code.alias("code"), F.concat(F.lit("summary "), F.coalesce(fault, F.lit("overflow"))).alias("message"), F.lit("").alias("name"))))
    if strategy == "idle_headroom":  # an answer that only repeats the error
        said = F.array(F.struct(F.lit("").alias("code"), text.alias("message"), F.lit("").alias("name")))
        own = F.when(faults.fault_class(strategy, said) == "overflow", said).otherwise(own)
    chain = F.coalesce("chain", own).cast(_CHAIN)
    known = faults.fault_class(strategy, chain, requested, c["window"], named=True)
    message = F.coalesce(F.element_at(chain, 1)["message"], F.lit(""))
    is_ = lambda name: F.coalesce(known == name, F.lit(False))
    again = F.coalesce("retryable", F.lit(True)) & (raised | (code != "INVALID_SUMMARY"))
    delay = state.backoff_ms(c["waits"], base, flow.cap_ms)
    due = F.lit(now) + (delay if flow.low == flow.high else F.least(state.jittered(delay, flow.low, flow.high, seed), F.lit(flow.cap_ms if flow.high <= 1.1 else int(flow.cap_ms * flow.high))))

    def changed(**new: Column) -> Column:
        return F.struct(*[new.get(k, c[k]).cast(kind).alias(k) for k, kind in ({"asked": "int"} | STATE).items()])

    next_, left = c["attempt"] + 1, F.lit(0)
    more = next_ < most
    fifth = F.greatest(F.lit(1), F.floor(n * 0.2).cast("int"))
    drop = lambda k: F.slice(units, k + 1, n)
    waited = {"due": due, "waits": c["waits"] + 1}
    rules: list[tuple[Column, Column]] = []
    if strategy == "idle_headroom":
        gap = token_gap(message)
        k = F.when(gap.isNull(), fifth).otherwise(_covering(units, gap, n - 1))
        rules = [(is_("overflow") & (n > 1) & more, changed(units=drop(F.greatest(F.lit(1), F.least(k, n - 1))), attempt=next_))]
    elif strategy == "image_guard":
        rules = [
            (is_("overflow") & F.lit(fallback) & ~c["main"] & more, changed(main=F.lit(True), attempt=next_)),
            (is_("overflow") & (n > 1) & more, changed(units=drop(F.least(fifth, n - 1)), attempt=next_)),
        ]
    elif strategy == "user_tail":
        rest = F.filter(units, lambda u: u["tie"] != F.element_at(units, 1)["tie"])
        rules = [
            (~raised | is_("terminal"), changed(status=F.lit("failed"), error=message)),
            (is_("overflow") & (F.size(rest) > 0), changed(units=rest, waits=left)),
            (~is_("overflow") & (c["waits"] < most - 1), changed(**waited)),
        ]
    elif strategy == "split_turn":
        rules = [(is_("transient") & more, changed(attempt=next_, **waited))]
    elif strategy == "round_keep":
        gap = token_gap(message, commas=True)
        covered = _covering(F.reverse(F.slice(units, 2, n)), gap, n - 1)
        k = F.when(gap.isNull(), F.lit(1)).when(covered >= n - 1, F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(covered)
        stay = F.greatest(F.lit(2), n - k)
        rules = [
            (is_("media") & ~c["bare"], changed(bare=F.lit(True))),
            (is_("overflow") & (c["inputs"] < 3) & (n > 2), changed(units=F.slice(units, 1, stay), spare=F.concat(_last(units, n - stay), "spare"), inputs=c["inputs"] + 1)),
            (again & (c["series"] + 1 < most), changed(units=F.concat("units", "spare"), spare=F.array(), inputs=left, bare=F.lit(False), series=c["series"] + 1)),
        ]
    elif strategy == "head_tail":
        share = F.element_at(F.array(*map(F.lit, SHRINK)), F.least(c["inputs"], F.lit(len(SHRINK) - 1)) + 1)
        fewer = _recent(units, F.floor(_total(units) * share))
        behind = _without_results(F.slice(units, 2, n))
        smaller = F.least(c["window"], F.greatest(F.lit(1), F.floor(requested * 0.85)))
        shrink, shift = is_("overflow") & (n > 1) & (c["inputs"] < len(SHRINK)), faults.has_code(chain, "MAX_TOKENS|EMPTY_RESPONSE") & (n > 1)
        rules = [
            (~more, changed(status=F.lit("failed"), error=message)),
            (shrink & (F.size(fewer) == 0), changed(status=F.lit("failed"), error=message)),
            (shrink, changed(units=fewer, window=smaller, inputs=c["inputs"] + 1, waits=left, attempt=next_)),
            (shift & (F.size(behind) == 0), changed(status=F.lit("failed"), error=message)),
            (shift, changed(units=behind, waits=left, attempt=next_)),
            (faults.transient(strategy, chain), changed(attempt=next_, **waited)),
        ]
    elif strategy == "calibrated":
        rules = [(raised & ~is_("cancelled"), changed(status=F.lit("basic"), error=message))]
    out = F.when(chain.isNull(), changed(status=F.lit("done"), summary=F.col("text")))
    for condition, new in rules:
        out = out.when(condition, new)
    out = out.otherwise(changed(status=F.lit("failed"), error=message))
    return {"state": out, "fault": F.when(chain.isNotNull(), F.coalesce(known, F.lit("other")))}


def summarize(
    requests: DataFrame,
    ask: Ask,
    strategy: str,
    main: Ask | None = None,
    attempts: int | None = None,
    base_ms: int | None = None,
    overhead: int = 0,
    max_chars: int | None = None,
    clock: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(requests with ``status``, ``summary`` and ``error``; session_id, number, fault, status, parts, tokens, due of every answer).

    ``ask(session_id, number, prompt)`` is the model; a request's numbers count from 0.
    ``requests`` is what ``opened`` gives. A request ends ``done``, ``failed``, or ``basic``,
    where the strategy falls back to a checkpoint without a model.
    """
    now = lambda: int(clock() * 1000)
    every = materialize(requests, "requests")
    answered: list[DataFrame] = []
    while True:
        due = every.where("status = 'open'").agg(F.min("due")).first()[0]
        if due is None:
            break
        if due > now():
            sleep((due - now()) / 1000)
        asked = every.where((F.col("status") == "open") & (F.col("due") <= max(now(), due)))
        said = materialize(_answers(asked, ask, main), "answers")
        new = following(strategy, now(), attempts, base_ms, main is not None, overhead, max_chars, seed + len(answered))
        met = every.join(said.withColumn("_said", F.lit(True)), "session_id", "left").withColumns({"_new": F.when(F.col("_said"), new["state"]), "_fault": F.when(F.col("_said"), new["fault"])})
        met = materialize(met.select("session_id", *[F.when(F.col("_said"), F.col(f"_new.{k}")).otherwise(F.col(k)).alias(k) for k in STATE if k != "asked"], (F.col("asked") + F.when(F.col("_said"), 1).otherwise(0)).cast("int").alias("asked"), "_said", "_fault"), "requests")
        answered.append(met.where("_said").select("session_id", (F.col("asked") - 1).alias("number"), F.col("_fault").alias("fault"), "status", F.size("units").alias("parts"), _total(F.col("units")).alias("tokens"), F.col("due")))
        every = met.select("session_id", *STATE)
    none = every.where("false").select("session_id", F.lit(0).alias("number"), F.lit("").alias("fault"), "status", F.lit(0).alias("parts"), F.lit(0).cast("long").alias("tokens"), "due")
    return every, reduce(DataFrame.unionByName, answered) if answered else none
