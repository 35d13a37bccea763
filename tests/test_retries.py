"""Retries of summary requests against literal state machines over scripted faults."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import retries
from palimpsest.plans.retries import FLOWS, SHRINK, Reply
from palimpsest.sources import logs


class AbortError(RuntimeError):
    pass


def error(message, code="", cause=None, retryable=True, kind=RuntimeError):
    e = kind(message)
    e.code, e.retryable, e.__cause__ = code, retryable, cause
    return e


EVENTS = {
    "ok": lambda: Reply("fine"),
    "over": lambda: error("prompt is too long"),
    "gap": lambda: error("prompt is too long: 1,045 tokens > 1,000"),
    "gap2": lambda: error("prompt is too long: 95 tokens > 90"),
    "slow": lambda: error("overloaded", "RATE_LIMIT"),
    "hidden": lambda: error("failed", cause=error("later", "TIMEOUT")),
    "abort": lambda: error("stop", kind=AbortError),
    "cancel": lambda: error("stop", "CANCELLED"),
    "media": lambda: error("image", "MEDIA_TOO_LARGE"),
    "big": lambda: error("body", "REQUEST_TOO_LARGE"),
    "cut": lambda: Reply("half a", "max-tokens"),
    "blank": lambda: Reply("  \n"),
    "tool": lambda: Reply("x", kinds=("text", "tool-call")),
    "refused": lambda: error("refused"),
    "never": lambda: error("refused", retryable=False),
    "echo": lambda: Reply("prompt is too long"),
    "long": lambda: Reply("y" * 99),
}


def script(seed):
    rng = random.Random(seed)
    return [rng.choice([*EVENTS, "over", "gap", "gap2", "slow", "slow", *["ok"] * 8]) for _ in range(40)]


def plan(seed):
    """Units as (text, tokens, is a result, tie)."""
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    return [(f"s{seed}u{i}", rng.randrange(1, 40), rng.random() < 0.3, rng.choice([i, i, max(0, i - 2)])) for i in range(n)]


def literal(strategy, units, events, window, main):
    """(status, requests, texts left, waits), by a loop as a host would have it."""
    flow, units, spare = FLOWS[strategy], list(units), []
    attempt = inputs = waits = series = asked = 0
    bare = used_main = False
    delays = []
    tokens = lambda u: sum(x[1] for x in u)

    def done(status):
        return status, asked, [u[0] for u in units], delays

    def recent(limit):
        start, held = len(units), 0
        while start and held + units[start - 1][1] <= limit:
            start -= 1
            held += units[start][1]
        start = max(start, 1)
        while start < len(units) and units[start][2]:
            start += 1
        return units[start:]

    while True:
        event = events[asked]
        asked += 1
        if event == "ok" or event == "echo" and strategy != "idle_headroom":
            return done("done")
        over = event in ("over", "gap", "gap2", "echo")
        answer = event in ("cut", "blank", "tool", "long", "echo")
        n = len(units)
        if strategy == "idle_headroom":
            if not over or n < 2 or attempt + 1 >= flow.attempts:
                return done("failed")
            # Without commas "045 tokens > 1" is what is read of the first gap.
            gap = {"gap": 44, "gap2": 5}.get(event)
            drop = max(1, n // 5)
            if gap is not None:
                drop = held = 0
                while drop < n - 1 and held < gap:
                    held += units[drop][1]
                    drop += 1
            units, attempt = units[min(n - 1, max(1, drop)) :], attempt + 1
        elif strategy == "image_guard":
            if over and main and not used_main and attempt + 1 < flow.attempts:
                used_main, attempt = True, attempt + 1
            elif over and n > 1 and attempt + 1 < flow.attempts:
                units, attempt = units[min(n - 1, max(1, n // 5)) :], attempt + 1
            else:
                return done("failed")
        elif strategy == "user_tail":
            if answer or event in ("abort", "cancel"):
                return done("failed")
            if over:
                left = [u for u in units if u[3] != units[0][3]]
                if not left:
                    return done("failed")
                units, waits = left, 0
            elif waits >= flow.attempts - 1:
                return done("failed")
            else:
                delays.append(min(60_000, 200 * 2**waits))
                waits += 1
        elif strategy == "split_turn":
            if event != "slow" or attempt + 1 >= flow.attempts:
                return done("failed")
            delays.append(min(60_000, 2_000 * 2**attempt))
            attempt += 1
        elif strategy == "round_keep":
            if event in ("media", "big") and not bare:
                bare = True
            elif over and inputs < 3 and n > 2:
                gap, more = {"gap": 45, "gap2": 5}.get(event), 1
                if gap is not None:
                    more = held = 0
                    for u in reversed(units[1:]):
                        if held >= gap:
                            break
                        held += u[1]
                        more += 1
                    if more >= n - 1:
                        more = max(1, n // 2)
                stay = max(2, n - more)
                units, spare, inputs = units[:stay], units[stay:] + spare, inputs + 1
            elif series + 1 < flow.attempts and event not in ("tool", "never"):
                units, spare, inputs, bare, series = units + spare, [], 0, False, series + 1
            else:
                return done("failed")
        elif strategy == "head_tail":
            if attempt + 1 >= flow.attempts:
                return done("failed")
            asked_tokens = tokens(units)
            if (over or event == "big" and asked_tokens >= window * 0.5) and n > 1 and inputs < 3:
                window = min(window, max(1, int(asked_tokens * 0.85)))
                left = recent(int(asked_tokens * SHRINK[inputs]))
                if not left:
                    return done("failed")
                units, inputs, waits = left, inputs + 1, 0
            elif event in ("cut", "blank", "long") and n > 1:
                left = units[1:]
                while left and left[0][2]:
                    left = left[1:]
                if not left:
                    return done("failed")
                units, waits = left, 0
            elif event in ("slow", "hidden"):
                delays.append(min(32_000, 500 * 2**waits))
                waits += 1
            else:
                return done("failed")
            attempt += 1
        elif strategy == "calibrated" and not answer:
            return done("failed" if event in ("abort", "cancel") else "basic")
        else:
            return done("failed")


class Clock:
    """Time that passes only while somebody sleeps."""

    def __init__(self):
        self.now, self.slept = 1_000.0, []

    def time(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def requests(spark, plans, window=60):
    rows = [(s, [(t, t, n, tool, tie) for t, n, tool, tie in units]) for s, units in plans.items()]
    return retries.opened(spark.createDataFrame(rows, f"session_id long, units array<{retries.UNIT}>").coalesce(1), window)


@pytest.mark.parametrize("strategy", list(FLOWS))
def test_flows(spark, strategy):
    plans = {s: plan(s) for s in range(30)}
    scripts = {s: script(1000 + s) for s in plans}
    main = strategy == "image_guard"

    def ask(session, number, prompt):
        said = EVENTS[scripts[session][number]]()
        if isinstance(said, Exception):
            raise said
        return said

    clock = Clock()
    out, answers = retries.summarize(requests(spark, plans), ask, strategy, ask if main else None, max_chars=50, clock=clock.time, sleep=clock.sleep)
    got = {r.session_id: r for r in out.collect()}
    log = {}
    for r in answers.orderBy("session_id", "number").collect():
        log.setdefault(r.session_id, []).append(r)
    seen = set()
    for s, units in plans.items():
        status, asked, texts, delays = literal(strategy, units, scripts[s], 60, main)
        r = got[s]
        assert (r.status, r.asked, [u.text for u in r.units]) == (status, asked, texts), (s, scripts[s][:asked])
        assert [x.number for x in log[s]] == list(range(asked)) and log[s][-1].status == status
        assert (r.summary is not None) == (status == "done") and (r.error is not None) == (status != "done")
        waited = [b.due - a for a, b in zip([1_000_000, *[x.due for x in log[s]]], log[s], strict=False) if b.due > a]
        assert len(waited) == len(delays)
        seen |= {status, *(["waited"] if delays else [])}
    assert "done" in seen and len(seen) > 1
    if any(r.status == "open" for r in got.values()):
        raise AssertionError("a request was left open")


def test_delays_and_their_spread(spark):
    clock, plans = Clock(), {1: plan(1)}

    def ask(session, number, prompt):
        if number < 4:
            raise error("overloaded", "RATE_LIMIT")
        return "fine"

    for strategy, base, low, high in (("user_tail", 200, 0.9, 1.1), ("head_tail", 500, 1.0, 1.25)):
        clock.slept.clear()
        out, answers = retries.summarize(requests(spark, plans), ask, strategy, clock=clock.time, sleep=clock.sleep)
        assert out.first().summary == "fine" and answers.count() == 5
        assert all(low * base * 2**k - 1 <= 1000 * t <= high * base * 2**k + 1 for k, t in enumerate(clock.slept)) and len(clock.slept) == 4
        assert any(abs(1000 * t - base * 2**k) > 2 for k, t in enumerate(clock.slept))


def test_answers_are_asked_for_once(spark, tmp_path):
    def ask(session, number, prompt):
        with open(tmp_path / f"{session}-{number}", "a") as f:
            f.write("x")
        if number == 0 and session % 2:
            raise error("prompt is too long")
        return f"{number} {prompt}"

    out, answers = retries.summarize(requests(spark, {s: plan(s) for s in range(8)}), ask, "idle_headroom")
    for _ in range(2):
        out.collect(), answers.collect()  # reading again asks nothing again
    assert {p.read_text() for p in tmp_path.iterdir()} == {"x"} and len(list(tmp_path.iterdir())) == answers.count()
    empty, none = retries.summarize(requests(spark, {1: plan(1)}).where("false"), ask, "head_tail")
    assert empty.count() == none.count() == 0


def test_units(spark):
    call = lambda i: [("tool-call", None, i, "n", "{}", None)]
    say = lambda t: [("text", t, None, None, None, None)]
    rows = [(1, 0, "user", None, say("q"), 1), (1, 1, "assistant", None, call("a"), 2), (1, 2, "tool", "a", say("r"), 3), (1, 3, "assistant", None, call("a"), 4), (1, 4, "tool", "a", say("r2"), 5), (1, 5, "assistant", None, say("end"), 6)]
    df = spark.createDataFrame(rows, "session_id long, pos long, role string, tool_call_id string, blocks array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>, price long")
    df = df.withColumns({"message_id": F.col("pos").cast("string"), "is_error": F.lit(False), "source_kind": F.lit("x")})
    by_row = retries.units_of(df, logs.text_of(), "user_tail").first().units
    assert [(u.text, u.tokens, u.tool, u.tie) for u in by_row] == [("q", 1, False, 0), ("", 2, False, 1), ("r", 3, True, 1), ("", 4, False, 1), ("r2", 5, True, 1), ("end", 6, False, 5)]
    by_round = retries.units_of(df, logs.text_of(), "round_keep").first().units
    assert [u.tokens for u in by_round] == [1, 5, 9, 6]
