"""Each preset's selection, context sizes, fitting and kept texts against plain walks over lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import faults
from palimpsest.operators import lookups, selection, state, structure, usage
from palimpsest.plans import compaction, presets, restoration, strategies
from palimpsest.sources import logs

from .test_engine import random_log


def spans_of(rows):
    out, own = [], []
    for i, r in enumerate([*rows, None]):
        if r is None or r["role"] == "system":
            if any(not x["cp"] for x in own):
                out.append(own)
            own = []
        else:
            own.append({**r, "at": i})
    return out


def open_after(rows):
    pending, out = set(), []
    for r in rows:
        pending |= set(r["calls"])
        pending.discard(r["result"])
        out.append(len(pending))
    return out


def rounds_of(rows, mode):
    out, last, before = [], None, 0
    for r, after in zip(rows, open_after(rows), strict=True):
        new = r["role"] == "assistant" and (mode == "assistant" or before == 0)
        if new and mode == "message":
            new = last != r["id"]
        if r["role"] == "assistant":
            last = r["id"]
        if new and out:
            out.append([])
        elif not out:
            out.append([])
        out[-1].append(r)
        before = after
    return out


def prefix(rows):
    ends = [i + 1 for i, n in enumerate(open_after(rows)) if n == 0]
    return rows[: ends[-1]] if ends else []


def total(rows):
    return sum(r["price"] for r in rows)


def walk_recent(rows, keep, mode):
    for span in spans_of(rows):
        done = prefix(span)
        if len(done) < 2:
            continue
        need, groups, kept = max(0, keep - total(rows[done[-1]["at"] + 1 :])), rounds_of(done, mode), 0
        while groups and kept < need:
            kept += total(groups.pop())
        out = [r for g in groups for r in g]
        if len(out) >= 2:
            return out
    return []


def walk_turn_tail(rows, keep):
    size = lambda part: (sum(4 * r["price"] for r in part) + max(len(part) - 1, 0) + 4) // 4
    for span in spans_of(rows):
        after = [0, *open_after(span)]
        starts = [i for i, r in enumerate(span) if r["role"] == "user" and not r["cp"]]
        kept, used = len(span), 0
        for start, end in reversed(list(zip(starts, [*starts[1:], len(span)] if starts else [], strict=True))):
            own = size(span[start:end])
            if used + own <= keep and after[start] == 0:
                used, kept = used + own, start
                continue
            kept = next((i for i in range(start + 1, end) if after[i] == 0 and span[i]["role"] != "tool" and size(span[i:end]) <= keep - used), kept)
            break
        out = span[: kept or len(span)]
        if any(not r["cp"] for r in out):
            return out
    return []


def walk_kept_rounds(rows, keep):
    for span in spans_of(rows):
        groups = rounds_of(span, "assistant")
        n = min(1, len(groups) - 1)
        held = total([r for g in (groups[-n:] if n else groups) for r in g])
        while n < len(groups) - 1 and held < keep:
            n += 1
            held += total(groups[len(groups) - n])
        out = prefix([r for g in groups[: len(groups) - n] for r in g])
        if len(rounds_of(out, "assistant")) >= 2 and any(r["role"] == "assistant" for r in out):
            return out
    return []


WALKS = {
    "idle_headroom": lambda rows, keep: walk_recent(rows, keep, "message"),
    "image_guard": lambda rows, keep: walk_recent(rows, keep, "pending"),
    "turn_tail": walk_turn_tail,
    "round_keep": walk_kept_rounds,
    "head_tail": lambda rows, keep: next(iter(spans_of(rows)), []),
}


def logged(spark, seed, n=40):
    df, plain = random_log(spark, seed, n)
    df = df.withColumn("source_form", F.lit(None).cast("string")).withColumn("json_len", F.col("price") * 4).withColumn("message_id", F.concat(F.lit("m"), F.floor(F.col("pos") / 3).cast("string")))
    for rows in plain.values():
        for r in rows:
            r["id"] = f"m{r['pos'] // 3}"
    return df, plain


@pytest.mark.parametrize("name", sorted(WALKS))
@pytest.mark.parametrize("keep", [0, 120])
def test_selection(spark, name, keep):
    df, plain = logged(spark, 21)
    got = sorted((r.session_id, r.pos) for r in presets.SELECT[name](df, keep).collect())
    want = sorted((s, r["pos"]) for s, rows in plain.items() for r in WALKS[name](rows, keep))
    assert got == want and got


def test_every_preset_selects_balanced_rows(spark):
    df, plain = logged(spark, 5, 60)
    assert set(presets.SELECT) == set(strategies.STRATEGIES)
    for name, select in presets.SELECT.items():
        rows = select(df, 50).collect()
        by_session = {}
        for r in rows:
            by_session.setdefault(r.session_id, []).append(r.pos)
        for s, places in by_session.items():
            places.sort()
            assert places == list(range(places[0], places[-1] + 1)), name
            assert all(plain[s][p]["role"] != "system" for p in places), name


def test_run_for_every_preset(spark):
    df, _ = logged(spark, 9, 60)
    df = df.withColumns({"is_error": F.coalesce("is_error", F.lit(False)), "tool_name": F.lit(None).cast("string")})
    sessions = df.select("session_id").distinct().select("session_id", F.lit(40_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    settings = strategies.config(reserve_tokens=39_900 - 13_000, threshold_ratio=0.01)
    for name in strategies.STRATEGIES:
        new, verdicts = compaction.run(df, sessions, name, F.col("price") * 100, 50, lambda p: "short", settings=settings)
        rows = verdicts.collect()
        assert rows and all(r.accepted == (r.tokens < r.old_tokens) for r in rows), name
        assert new.where(structure.checkpoint()).count() >= sum(r.accepted for r in rows), name
    files = spark.createDataFrame([("p", "file body")], "path string, text string")
    new, verdicts = compaction.run(df, sessions, "idle_headroom", F.col("price") * 100, 50, lambda p: "short", settings=settings, files=files)
    done = verdicts.where("accepted").select("session_id")
    given = new.where(structure.checkpoint()).join(done, "session_id", "left_semi").where(F.exists("blocks", lambda b: b["text"] == "short"))
    assert given.select("session_id").distinct().count() == done.count() > 0

    def picky(prompt):
        if len(prompt) > 120:
            raise RuntimeError("prompt is too long")
        return "short"

    _, verdicts = compaction.run(df, sessions, "image_guard", F.col("price") * 100, 50, picky, settings=settings)
    assert verdicts.count() > 0
    changed = df.withColumn("seq", F.when(F.col("session_id") % 2 == 0, F.col("seq") + 1).otherwise(F.col("seq")))
    _, verdicts = compaction.run(df, sessions, "head_tail", F.col("price") * 100, 50, lambda p: "short", settings=settings, latest=changed)
    assert {r.session_id % 2 for r in verdicts.collect()} == {1}


def test_context_after_answers_of_several_rows(spark):
    """What is later than the anchor begins after the first row of its message id and leaves out its own rows."""
    df, plain = logged(spark, 33, 50)
    used = F.struct(F.lit(1000).cast("long").alias("input"), F.lit(10).cast("long").alias("output"), F.lit(5).cast("long").alias("cache_read"), F.lit(None).cast("long").alias("cache_write"), F.lit(None).cast("long").alias("total"))
    df = df.withColumns({"usage": F.when((F.col("role") == "assistant") & (F.col("pos") % 2 == 0), used), "finish": F.lit("stop")})
    got = {r.session_id: r.tokens for r in usage.context_size(df, "floored").collect()}
    for s, rows in plain.items():
        at = max((i for i, r in enumerate(rows) if r["role"] == "assistant" and r["pos"] % 2 == 0), default=None)
        if at is None:
            assert got[s] == total(rows)
            continue
        first = at
        for i in range(at - 1, -1, -1):
            if rows[i]["role"] == "assistant" and rows[i]["id"] != rows[at]["id"]:
                break
            if rows[i]["id"] == rows[at]["id"]:
                first = i
        assert got[s] == 1015 + total([r for r in rows[first + 1 :] if r["id"] != rows[at]["id"]])


def test_fit_rows(spark):
    note = "[Earlier assistant/tool activity omitted to fit the summary request]"
    rng, rows = random.Random(4), []
    for s in range(30):
        for i in range(rng.randrange(1, 14)):
            size = rng.randrange(0, 600)
            rows.append((s, i, i // 3, rng.random() < 0.3, "x" * size, "x" * min(size, 256)))
    df = spark.createDataFrame(rows, "session_id long, idx long, grp long, user boolean, text string, short string")
    for available in (1, 150, 400, 5000):
        got = {(r.session_id, r.idx): (r.text, r.fits) for r in selection.fit_rows(df, available).collect()}
        for s in range(30):
            own = [r for r in rows if r[0] == s]
            line = [r[4] for r in own]
            fits = lambda line=None: max(1, -(-len("\n\n".join(line)) // 3)) <= available
            if not fits(line):
                line = [r[5] for r in own]
            for g in sorted({r[2] for r in own}):
                if fits(line):
                    break
                places = [k for k, r in enumerate(own) if r[2] == g]
                if places[0] == 0 or any(own[k][3] for k in places):
                    continue
                for k in places:
                    line[k] = note if k == places[0] else ""
            assert [got[s, r[1]] for r in own] == [(t, fits(line)) for t in line]


def test_basic_checkpoint_and_branch(spark):
    call = lambda name, args: [("tool-call", None, "c", name, args, None)]
    say = lambda t: [("text", t, None, None, None, None)]
    rows = [
        (1, 0, "user", "compact-checkpoint", say("old summary")), (1, 1, "user", "user", say("do it")), (1, 2, "assistant", "model", say("first")), (1, 3, "assistant", "model", call("Read", '{"path": "a.py"}')),
        (1, 4, "user", "note", say("a reminder")), (1, 5, "assistant", "model", call("bash", '{"command": "ls"}')), (1, 6, "assistant", "model", say("second")), (1, 7, "assistant", "model", say("third")), (1, 8, "assistant", "model", say("fourth")),
    ]
    blocks = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
    df = spark.createDataFrame(rows, f"session_id long, pos long, role string, source_kind string, blocks {blocks}")
    df = df.withColumns({"seq": F.col("pos"), "message_id": F.concat(F.lit("m"), F.col("pos")), "tool_call_id": F.lit(None).cast("string"), "is_error": F.lit(False), "price": F.lit(100).cast("long")})
    summary, kept = compaction.basic_checkpoint(df, df.where("pos < 8"))
    assert [r.text for r in kept.orderBy("ord").collect()] == ["old summary", "[User request]\ndo it", "[Recorded context]\na reminder", "[Recent assistant response]\nsecond", "[Recent assistant response]\nthird"]
    text = summary.first().summary
    assert "- a.py" in text and "## Tool commands\n- ls" in text
    wanted = df.select("session_id", "seq", F.col("pos").alias("ord"))
    out = compaction.branch_summaries(df, wanted, lambda p: "went well", 500).first()
    assert out.rows == 5 and out.tokens == 500 and "went well" in out.summary and "<read-files>\na.py" in out.summary
    with pytest.raises(Exception, match="missing"):
        compaction.branch_summaries(df, wanted.withColumn("seq", F.col("seq") + 100), lambda p: "x", 500).collect()


def test_kept_users(spark):
    rows = [(1, i, "user", "user", [("text", f"{i}" * 40, None, None, None, None)], f"m{i}", 10) for i in range(10)]
    blocks = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
    df = spark.createDataFrame(rows, f"session_id long, pos long, role string, source_kind string, blocks {blocks}, message_id string, price long").withColumn("seq", F.col("pos"))
    got = [r.text for r in presets.retained_users(df, df, 25).orderBy("ord").collect()]
    assert [t.split("\n")[0] for t in got] == [f"[Retained user message {i}]" for i in (1, 2, 3)]
    assert got[1].endswith("8" * 40) and got[2].endswith("9" * 40) and "tokens truncated" in got[0]
    got = [r.text for r in presets.head_and_tail_users(df, df, 45, 15).orderBy("ord").collect()]
    assert got == ["0" * 40, "1" * 20, "[Earlier user messages were left out here]", "7" * 40, "8" * 40, "9" * 40]
    assert [r.text for r in presets.head_and_tail_users(df, df, 100).orderBy("ord").collect()] == [f"{i}" * 40 for i in range(10)]


def test_faults(spark):
    chain = [("", "outer"), ("PROMPT_TOO_LONG", "inner")]

    def classify(name, chain):
        for kind, code, message in faults.FAULTS[name]:
            for c, m in chain if name in faults.FOLLOWS_CAUSES else chain[:1]:
                if code and re.search(code, c, re.I) or message and re.search(message, m, re.I):
                    return kind
        return None

    assert classify("head_tail", chain) == "overflow" and classify("round_keep", chain) is None
    assert classify("split_turn", [("", "Rate limit: quota used up")]) == "terminal"
    cases = [[("REQUEST_TOO_LARGE", "x")], [("", "context window exceeded")], [("", "socket closed")], [("ABORTED", "x")], [("", "x"), ("SERVER", "y")], []]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i long, chain array<struct<code:string,message:string>>")
    for name in faults.FAULTS:
        got = {r.i: r.f for r in df.select("i", faults.fault_class(name, F.col("chain")).alias("f")).collect()}
        assert got == {i: classify(name, c) for i, c in enumerate(cases)}, name
    sized = df.where("i = 0").select(faults.fault_class("head_tail", F.col("chain"), F.lit(60), F.lit(100)).alias("a"), faults.fault_class("head_tail", F.col("chain"), F.lit(40), F.lit(100)).alias("b")).first()
    assert (sized.a, sized.b) == ("overflow", None)
    error = RuntimeError("outer")
    error.__cause__ = ValueError("prompt is too long")
    assert faults.causes_of(error) == [("", "outer", "RuntimeError"), ("", "prompt is too long", "ValueError")]
    stopped = spark.createDataFrame([([("", "stop", n)],) for n in ("AbortError", "MyAbort", "CancelledError", "Error")], "chain array<struct<code:string,message:string,name:string>>")
    names = [tuple(r) for r in stopped.select(*[faults.fault_class(s, F.col("chain"), named=True) for s in ("user_tail", "calibrated", "head_tail")]).collect()]
    assert names == [("terminal", "cancelled", None), (None, "cancelled", None), (None, "cancelled", None), (None, None, None)]


def test_retained_context(spark):
    rows = [(1, 0, "user", "plan-note", None, "a"), (1, 1, "user", "plan-note", None, "b"), (1, 2, "user", "user", None, "say"), (1, 3, "user", "x", "instructions", "i1"), (1, 4, "user", "x", "instructions", "i2"), (1, 5, "user", "x", None, "speech"), (1, 6, "user", "compact-checkpoint", None, "c")]
    blocks = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
    df = spark.createDataFrame([(s, p, p, r, k, f, f"m{p}", [("text", t, None, None, None, None)]) for s, p, r, k, f, t in rows], f"session_id long, pos long, seq long, role string, source_kind string, source_form string, message_id string, blocks {blocks}")
    key = lookups.with_state(df, ("snapshot", "catalog"), "plan").where("pos = 1").first().state_key
    saved = spark.createDataFrame([(1, 6, 0, "old user")], "session_id long, seq long, nth int, text string")
    context = spark.createDataFrame([(1, 6, 1, key, "saved plan")], "session_id long, seq long, nth int, state_key string, text string")
    got = [(r.what, r.text) for r in lookups.retained_state(df, saved, context).orderBy("pos", "nth").collect()]
    assert got == [("user", "say"), ("context", "i1"), ("context", "i2"), ("user", "old user"), ("context", "saved plan")]
    assert state.unchanged(state.version(df, ["seq"]), state.version(df, ["seq"])).count() == 1
