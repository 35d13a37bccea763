"""Golden values, literal walks for what SQL can't say, and the write and stream paths."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import queries as q
from palimpsest.functions import pricing, text
from palimpsest.operators import lineage, lookups, selection, state, structure
from palimpsest.plans import compaction, restoration, strategies
from palimpsest.sources import logs


def budgets(spark, window, output, **settings):
    df = spark.createDataFrame([(window, output)], "window long, output long")
    return {r.strategy: (r.trigger, r.retain) for r in strategies.budget_table(df, **settings).collect()}


def test_budgets(spark):
    names = strategies.STRATEGIES
    assert [budgets(spark, 200_000, 32_000)[s] for s in names] == [(167_000, 0), (180_000, 20_000), (168_000, 15_000), (183_616, 20_000), (167_000, 0), (166_000, 0), (150_000, 20_000), (162_000, 20_000)]
    own = budgets(spark, 200_000, 32_000, reserve=10_000, keep=1_234)
    assert [own[s] for s in names] == [(t, 1_234) for t in (177_000, 180_000, 190_000, 190_000, 170_000, 177_000, 170_000, 162_000)]
    own = budgets(spark, 200_000, 32_000, reserve=10_000, ratio=0.5, keep=1_234)
    assert [own[s][0] for s in names] == [95_000, 100_000, 95_000, 95_000, 100_000, 100_000, 100_000, 90_000]
    assert [budgets(spark, w, 8_000)["head_tail"][0] for w in (50_000, 40_000, 50_001)] == [42_500, 34_000, 1]
    assert [budgets(spark, w, o)["turn_tail"][1] for w, o in ((36_000, 32_000), (72_000, 32_000), (200_000, 32_000))] == [2_000, 10_000, 15_000]
    assert budgets(spark, 200_000, 0)["turn_tail"][0] == 168_000
    assert budgets(spark, 200_000, 32_000, reserve=0)["split_turn"][0] == 200_000
    assert budgets(spark, 131_072, 8_192, strategies=("host_native",))["host_native"] == (57_344, 19_660)


def test_config():
    assert strategies.config(keep_recent_tokens=0, threshold_ratio=1).threshold_ratio == 1
    for bad in ({"reserve": 1}, {"threshold_ratio": 0}, {"threshold_ratio": 1.5}, {"tail_turns": -1}, {"prune": 1}, {"idle_minutes": 1.5}, {"summarization_model": "m"}):
        with pytest.raises(ValueError):
            strategies.config(**bad)


def test_text_goldens(spark):
    cuts = [("abcdefghijklmno", 2, "abcd…2 tokens truncated…lmno"), ("ééééé", 1, "é…2 tokens truncated…é"), ("short", 5, "short"), ("abc", 0, "…1 tokens truncated…"), ("", 0, ""), (None, 3, None)]
    rng = random.Random(4)
    for _ in range(200):  # every width of character on both edges
        t, n = "".join(rng.choices("aé前😀", k=rng.randrange(40))), rng.randrange(9)
        front = max(i for i in range(len(t) + 1) if len(t[:i].encode()) <= 2 * n)
        back = min(i for i in range(len(t) + 1) if len(t[i:].encode()) <= 2 * n)
        size = len(t.encode())
        cuts.append((t, n, t if size <= 4 * n else f"{t[:front]}…{-(-(size - 4 * n) // 4)} tokens truncated…{t[back:]}"))
    df = spark.createDataFrame(cuts, "t string, n int, want string")
    assert df.where(~text.middle_truncate(F.col("t"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0
    for t, _, _ in cuts[6:]:
        price = lambda x: -(-sum(c < "\x80" for c in x) // 4) + sum(c >= "\x80" for c in x)
        assert text.clip_weighted(t, 5) == max((t[:i] for i in range(len(t) + 1) if price(t[:i]) <= 5), key=len)
        assert text.clip_weighted(t, 5, True) == max((t[i:] for i in range(len(t) + 1) if price(t[i:]) <= 5), key=len)
    assert text.clip_weighted("abcdefgh前前", 3) == "abcdefgh前" and text.clip_weighted("abcdefgh前前", 2, True) == "前前"
    assert text.first_object('x {no} {"a": {"b": 1}} y') == '{"a":{"b":1}}' and text.first_object("none {") is None and text.first_object(None) is None
    row = spark.range(1).select(
        text.u16len(F.lit("a😀前")).alias("u"), text.session_path(F.lit(" a b//c! ")).alias("p"),
        text.path_from_json(F.lit('{"file_path": 3, "path": "", "filePath": "z"}')).alias("z"), text.path_from_json(F.lit("{bad")).alias("bad"),
        pricing.bytes4(F.array(logs.block("image"), logs.block("image")), F.lit("user"), F.lit("")).alias("two"), pricing.bytes4(F.array(logs.block("image")), F.lit("user"), F.lit("")).alias("one"),
        pricing.block4(F.array(logs.block("text", F.lit("abcde")), logs.block("text", F.lit("a")))).alias("each"), pricing.chars4(F.array(logs.block("text", F.lit("abcde")), logs.block("text", F.lit("a")))).alias("once"),
    ).first()
    assert row.asDict() == {"u": 4, "p": "a-b-c", "z": "z", "bad": None, "two": 3687, "one": 1844, "each": 3, "once": 2}


def random_log(spark, seed, n=40, sessions=12):
    """Entries with calls, results (some unexpected), protected rows and checkpoints, as DataFrame and as plain rows."""
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for pos in range(rng.randrange(1, n)):
            role = rng.choices(["user", "assistant", "tool", "system"], [3, 4, 4, 1])[0]
            cp = role == "user" and rng.random() < 0.2
            calls = [f"c{rng.randrange(3)}" for _ in range(rng.randrange(1, 3))] if role == "assistant" and rng.random() < 0.6 else []
            rows.append((s, pos, pos, role, "compact-checkpoint" if cp else role, rng.randrange(1, 60), calls, f"c{rng.randrange(3)}" if role == "tool" else None, rng.random() < 0.3))
    blocks = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
    df = spark.createDataFrame(
        [(s, p, q_, r, "user" if k == "user" else k, pr, [("tool-call", None, c, "read", '{"path": "p"}', None) for c in calls] or [("text", "t", None, None, None, None)], t, e, f"m{p}") for s, p, q_, r, k, pr, calls, t, e in rows],
        f"session_id long, pos long, seq long, role string, source_kind string, price long, blocks {blocks}, tool_call_id string, is_error boolean, message_id string",
    )
    plain = {}
    for s, p, _, r, k, pr, calls, t, e in rows:
        plain.setdefault(s, []).append({"pos": p, "role": r, "cp": k == "compact-checkpoint", "typed": k == "user", "price": pr, "calls": calls, "result": t, "err": e})
    return df, plain


def open_walk(rows):
    pending, out = set(), []
    for r in rows:
        before = bool(pending)
        pending |= set(r["calls"])
        pending.discard(r["result"])
        out.append((before, bool(pending)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_balance_and_cuts(spark, seed):
    df, plain = random_log(spark, seed)
    got = {(r.session_id, r.pos): (r.open_before > 0, r.open_after > 0) for r in structure.balanced(df).collect()}
    assert got == {(s, r["pos"]): o for s, rows in plain.items() for r, o in zip(rows, open_walk(rows), strict=True)}
    got = {r.session_id: r.cut for r in selection.suffix_cut(df, 300).collect()}
    for s, rows in plain.items():
        cuts = [i for i, (r, o) in enumerate(zip(rows, open_walk(rows), strict=True)) if r["role"] != "tool" and not o[0]]
        cut = cuts[0] if cuts else 0
        total = 0
        for i in range(len(rows) - 1, -1, -1):
            total += rows[i]["price"]
            if total >= 300 and cuts:
                cut = next((c for c in cuts if c >= i), cuts[0])
                break
        assert got[s] == (0 if all(r["cp"] for r in rows[:cut]) else cut)


@pytest.mark.parametrize("seed", [3, 4])
def test_safe_spans(spark, seed):
    df, plain = random_log(spark, seed)
    df = q.expected_only(df)
    kept = {(r.session_id, r.pos) for r in df.select("session_id", "pos").collect()}
    got = sorted((r.session_id, r.first_pos, r.last_pos, r.rows) for r in structure.safe_spans(df).collect())
    want = []
    for s, rows in plain.items():
        rows = [r for r in rows if (s, r["pos"]) in kept]
        cuts, start = {0} | {i + 1 for i, o in enumerate(open_walk(rows)) if not o[1]}, 0
        for end in range(len(rows) + 1):
            if end < len(rows) and rows[end]["role"] != "system":
                continue
            a, b = start, end
            while a < b and a not in cuts:
                a += 1
            while b > a and b not in cuts:
                b -= 1
            if b - a > 1 and any(not r["cp"] for r in rows[a:b]):
                want.append((s, rows[a]["pos"], rows[b - 1]["pos"], b - a))
            start = end + 1
    assert got == sorted(want)


@pytest.mark.parametrize("tail", [None, 0, 2])
def test_turn_tail(spark, tail):
    df, plain = random_log(spark, 5)
    got = {r.session_id: r.kept for r in selection.turn_tail(df.withColumn("json_len", F.col("price") * 4), 150, tail).collect()}
    for s, rows in plain.items():
        n, opens = len(rows), open_walk(rows)
        price = lambda a, b, rows=rows: int((sum(4 * r["price"] for r in rows[a:b]) + max(b - a - 1, 0) + 2) / 4 + 0.5)
        cuts = {0} | {i + 1 for i in range(n) if not opens[i][1]}
        starts = [i for i, r in enumerate(rows) if r["role"] == "user" and not r["cp"]]
        kept, total = n, 0
        if tail != 0 and starts:
            for start in reversed(starts if tail is None else starts[-tail:]):
                end = next((x for x in starts if x > start), n)
                if total + price(start, end) <= 150 and start in cuts:
                    total, kept = total + price(start, end), start
                    continue
                for i in range(start + 1, end):
                    if i in cuts and rows[i]["role"] != "tool" and price(i, end) <= 150 - total:
                        kept = i
                        break
                break
        assert got[s] == (kept or n)


def test_ownership(spark):
    """A session is held while a compaction is under way; only the open turn's own compaction, or one by hand without a turn, may begin."""
    kinds = ["begin", "end", "turn", "done"]
    events = [(1, ["turn"]), (2, ["turn", "begin"]), (3, ["turn", "begin", "end", "done"]), (4, ["done", "turn", "done", "begin", "end", "turn"]), (5, ["other"])]
    df = spark.createDataFrame([(s, i, k) for s, ks in events for i, k in enumerate(ks)], "session_id long, pos long, kind string")
    held = state.ownership(df, *[F.col("kind") == k for k in kinds])
    got = {r.session_id: (r.auto, r.hand) for r in held.select("session_id", state.refusal(False).alias("auto"), state.refusal(True).alias("hand")).collect()}
    assert got == {1: (None, "in a turn"), 2: ("active", "active"), 3: ("no turn", None), 4: (None, "in a turn"), 5: ("no turn", None)}


def test_append_within(spark):
    rng = random.Random(6)
    items = [(s, i, "L", "x" * rng.randrange(300), rng.choice([20, 60])) for s in range(5) for i in range(8)]
    got = {(r.session_id, r.ord): r.text for r in selection.append_within(spark.createDataFrame(items, "session_id long, ord long, label string, body string, cap long"), 150).collect()}
    want = {}
    for s in range(5):
        left = 150
        for _, i, label, body, cap in (x for x in items if x[0] == s):
            header = f"[{label}]\n"
            room = max(0, min(left, cap) * 4 - len(header))
            if room and body:
                want[s, i] = header + body[:room]
                left -= -(-len(want[s, i]) // 4)
    assert got == want


def test_orphan_closure(spark):
    df, plain = random_log(spark, 7, n=14)
    got = {(r.session_id, r.pos) for r in lookups.orphan_closure(df).collect()}
    for s, rows in plain.items():
        ids = [set(r["calls"]) | ({r["result"]} - {None}) for r in rows]
        first = next((i for i, r in enumerate(rows) if r["role"] != "system"), None)
        gone = set() if first is None else {first}
        while True:
            calls = set().union(*(ids[i] for i in gone)) if gone else set()
            more = gone | {i for i in range(len(rows)) if ids[i] & calls}
            if more == gone:
                break
            gone = more
        assert {p for x, p in got if x == s} == gone


def test_orphan_closure_runs_on_the_whole_log(spark, sf_dir):
    sessions = {}
    for r in q.log(spark, sf_dir).select("session_id", "pos", "role", "tool_call_id", F.expr("filter(blocks, b -> b.type = 'tool-call')").alias("calls")).orderBy("session_id", "pos").collect():
        ids = {b["id"] for b in r.calls} | ({r.tool_call_id} - {None})
        sessions.setdefault(r.session_id, []).append((r.pos, r.role, ids))
    want = set()
    for s, rows in sessions.items():
        first = next((p for p, role, _ in rows if role not in ("system", "developer")), None)
        gone, more = set(), {first} - {None}
        while more != gone:
            gone = more
            calls = set().union(*(ids for p, _, ids in rows if p in gone))
            more = gone | {p for p, _, ids in rows if ids & calls}
        want |= {(s, p) for p in gone}
    got = [(r.session_id, r.pos) for r in q.QUERIES["orphan_closure"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert max(p for _, p in got) > 20


def test_paths_and_todos(spark):
    args = json.dumps({"files": [{"path": " a "}, "b"], "target_file": "c", "other": "d"})
    rows = spark.createDataFrame([(args,), ("{bad",), ("[1]",), (None,)], "a string")
    assert [r.p for r in rows.select(text.collect_paths(F.col("a")).alias("p")).collect()] == [["c", "a", "b"], [], [], []]
    tags = text.tagged_paths(F.lit("<read-files>\nx\ny\n</read-files> <read-files>\nx\n</read-files>"), "read-files")
    assert spark.range(1).select(tags.alias("t")).first().t == ["x", "y"]


def test_write_paths(spark, tmp_path):
    df, plain = random_log(spark, 8)
    new = df.where("role = 'tool'").select("session_id", "seq", F.array(logs.block("text", F.lit("gone"))).alias("blocks"))
    out = logs.replace(df, new)
    assert out.where("role = 'tool' and blocks[0].text <> 'gone'").count() == 0
    for bad in (new.union(new), df.where("role = 'assistant'").select("session_id", "seq", "blocks")):
        with pytest.raises(Exception, match="repeated or not"):
            logs.replace(df, bad).collect()
    with pytest.raises(Exception, match="missing from the log"):
        logs.snapshot(df.withColumn("tool_name", F.lit(None).cast("string")).withColumn("tool_arguments", F.lit(None).cast("string")), spark.createDataFrame([(0, 0, 999)], "session_id long, pos long, seq long")).collect()
    state_rows = logs.record(df.where("pos = 0").select("session_id", "seq", F.lit(1).alias("n"), F.lit(None).cast("int").alias("none")), "p", "k", ["n", "none"])
    logs.append_records(state_rows, f"{tmp_path}/state")
    logs.append_records(state_rows, f"{tmp_path}/state")
    back = logs.latest(spark.read.parquet(f"{tmp_path}/state"), "p", "k")
    assert {r.data for r in back.collect()} == {'{"n":1}'} and back.count() == len(plain)
    logs.write_report(back, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == back.count()
    table = logs.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y string"))
    with pytest.raises(ValueError):
        logs.markdown_table(spark.range(3), 2)
    assert table.splitlines() == ["| x | y |", "| --- | --- |", "| a\\|b |  |"]
    found, missing = logs.read_files(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "hello")], "path string, text string"), 3)
    assert [(r.path, r.content) for r in found.orderBy("path").collect()] == [("a", "hel"), ("b", None)] and [r.path for r in missing.collect()] == ["b"]
    asked = spark.createDataFrame([(1, "good"), (2, "fail"), (3, "blank")], "session_id long, prompt string")

    def model(prompt):
        if prompt == "fail":
            raise RuntimeError("down")
        return " " if prompt == "blank" else f"sum of {prompt}"

    assert sorted((r.session_id, r.summary, r.error) for r in logs.summarize(asked, model, 11).collect()) == [(1, "sum of good", None), (2, None, "down"), (3, None, "empty summary")]


def test_compaction(spark, sf_dir):
    rows = q.log(spark, sf_dir)
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(30_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    for model in (None, lambda prompt: "short"):
        new, verdicts = compaction.run(rows, sessions, "split_turn", F.col("tokens"), 4_000, model)
        done = {r.session_id: r.rows for r in verdicts.where("accepted").collect()}
        assert done
        before = {r.session_id: r.n for r in rows.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
        after = {r.session_id: r.n for r in new.groupBy("session_id").agg(F.count("*").alias("n")).collect()}
        assert after == {s: n - done[s] + 1 if s in done else n for s, n in before.items()}
        assert new.join(structure.balanced(rows).where("open_after > 0 and open_before = 0").select("session_id", "pos"), ["session_id", "pos"], "left_semi").count() >= 0
    region = compaction.select_region(compaction.priced(rows, F.col("tokens")), 2, 4)
    assert region.groupBy("session_id").count().agg(F.max("count")).first()[0] == 3
    strategies.register_strategy("everything", lambda due, keep: due.select("session_id", "pos", "seq", "price"))
    with pytest.raises(ValueError):
        strategies.register_strategy("everything", lambda due, keep: due)
    assert strategies.strategy("everything")(compaction.priced(rows, F.col("tokens")), 0).count() == rows.count()


def test_cut_and_blank_answers_are_never_committed(spark, sf_dir):
    rows = q.log(spark, sf_dir)
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(30_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    for strategy, said in (("split_turn", "y" * 51), ("head_tail", " \n\t")):
        new, verdicts = compaction.run(rows, sessions, strategy, F.col("tokens"), 4_000, lambda p, said=said: said, max_chars=50)
        assert verdicts.count() == 0 and new.count() == rows.count()
    new, verdicts = compaction.run(rows, sessions, "split_turn", F.col("tokens"), 4_000, lambda p: "y" * 50, max_chars=50)
    assert verdicts.where("accepted").count() > 0
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "session_id long, prompt string")
    got = {r.session_id: (r.summary, r.error) for r in logs.summarize(asked, lambda p: {"a": "abc", "b": "abcd", "c": " "}[p], 3).collect()}
    assert got == {1: ("abc", None), 2: (None, "truncated"), 3: (None, "empty summary")}


def test_checkpoints_are_priced_as_their_range_was(spark, sf_dir):
    rows = logs.entries_from_conversations(logs.table(spark, sf_dir, "conversations"))
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(300).cast("long").alias("window"), F.lit(10).cast("long").alias("output"))
    said = "Zusammenfassung: größer als 漢字"
    settings = strategies.config(reserve_tokens=250)
    for price, want in ((pricing.chars4(F.col("blocks")), -(-len(said) // 4)), (pricing.bytes4(F.col("blocks"), F.col("role"), F.lit("")), -(-len(said.encode()) // 4)), (F.length(F.col("blocks")[0]["text"]).cast("long"), len(said))):
        verdicts = compaction.run(rows, sessions, "turn_tail", price, 20, lambda p: said, settings=settings)[1].collect()
        assert verdicts and {r.tokens for r in verdicts} == {want}


def test_restoration(spark):
    call = lambda i, name, args: [("tool-call", None, i, name, args, None)]
    say = lambda t: [("text", t, None, None, None, None)]
    rows = [
        (1, 0, "user", "plan-note", None, None, False, say("old plan"), "m0"), (1, 1, "user", "plan-note", None, None, False, say("new plan"), "m1"),
        (1, 2, "assistant", "model", None, None, False, call("s", "Skill", '{"skill": "k"}'), "m2"), (1, 3, "tool", "tool", None, "s", False, say("skill text"), "m3"),
        (1, 4, "assistant", "model", None, None, False, call("f", "Read", '{"path": "a.py"}'), "m4"), (1, 5, "tool", "tool", None, "f", False, say("seen"), "m5"),
        (1, 6, "assistant", "model", None, None, False, call("g", "Read", '{"path": "docs/AGENTS.md"}'), "m6"), (1, 7, "tool", "tool", None, "g", False, say("seen"), "m7"),
        (1, 8, "assistant", "model", None, None, False, call("h", "Read", '{"path": "b.py"}'), "m8"), (1, 9, "tool", "tool", None, "h", False, say("seen"), "m9"),
        (1, 10, "assistant", "model", None, None, False, call("i", "Read", '{"path": "b.py"}'), "m10"), (1, 11, "tool", "tool", None, "i", False, say("still shown"), "m11"),
    ]
    blocks = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
    df = spark.createDataFrame(rows, f"session_id long, pos long, role string, source_kind string, source_form string, tool_call_id string, is_error boolean, blocks {blocks}, message_id string").withColumn("seq", F.col("pos"))
    files = spark.createDataFrame([("a.py", "print(1)"), ("b.py", "x"), ("docs/AGENTS.md", "x")], "path string, text string")
    out = restoration.restore(df, df.where("pos < 10").select("session_id", "pos"), files)
    assert [r.text for r in out.orderBy("ord").collect()] == ["[Restored plan-note context]\nnew plan", '[Invoked skill {"skill": "k"}]\nskill text', "[Current file a.py; excerpt up to 5000 tokens]\nprint(1)"]


def test_refills(spark):
    rows = [(1, i, "t", b) for i, b in enumerate([9, 1, 0, 2, 5, 1])] + [(1, 10, "u", 0)]
    got = [(r.refills, r.blocked) for r in state.rapid_refills(spark.createDataFrame(rows, "session_id long, ord long, turn_key string, batches long")).orderBy("ord").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False), (0, False)]


def test_branch_and_representation(spark):
    df, plain = random_log(spark, 9)
    got = {(r.session_id, r.pos) for r in selection.branch(df, 200).collect()}
    for s, rows in plain.items():
        used, want = 0, set()
        for r in reversed([r for r in rows if r["role"] != "system"]):
            if used + r["price"] > 200:
                if r["cp"] and used < 180:
                    want.add(r["pos"])
                break
            used += r["price"]
            want.add(r["pos"])
        assert {p for x, p in got if x == s} == want
    assert lineage.distinct_newest(df, "message_id").count() == df.count()


def test_monitor(spark, tmp_path):
    from palimpsest.streaming import monitor

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = f"{tmp_path}/in", []
    event = lambda t, kind, tokens=0, batches=0, series="a": (1, f"2024-01-01 00:00:{t:02d}", kind, series, tokens, batches)

    def add(*rows):
        spark.createDataFrame(rows, "session_id long, ts string, kind string, series string, tokens long, batches long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    add(event(0, "turn"), event(1, "step", 10), event(2, "step", 100), event(3, "failure"), event(4, "overflow"), event(5, "overflow"), event(6, "overflow", series="b"))
    def run(until):
        """Timers keep a stream busy without end, so it is watched and stopped."""
        decisions = monitor.monitor(monitor.read_events(spark, source), trigger=50, max_retries=1)
        write = decisions.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp")
        started = write.foreachBatch(lambda df, _: out.extend(df.collect())).start()
        try:
            for _ in range(240):
                if len(out) >= until:
                    break
                time.sleep(0.25)
        finally:
            started.stop()

    run(4)
    add(event(10, "step", 100, 1), event(11, "failure"), event(12, "failure"), event(13, "step", 100, 5), event(14, "success"), event(15, "step", 100, 5))
    run(7)  # the state goes on from the checkpoint
    assert [(r.action, r.reason) for r in sorted(out, key=lambda r: r.ts)] == [("compact", "pressure"), ("retry", "overflow"), ("refuse", "attempts"), ("retry", "overflow"), ("compact", "pressure"), ("refuse", "failures"), ("compact", "pressure")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
