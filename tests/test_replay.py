"""Running values by blocks, replayed surfaces and components against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import queries as q
from palimpsest.operators import graph, lookups, selection, structure, surface
from palimpsest.operators.scans import Running, scans
from palimpsest.sources import logs

# --- running values


def test_scans(spark):
    rng = random.Random(1)
    rows = [(s, rng.randrange(60) * 3, rng.choice([None, rng.randrange(9)])) for s in (1, 2) for _ in range(80)] + [(3, -7, 5)]
    df = spark.createDataFrame(rows, "session_id int, pos long, v long")
    v = F.col("v")
    specs = {f"{how}{i:d}{b:d}": Running(v, how, bool(i), bool(b)) for how in ("sum", "min", "max") for i in (0, 1) for b in (0, 1)}
    got = scans(df, ["session_id"], specs, block=10)
    assert got.count() == len(rows) and set(got.columns) == {"session_id", "pos", "v", *specs}
    of = {"sum": lambda x: sum(x), "min": lambda x: min(x, default=None), "max": lambda x: max(x, default=None)}
    for r in got.collect():
        for name, run in specs.items():
            side = (lambda p, at=r.pos, run=run: p > at or run.inclusive and p == at) if run.backward else (lambda p, at=r.pos, run=run: p < at or run.inclusive and p == at)
            assert r[name] == of[run.how]([x for s, p, x in rows if s == r.session_id and x is not None and side(p)])
    once = list({(s, p): (s, p, x) for s, p, x in rows}.values())  # the nearest value is unique without peers
    last = scans(spark.createDataFrame(once, df.schema), ["session_id"], {"a": Running(v, "last"), "b": Running(v, "last", backward=True)}, block=10)
    for r in last.collect():
        own = sorted((p, x) for s, p, x in once if s == r.session_id and x is not None)
        assert r.a == max((y for y in own if y[0] < r.pos), default=(0, None))[1]
        assert r.b == min((y for y in own if y[0] > r.pos), default=(0, None))[1]
    assert scans(df.limit(0), ["session_id"], specs).count() == 0


def test_blocked_forms_equal_windows(spark, sf_dir):
    rows, block = q.log(spark, sf_dir), 7
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect())) == sorted(map(tuple, b.select(*c).collect()))
    assert same(structure.balanced(rows), structure.balanced(rows, block), "session_id", "pos", "open_before", "open_after")
    for mode in ("assistant", "pending", "message"):
        assert same(structure.rounds(rows, mode), structure.rounds(rows, mode, block), "session_id", "pos", "round")
    for keep in (0, 8_000):
        assert same(selection.suffix_cut(rows, keep), selection.suffix_cut(rows, keep, block=block), "session_id", "total", "cut", "selected_rows", "selected_tokens")


def test_a_session_of_five_million_rows_is_spread(spark):
    """Calls at each even place with the result beside it, but a call that stays open through the middle fifth."""
    n = 5_000_000
    pos, call = F.col("id"), F.when(F.col("id") == 2_000_000, "long").otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 2)))
    made = F.when((pos % 2 == 0) & (pos != 2_999_998), F.array(logs.block("tool-call", id=call))).otherwise(F.array(logs.block("text", F.lit("x"))))
    answers = F.when(pos == 2_999_999, "long").when((pos % 2 == 1) & (pos != 2_000_001), F.concat(F.lit("c"), F.floor(pos / 2)))
    rows = spark.range(n, numPartitions=8).select(
        F.lit(1).alias("session_id"), pos.alias("pos"), F.when(pos % 2 == 0, "assistant").otherwise("tool").alias("role"), F.lit("model").alias("source_kind"),
        pos.cast("string").alias("message_id"), answers.alias("tool_call_id"), F.lit(False).alias("is_error"), made.alias("blocks"), F.lit(1).cast("long").alias("price"),
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        own = structure.rounds(rows, "pending", 1 << 17).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("round").alias("round")).collect()
        assert len(own) >= 8 and sum(r.n for r in own) == n and max(r.n for r in own) < n / 4
        # While the long call is open, at places 2,000,002 to 2,999,999, no round begins.
        assert max(r.round for r in own) == 2_499_999 - 499_999
        cut = selection.suffix_cut(rows, 3_500_000, block=1 << 17).first()
        assert (cut.total, cut.cut, cut.selected_rows, cut.selected_tokens) == (n, 1_500_000, 1_500_000, 1_500_000)
        cut = selection.suffix_cut(rows, 2_500_001, block=1 << 17).first()
        assert cut.cut == 3_000_000  # nothing open only from there on
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- surface


def literal(messages, operations, as_of):
    """Nodes in order, or the first operation that can't be taken."""
    nodes, of = [], {seq: (a, b) for seq, a, b in operations}
    for seq in sorted(messages):
        if seq > as_of:
            break
        if seq not in of:
            nodes.append(seq)
            continue
        a, b = of[seq]
        if a not in nodes or b not in nodes or nodes.index(a) > nodes.index(b):
            return seq
        nodes[nodes.index(a) : nodes.index(b) + 1] = [seq]
    return nodes


def history(seed, n):
    """A log of messages and valid operations: single nodes, short and long ranges, whole surfaces, one after another."""
    rng, nodes, messages, operations, seq = random.Random(seed), [], [], [], 0
    for _ in range(n):
        seq += rng.randrange(1, 9)
        messages.append(seq)
        if nodes and rng.random() < 0.4:
            i = rng.choice([0, rng.randrange(len(nodes)), max(0, len(nodes) - 3)])
            j = rng.choice([i, min(len(nodes) - 1, i + rng.randrange(6)), len(nodes) - 1])
            operations.append((seq, nodes[i], nodes[j]))
            nodes[i : j + 1] = [seq]
        else:
            nodes.append(seq)
    return messages, operations


def replayed(spark, sessions, as_of=None, block=8):
    messages = spark.createDataFrame([(s, m) for s, (ms, _) in sessions.items() for m in ms], "session_id int, seq long")
    operations = spark.createDataFrame([(s, *o) for s, (_, os) in sessions.items() for o in os], "session_id int, seq long, start_seq long, end_seq long")
    nodes, faults = surface.replay(messages, operations, None if as_of is None else F.col("seq") <= as_of, block)
    out = {}
    for r in nodes.orderBy("session_id", "pos").collect():
        out.setdefault(r.session_id, []).append((r.pos, r.seq))
    return out, {(r.session_id, r.seq): r.fault for r in faults.collect()}


def test_replay_equals_a_literal_one(spark):
    sessions = {s: history(s, 10 + 15 * s) for s in range(12)}
    sessions[50] = ([1, 2, 3, *range(10, 80)], [(x, 1 if x == 10 else x - 1, x - 1 if x > 10 else 3) for x in range(10, 80)])  # a chain of seventy
    for as_of in (None, 3, 200):
        got, faults = replayed(spark, sessions, as_of)
        assert not faults
        for s, (messages, operations) in sessions.items():
            want = literal(messages, operations, 1 << 60 if as_of is None else as_of)
            assert got.get(s, []) == list(enumerate(want)), (s, as_of)


def test_replay_refuses_what_no_surface_could_take(spark):
    rng, sessions, refused = random.Random(5), {}, {}
    for s in range(60):
        messages, operations = history(s, 40)
        if s % 3:
            k = rng.randrange(len(operations))
            seq, a, b = operations[k]
            other = rng.choice([m for m in messages if m < seq])
            operations[k] = rng.choice([(seq, other, b), (seq, a, other), (seq, b, a), (seq, a, seq), (seq, a + 100_000, b), (seq, None, b)])
        sessions[s] = (messages, operations)
        want = literal(messages, operations, 1 << 60)
        if isinstance(want, int):
            refused[s] = want
    assert 10 < len(refused) < 50
    got, faults = replayed(spark, sessions)
    assert {s for s, _ in faults} == set(refused)
    for s, (messages, operations) in sessions.items():
        assert s in refused or got[s] == list(enumerate(literal(messages, operations, 1 << 60)))
        assert s not in refused or s not in got


def test_attached_measurements(spark):
    rows = spark.createDataFrame([(1, 0, 5, "user"), (1, 1, 7, "assistant"), (1, 2, 9, "assistant")], "session_id int, pos long, seq long, role string")
    rows = rows.withColumns({"tokens": F.lit(0).cast("long"), "finish": F.lit("x"), "usage": F.lit(0)})
    prices = spark.createDataFrame([(1, 5, 6, 50), (1, 5, 8, 51), (1, 5, 20, 99), (1, 7, 9, 70)], "session_id int, seq long, measured_at long, tokens long")
    answers = spark.createDataFrame([(1, 5, 6, "stop", 1), (1, 7, 7, "error", None), (1, 7, 8, "stop", 2), (1, 9, 30, "stop", 3)], "session_id int, seq long, answered_at long, finish string, usage int")
    got = surface.attach(rows, prices, answers, F.lit(-1).cast("long"), F.col("at") <= 10).orderBy("pos").collect()
    assert [(r.tokens, r.finish, r.usage) for r in got] == [(51, None, None), (70, "stop", 2), (-1, None, None)]


# --- components


def test_chain_of_ten_thousand_links(spark):
    n = 10_000
    made = F.when(F.col("id") < n, F.array(logs.block("tool-call", id=F.col("id")))).otherwise(F.array().cast("array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"))
    rows = spark.range(n + 200).select(
        F.lit(1).alias("session_id"), F.col("id").alias("pos"), F.col("id").alias("seq"), F.when(F.col("id") > 0, "tool").otherwise("user").alias("role"), F.lit("m").alias("message_id"),
        F.when((F.col("id") > 0) & (F.col("id") <= n), (F.col("id") - 1).cast("string")).alias("tool_call_id"), F.lit(False).alias("is_error"), made.alias("blocks"),
    )
    got = lookups.orphan_closure(rows, rounds=20)
    assert {r.pos for r in got.collect()} == set(range(n + 1))


def test_components(spark):
    rng = random.Random(3)
    links = [(s, rng.randrange(300), rng.randrange(300)) for s in (1, 2) for _ in range(200)] + [(3, 0, x) for x in range(1, 90)] + [(3, 500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, a, b in links:
        x, y = find((s, a)), find((s, b))
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "session_id int, u long, v long")
    got = {(r.session_id, r.node): (r.session_id, r.root) for r in graph.components(df).collect()}
    assert got == {x: find(x) for x in list(root) if any(s == x[0] and x[1] in (a, b) and a != b for s, a, b in links)}
    with pytest.raises(RuntimeError):
        graph.components(df, 1)
    assert graph.components(df.limit(0)).count() == 0
