"""What each preset gives back, against plain walks over lists."""

import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import pretty_json
from palimpsest.operators import selection
from palimpsest.plans import compaction, presets, restoration, strategies

BLOCKS = "array<struct<type:string,text:string,id:string,name:string,arguments:string,media_type:string>>"
SCHEMA = f"session_id long, pos long, seq long, time_ms long, role string, source_kind string, source_form string, tool_call_id string, is_error boolean, message_id string, price long, blocks {BLOCKS}"
TOOLS = ("Read", "read_file", "Edit", "Skill", "load-skill", "Bash")
FILES = {f"d/f{i}.py": f"content {i} " * (i * 3) for i in range(9)} | {"d/AGENTS.md": "rules", "plan.md": "step one"}


def say(text):
    return ("text", text, None, None, None, None)


def random_sessions(seed, sessions=8, n=60):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        for p in range(n):
            role, kind, form, call, error, blocks = "user", "user", None, None, False, [say("u" * rng.randrange(40))]
            pick = rng.random()
            if pick < 0.2:
                kind, form = rng.choice([("plan-note", None), ("skill-listing", None), ("env", "snapshot"), ("guide", "instructions"), ("skill-x", "catalog")])
                blocks = [say(f"{kind} {p} " * rng.randrange(12))]
            elif pick < 0.55:
                role, kind = "assistant", "model"
                arguments = json.dumps(rng.choice([{"path": rng.choice([*FILES, "d/.git/x", "none"])}, {"file_path": f"d\\f{rng.randrange(9)}.py"}, {"skill": f"k{rng.randrange(4)}"}, {"file_path": "", "path": "d/f1.py"}]))
                blocks = [("tool-call", None, f"c{rng.randrange(12)}", rng.choice(TOOLS), arguments, None)]
            elif pick < 0.9:
                role, kind, call, error = "tool", "tool", f"c{rng.randrange(12)}", rng.random() < 0.2
                blocks = [say(f"result {p} " * rng.randrange(25))]
                if rng.random() < 0.3:
                    blocks.append(("image", None, None, rng.choice([None, "offloaded"]), None, "image/png"))
            rows.append((s, p, p, 1000 + (p * 7) % 40 * 10, role, kind, form, call, error, f"m{p % 9}", 10, blocks))
    return rows


def with_names(rows):
    """Each session's rows as dictionaries."""
    out = {}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for r in rows:
        out.setdefault(r[0], []).append(dict(zip(names, r, strict=False)))
    return out


def text_of(row):
    return "\n".join(b[1] for b in row["blocks"] if b[0] == "text")


def letters(name):
    return "".join(c for c in name.lower() if c.isalpha())


class Purse:
    def __init__(self, budget, pool=10**9):
        self.left, self.pool, self.texts = budget, pool, []

    def put(self, label, body, cap, pooled=False, excerpt=False):
        most = min(self.left, cap, self.pool if pooled else self.left)
        header = f"[{label}{f'; excerpt up to {most} tokens' if excerpt else ''}]\n"
        room = max(0, most * 4 - len(header))
        if room and body:
            self.texts.append(header + body[:room])
            used = -(-len(self.texts[-1]) // 4)
            self.left -= used
            self.pool -= used if pooled else 0


def walk(rows, chosen, limits, images):
    budget, skill, file, most, pool = limits
    purse, seen = Purse(budget, pool), set()
    source = lambda r: (r["source_kind"], r["source_form"], r["message_id"])
    shown = {source(r) for r in rows if r["pos"] not in chosen}
    for r in reversed(rows):
        kind, form = r["source_kind"], r["source_form"]
        if form not in ("instructions", "snapshot", "catalog") and not any(w in kind for w in ("skill", "plan", "subagent", "agent-instructions")):
            continue
        key = (kind, form) if form == "snapshot" or "plan" in kind else source(r)
        if key in seen:
            continue
        seen.add(key)
        if source(r) not in shown:
            purse.put(f"Restored {kind}" + ("" if images else " context"), text_of(r), skill if "skill" in kind else budget, "skill" in kind and not images)
    calls = {b[2]: b for r in rows for b in r["blocks"] if b[0] == "tool-call"}  # the last call of an id
    named = [(r, calls.get(r["tool_call_id"])) for r in rows if r["role"] == "tool"]
    named = [(r, letters(c[3]), c[4]) for r, c in named if c]
    seen = set()
    for r, tool, arguments in reversed(named):
        if not r["is_error"] and tool in ("skill", "loadskill", "skillread") and arguments not in seen:
            seen.add(arguments)
            purse.put(f"Invoked skill {arguments}", text_of(r), skill, not images)
    path = lambda a: json.loads(a).get("file_path") or json.loads(a).get("path")
    still = {path(a) for r, t, a in named if r["pos"] not in chosen and t in restoration.FILE_TOOLS}
    seen, count = set(), 0
    for r, tool, arguments in reversed(named):
        p = path(arguments)
        if r["pos"] not in chosen or r["is_error"] or tool not in restoration.FILE_TOOLS or not p or p in seen:
            continue
        if not images and (p in still or p.lower().endswith("agents.md")):
            continue
        seen.add(p)
        if count < most and p in FILES:
            purse.put(f"Current file {p}", FILES[p], file, excerpt=True)
            count += 1
    pictures = [b for r in rows if r["pos"] in chosen and not (r["role"] == "tool" and r["is_error"]) for b in r["blocks"] if b[0] == "image" and b[3] != "offloaded"]
    return purse.texts, len(pictures[-min(3, purse.left // 20) :]) if min(3, purse.left // 20) > 0 else 0


@pytest.fixture(scope="module")
def session_rows(spark):
    rows = random_sessions(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    return with_names(rows), df, df.where("pos between 10 and 45").select("session_id", "pos"), spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.mark.parametrize("limits", [(400, 60, 40, 3, 90), (120, 30, 30, 5, 40), (50_000, 5_000, 5_000, 5, 25_000), (0, 5, 5, 1, 5)])
def test_nested_budgets(spark, session_rows, limits):
    plain, df, selected, files = session_rows
    budget, skill, file, most, pool = limits
    got = {}
    for r in restoration.restore(df, selected, files, budget, skill, file, most, pool).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append(r.text)
    pictured = {}
    for r in restoration.restore_with_images(df, selected, files, budget, skill, file, most, image_tokens=20).orderBy("session_id", "ord").collect():
        pictured.setdefault(r.session_id, ([], []))[r.block.type == "image"].append(r.text or r.block.media_type)
    for s, rows in plain.items():
        chosen = set(range(10, 46))
        assert got.get(s, []) == walk(rows, chosen, limits, False)[0]
        texts, images = walk(rows, chosen, limits, True)
        assert pictured.get(s, ([], [])) == (texts, ["image/png"] * images)


def test_media_free_sessions_get_state_only(spark, session_rows):
    _, df, selected, files = session_rows
    bare = spark.createDataFrame([(1,)], "session_id long")
    rows = restoration.restore_with_images(df, selected, files, media_free=bare).collect()
    assert all(r.text.startswith("[Restored ") for r in rows if r.session_id == 1)
    assert any(r.block.type == "image" for r in rows if r.session_id != 1)


def read_walk(rows, chosen, since, budget, file, most):
    calls, reads = {}, {}
    for r in rows:
        for b in r["blocks"]:
            if b[0] == "tool-call" and letters(b[3]) in ("read", "readfile"):
                given = json.loads(b[4])
                path = (given["file_path"] if "file_path" in given else given.get("path") or "").replace("\\", "/")
                if path and ".git" not in path.split("/"):
                    calls[b[2]] = (path, r["pos"] not in chosen)
        if r["seq"] > since and r["role"] == "tool" and not r["is_error"] and r["tool_call_id"] in calls and all(b[0] == "text" for b in r["blocks"]):
            path, stays = calls[r["tool_call_id"]]
            reads[path] = (text_of(r), r["time_ms"], stays)
    out, used = [], 0
    for path, (body, _, _) in sorted([x for x in reads.items() if not x[1][2]], key=lambda x: -x[1][1])[:most]:
        tokens = -(-len(body) // 4)
        fits = tokens <= file and used + tokens <= budget
        used += tokens if fits else 0
        out.append((path, body if fits else None))
    return out


@pytest.mark.parametrize("limits", [(90, 40, 5), (50_000, 5_000, 2), (30, 5_000, 4), (0, 0, 3)])
def test_reread_files(spark, session_rows, limits):
    plain, df, selected, _ = session_rows
    since = spark.createDataFrame([(s, 15) for s in range(4)], "session_id long, seq long")
    got = {}
    for r in restoration.reread_files(df, selected, since, *limits).orderBy("session_id", "nth").collect():
        got.setdefault(r.session_id, []).append((r.path, r.text))
    assert got
    for s, rows in plain.items():
        assert got.get(s, []) == read_walk(rows, set(range(10, 46)), 15 if s < 4 else -1, *limits)


def test_reads_among_notes(spark, session_rows):
    plain, df, selected, files = session_rows
    seen = spark.createDataFrame([(0, ["mind this", "and that"], "plan.md", "- todo", "/log", True), (1, None, "absent.md", "", None, False)], "session_id long, reminders array<string>, plan_path string, todos string, transcript_path string, repl_cleared boolean")
    got = {}
    for r in restoration.restore_reads(df, selected, files, seen).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append(r.text)
    assert set(got) == set(plain)
    for s, rows in plain.items():
        reads = [f"Earlier successful Read of {p}:\n{t}" for p, t in read_walk(rows, set(range(10, 46)), -1, 50_000, 5_000, 5)]
        last = "Continue the latest unfinished task directly, preserving the user constraints in the summary."
        if s == 0:
            head = ["mind this", "and that", "Approved plan file: plan.md\n\nstep one\n\nContinue this plan if it remains relevant and unfinished."]
            tail = ["Current task state:\n- todo", "Earlier exact output and messages remain at: /log", "The host cleared REPL state during compaction. Recreate variables before using them.", last]
            assert got[s] == head + reads + tail
        else:
            assert got[s] == [*reads, last]


def test_recovery_notes_and_todos(spark, session_rows):
    _, df, selected, _ = session_rows
    seen = spark.createDataFrame([(0, "/wire", "/log", "1-20", "done"), (1, None, "/log", None, None), (2, None, None, None, "")], "session_id long, wire_path string, transcript_path string, window_lines string, todos string")
    got = {}
    for r in restoration.recovery_notes(selected, seen).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append(r.text)
    log = "## Context Recovery\nEarlier conversation remains in the session log: "
    read = "\nRead the relevant records for exact output, paths, or previous requests."
    assert [x for x in got[0] if x.startswith("##")] == [f"{log}/wire\n1-20{read}"] and got[1][0] == f"{log}/log{read}" and len(got[2]) == 1
    todo = [(1, 90, 90, 0, "assistant", "model", None, None, False, "a", 1, [("tool-call", None, "t1", "TodoWrite", '{"todos": [{"do": "ü", "n": 1}, []]}', None)]), (1, 91, 91, 0, "tool", "tool", None, "t1", False, "b", 1, [say("ok")])]
    archive = df.unionByName(spark.createDataFrame([*todo, (2, *todo[0][1:]), (2, *todo[1][1:])], SCHEMA))
    summaries = spark.createDataFrame([(0, "a", None), (1, "b", None), (2, "c", None), (3, None, "failed")], "session_id long, summary string, error string")
    texts = {r.session_id: r.summary for r in restoration.with_todos(summaries, archive, seen).collect()}
    written = '[\n  {\n    "do": "ü",\n    "n": 1\n  },\n  []\n]'
    assert texts == {0: "a\n\n## TODO List\ndone", 1: f"b\n\n## TODO List\n{written}", 2: "c", 3: None}  # an observed empty list stands
    assert spark.range(1).select(pretty_json(F.lit(None).cast("string"))).first()[0] is None


def test_context_before_the_last_user(spark):
    rows = [(1, i, i, 0, "user", kind, form, None, False, f"m{i}", 1, [say(text)]) for i, (kind, form, text) in enumerate([("user", None, "one"), ("plan-a", None, "old"), ("user", None, "two"), ("plan-a", None, "new"), ("guide", "instructions", "rules"), ("user", None, "three")])]
    rows += [(2, 0, 0, 0, "user", "guide", "instructions", None, False, "m", 1, [say("alone")])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in presets.retained_with_context(df, df.select("session_id", "pos")).orderBy("session_id", "ord").collect():
        got.setdefault(r.session_id, []).append(r.text.split("\n")[-1])
    assert got == {1: ["one", "two", "new", "rules", "three"], 2: ["alone"]}


def test_run_restores_for_every_preset(spark, session_rows):
    _, _, _, files = session_rows
    rows = []
    for s in range(8):
        for p in range(0, 60, 3):
            rows.append((s, p, p, p, "user", "user", None, None, False, f"m{p}", 10, [say("please")]))
            rows.append((s, p + 1, p + 1, p, "assistant", "model", None, None, False, f"m{p + 1}", 10, [("tool-call", None, f"c{p}", "Read", json.dumps({"path": f"d/f{p % 9}.py"}), None)]))
            rows.append((s, p + 2, p + 2, p, "tool", "tool", None, f"c{p}", False, f"m{p + 2}", 10, [say("result")] + [("image", None, None, None, None, "image/png")] * (p % 2)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tool_name", F.lit(None).cast("string"))
    sessions = df.select("session_id").distinct().select("session_id", F.lit(40_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    settings = strategies.config(reserve_tokens=26_900, threshold_ratio=0.01, max_restored_images=1)
    seen = spark.createDataFrame([(s, ["mind this"]) for s in range(8)], "session_id long, reminders array<string>")
    for name in ("idle_headroom", "image_guard", "round_keep", "head_tail"):
        new, verdicts = compaction.run(df, sessions, name, F.col("price") * 100, 50, lambda p: "short", settings=settings, files=files, recovery=seen)
        blocks = verdicts.where("accepted").select("session_id").join(new.where("source_kind = 'compact-checkpoint'"), "session_id").select("session_id", "blocks").collect()
        assert blocks, name
        for r in blocks:
            kinds = [b.type for b in r.blocks]
            texts = [b.text for b in r.blocks if b.type == "text"]
            after = texts[texts.index("short") + 1 :]
            assert after and kinds.count("image") <= 1, name
            assert (after[0] == "mind this") == (name in ("round_keep", "head_tail")), name
    off = strategies.config(reserve_tokens=26_900, threshold_ratio=0.01, restore_context=False)
    new, _ = compaction.run(df, sessions, "round_keep", F.col("price") * 100, 50, lambda p: "short", settings=off, files=files, recovery=seen)
    assert {len(r.blocks) for r in new.where("source_kind = 'compact-checkpoint'").collect()} == {1}


def test_excerpt_and_pool(spark):
    items = [(1, 1, "a", "x" * 100, 10, True, False), (1, 2, "b", "y" * 100, 10, True, False), (1, 3, "c", "z" * 100, 1 << 40, False, True)]
    rows = selection.append_within(spark.createDataFrame(items, "session_id long, ord long, label string, body string, cap long, pooled boolean, excerpt boolean"), 40, 13).orderBy("ord").collect()
    assert [(r.used, r.text[:34]) for r in rows] == [(10, "[a]\n" + "x" * 30), (3, "[b]\n" + "y" * 8), (27, "[c; excerpt up to 27 tokens]\nzzzzz")]
