"""Trees, peaks and proofs against plain recursion."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp int, node string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(x):  # noqa: N802
    return hashlib.sha256(x.encode()).hexdigest()


def levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, i, fanout):
    out = []
    for level in tree[:-1]:
        begin = i - i % fanout
        run = level[begin : begin + fanout]
        out.append(("".join(run[: i - begin]), "".join(run[i - begin + 1 :])))
        i //= fanout
    return out


def brute(rows, fanout):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: H("".join(map(part, (i, s, lang, n, t))))
    groups = {}
    for i, t, lang, s, n in rows:
        groups.setdefault(lang, []).append((i, leaf(i, t, lang, s, n), leaf(i, t, lang, s, n if n is None else n + 1)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for at, (i, own, changed) in enumerate(groups[g]):
            steps = siblings(trees[g], at, fanout) + siblings(top, k, fanout)
            h = changed if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else own
            for before, after in steps:
                h = H(before + h + after)
            out.append((i, own, trees[g][-1][0], top[-1][0], H("".join(b + a for b, a in steps)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows, fanout=2, block_rows=8192):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(df, "doc_id", COLUMNS, "lang", {"n_chars": F.col("n_chars") + 1}, hit, fanout, block_rows)


def rows_of(seed, n):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["fr", "Zz", "é", None, ""]
    return [(i * 3, rng.choice([None, "", "text", "ü" * 9, "1:2"]) if i % 4 else f"t{i}", rng.choice(langs), rng.choice([None, "web"]), rng.choice([None, 5, i])) for i in range(n)]


@pytest.mark.parametrize(("fanout", "block_rows"), [(2, 8192), (2, 7), (3, 11), (5, 40)])
def test_manifest(spark, fanout, block_rows):
    rows = rows_of(fanout, 230) + [(999_999, "lone", "xx", None, 4)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (3, "again", "en", "s", 1), (6, "x", "fr", "s", 2), (6, "x", "fr", "s", 2), (6, "x", "fr", "s", 2), (70, "word " * 300_000, "fr", "s", 2)]
    got = run(spark, rows, fanout, block_rows).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, fanout)
    assert {r.verified for r in got} == {True, False}


def test_manifest_small(spark):
    for rows in ([(1, "only", "en", None, 3)], [(1, "a", None, None, 3), (2, "b", None, None, None)]):
        assert sorted(map(tuple, run(spark, rows).collect()), key=repr) == brute(rows, 2)
    assert run(spark, [(1, "a", "en", None, 3)]).where("doc_id > 1").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, "doc_id", COLUMNS, "lang").count() == 0
    with pytest.raises(ValueError):
        merkle.build(empty.select(F.col("lang").alias("grp"), F.col("text").alias("digest")), [], 1)


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_ranges_merge_to_one_peak_wherever_they_are_cut(fanout):
    rng = random.Random(fanout)
    for size in [1, 2, 3, fanout, fanout + 1, 50, 243, 400]:
        leaves = [H(str(i)) for i in range(size)]
        tree = levels(leaves, fanout)
        cuts = sorted(rng.sample(range(1, size), min(size - 1, rng.randrange(6)))) if size > 1 else []
        made, parts = [], []
        for a, b in zip([0, *cuts], [*cuts, size], strict=True):
            part = merkle._stacked(((0, i, leaves[i]) for i in range(a, b)), size, fanout)
            assert len(part.peaks) <= 2 * fanout * len(tree)
            made += part.made
            parts.append(part)
        whole = merkle._stacked((x for p in parts for x in p.peaks), size, fanout)
        made += whole.made
        assert whole.peaks == [(len(tree) - 1, 0, tree[-1][0])]
        assert sorted(made) == sorted((k, i, h) for k, level in enumerate(tree) if k for i, h in enumerate(level))  # each node once


def test_more_blocks_than_asked_for(spark, monkeypatch):
    frame = type(spark.range(1))
    ranged = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *keys: ranged(self, 9, *keys))
    rows = rows_of(3, 120)
    assert sorted(map(tuple, run(spark, rows).collect()), key=repr) == brute(rows, 2)


def test_node_records(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else None, None, i) for i in range(150)]
    df = spark.createDataFrame([(f"{r[2]}" if r[2] else None, r[0], H(r[1])) for r in rows], "grp string, key long, digest string")
    trees = merkle.build(df, ["key"], 2, 13)
    want = {}
    for g in (None, "en"):
        tree = levels([H(r[1]) for r in rows if r[2] == g], 2)
        want |= {(g, k, i): h for k, level in enumerate(tree) if k for i, h in enumerate(level)}
    got = trees.nodes().collect()
    assert len(got) == len(want) and {(r.grp, r.level, r.node): r.digest for r in got} == want
