"""The Gray-order index against all pairs, and the whole operator against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(bits, distance=4):
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(bits):
        for j in range(i):
            if (x ^ bits[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(bits))]


def crowd(seed, n=500):
    """Random fingerprints, chains of small steps, and dense balls around a few centres."""
    rng = random.Random(seed)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    out = {0, (1 << 64) - 1, 1 << 63, flip(0, 4), flip(0, 5)}
    out |= {rng.getrandbits(64) for _ in range(n // 4)}
    at = rng.getrandbits(64)
    for _ in range(n // 4):
        out.add(at := flip(at, rng.choice([3, 4, 4, 5])))
    for _ in range(3):
        centre = rng.getrandbits(64)
        out |= {flip(centre, rng.choice([1, 2, 3, 6])) for _ in range(n // 4)}
    out = sorted(out)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("fanout", "distance"), [(2, 4), (8, 4), (8, 0), (5, 7)])
def test_index_connects_what_all_pairs_connect(fanout, distance):
    bits = crowd(fanout, 700)
    rank = lambda x: x if not x else x ^ rank(x >> 1)
    rows = sorted((x % 3, rank(x), x) for x in bits)  # three groups
    group, own = np.array([g for g, _, _ in rows]), [x for _, _, x in rows]
    index = simhash.GrayIndex(np.array(own, dtype=np.uint64), group, fanout)
    low, high = index.links(distance)
    for i, j in zip(low, high, strict=True):
        assert i < j and group[i] == group[j]
    got = simhash._roots(len(own), low, high).tolist()
    for g in range(3):
        where = [i for i, x in enumerate(group) if x == g]
        assert [got[i] for i in where] == [where[k] for k in brute_roots([own[i] for i in where], distance)]


def test_index_prunes():
    rng = random.Random(1)
    bits = np.array(sorted(rng.getrandbits(64) for _ in range(4096)), dtype=np.uint64)
    one = simhash.GrayIndex(bits, np.zeros(4096, dtype=int))
    assert len(one.levels) == 5 and not len(one.links(4)[0])
    near = np.array(sorted(range(16)), dtype=np.uint64)
    assert len(simhash.GrayIndex(near, np.zeros(16, dtype=int)).links(4)[0]) == 15  # one whole group: a chain, not 120 pairs


@pytest.mark.parametrize("block", [16, 1024])
def test_links(spark, block):
    bits = crowd(9, 900)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in bits], "bits long")
    place = {x - (1 << 64) if x >> 63 else x: i for i, x in enumerate(bits)}
    found = simhash.links(df, 4, block).collect()
    assert all(((r.u ^ r.v) % (1 << 64)).bit_count() > 0 for r in found)
    got = simhash._roots(len(bits), np.array([place[r.u] for r in found]), np.array([place[r.v] for r in found]))
    assert got.tolist() == brute_roots(bits)
    with pytest.raises(ValueError):
        simhash.links(df, 4, 15)


def test_runs_cover_all_positions():
    for mask in (0, 1, (1 << 63) | 5, (1 << 64) - 32):
        wider = [x % (1 << 64) for x in simhash.runs(mask - (1 << 64) if mask >> 63 else mask, 5)]
        assert sum((x & ~mask).bit_count() for x in wider) == 64 - mask.bit_count() and all(x & mask == mask and x != mask for x in wider)


def test_near_duplicates(spark):
    rng = random.Random(7)
    prose = lambda n: [f"W{rng.randrange(500)}" for _ in range(n)]
    rows = [(i, " ".join(prose(rng.choice([1, 2, 5, 60])))) for i in range(120)]
    base = prose(300)
    for i in range(200, 320):  # near copies, one word changed
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, "  ".join(own).lower() + "\n"))
    rows += [(400 + i, rows[7][1].upper()) for i in range(20)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, rows[3][1]), (None, "only without a key"), (600, "É é " * 20_000), (3, "another text of the key three"), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, bits string, component_id int")
    got = simhash.near_duplicates(df, block=64).collect()
    bits = [brute_fingerprint(t) for _, t in rows]
    root = brute_roots(bits)
    names = {}
    for (i, _), r in zip(rows, root, strict=True):
        names[r] = min((x for x in (names.get(r), i) if x is not None), default=None)
    want = [(i, f"{b:016x}", names[r]) for (i, _), b, r in zip(rows, bits, root, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert len({r.component_id for r in got if r.doc_id and 500 <= r.doc_id <= 502}) == 1


def test_query_on_supplied_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    bits = [brute_fingerprint(t) for _, t in rows]
    root = brute_roots(bits)
    assert got == {i: (f"{b:016x}", rows[r][0]) for (i, _), b, r in zip(rows, bits, root, strict=True)}


def test_rank_sorts_as_gray_order(spark):
    codes = [x ^ (x >> 1) for x in (0, 1, 5, 1 << 62, (1 << 63) + 3, (1 << 64) - 1)]  # ascending ranks
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)], "i int, c long")
    assert [r.i for r in df.orderBy(simhash.gray_rank(F.col("c"))).collect()] == list(range(len(codes)))
