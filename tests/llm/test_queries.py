"""The registered queries on supplied tables: against their SQL, and parts of the others against SQL of those parts."""

import glob
import os

import duckdb
import pytest

from palimpsest.llm import queries as q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def same(df, duck, sql, columns=None):
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert columns or sorted(names) == sorted(df.columns)
    want = sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(round(r[c], 4) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query(spark, duck, name):
    same(q.QUERIES[name](spark, "/root/testdata/sf0.01"), duck, q.ORACLE_SQL[name])


def test_quality_statistics(spark, duck):
    """All of op6 but the learned verdict."""
    sql = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1 : i + 8], ' '))) AS g FROM w WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(8) AS x(j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
       coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
"""
    same(q.op6_quality_rules(spark, "/root/testdata/sf0.01"), duck, sql, True)


def test_mixing_sizes_and_targets(spark, duck):
    """All of op10 but the words taken, and those near their targets. The level is found by trying every source as the last full one."""
    sql = f"""
WITH w AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM w GROUP BY source),
r AS (SELECT *, 2 * source_size / weight AS ratio, 1.5 * sum(source_size) OVER () AS total FROM s),
l AS (SELECT a.ratio, (any_value(a.total) - coalesce(sum(2 * b.source_size) FILTER (b.ratio < a.ratio), 0)) / sum(b.weight) FILTER (b.ratio >= a.ratio) AS level FROM r a, r b GROUP BY a.ratio),
v AS (SELECT coalesce(arg_min(level, ratio) FILTER (level <= ratio), 1e300) AS level FROM l)
SELECT w.doc_id, w.size, r.source_size::BIGINT AS source_size, least(2 * r.source_size, weight * level)::DOUBLE AS target FROM w JOIN r ON w.source IS NOT DISTINCT FROM r.source, v
"""
    df = q.op10_mixing(spark, "/root/testdata/sf0.01").cache()
    same(df, duck, sql, True)
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    taken, target, largest = {}, {}, {}
    for r in df.collect():
        assert r.taken in (0, r["size"], 2 * r["size"])
        s = source[r.doc_id]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r.taken, r.target, max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - t) <= 0.02 * t + largest[s] for s, t in target.items())


def test_lm_base_scores(spark, duck):
    """All of op7 but the trie's score."""
    sql = rf"""
WITH w AS (SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) || [chr(0) || 'end'] AS w FROM documents),
f AS (SELECT *, crc32(doc_id) AS h FROM (SELECT * FROM w) JOIN keys USING (doc_id)),
t AS (SELECT doc_id, h % 10 = 0 AS held_out, unnest(w) AS token FROM f),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
k AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))) AS base_score
FROM t LEFT JOIN c USING (token), k GROUP BY doc_id, held_out
""".replace("crc32(doc_id)", "crc")
    import zlib

    ids = [r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()]
    duck.execute("CREATE TABLE keys (doc_id BIGINT, crc BIGINT)")
    duck.executemany("INSERT INTO keys VALUES (?, ?)", [(i, zlib.crc32(str(i).encode())) for i in ids])
    same(q.op7_lm_scoring(spark, "/root/testdata/sf0.01"), duck, sql, True)


def test_classifier_on_labels_outside_the_fit(spark):
    """Held-out accuracy of op3: half of the labels are kept from the fit."""
    from pyspark.sql import functions as F

    from palimpsest.llm import quality_classifier as k

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = k.featured(docs, carry=["doc_id"])
    judged = k.score(rows, k.fit(rows, labels.where(seen))).select("row.doc_id", "kept")
    held = judged.join(labels.where(~seen & F.col("quality").isNotNull()), "doc_id").collect()
    good, bad = [r.kept for r in held if r.quality == 1], [r.kept for r in held if r.quality == 0]
    assert len(good) > 50 and len(bad) > 10
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)
