"""Every pipeline stage on its own input, against what its operator decides or brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from palimpsest.llm import queries
from palimpsest.llm.sentencepiece_codec import codec

from .test_operators import WORD, brute_stats, brute_targets, jaccard_classes, prose


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "w " * 30_000, "en", "s", 60_000)], base.schema)
    return base.unionByName(odd).unionByName(base.where("doc_id = 3")).cache()


def test_stages(spark, sf_dir, docs):
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "mixing", "tokens"]
    rows = docs.collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = p.rules_stage(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    for r in rows:
        n, _, _, _, again = brute_stats(r.text)
        if n < 20 or 100 * again > 30 * n:
            assert r.doc_id not in ids
        elif quality.get(r.doc_id) == 1:
            assert r.doc_id in ids
    kept = p.classifier_stage(spark, kept, sf_dir).cache()
    left = {r.doc_id for r in kept.collect()}
    assert left <= ids and kept.columns == docs.columns
    good = [i for i in ids if quality.get(i) == 1]
    assert sum(i in left for i in good) >= 0.99 * len(good)
    before = kept.collect()
    kept = p.near_duplicates_stage(spark, kept, sf_dir).cache()
    classes = jaccard_classes({(r.doc_id, r.text) for r in before})
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for c, _ in classes.values()})
    sizes = Counter()
    for r in kept.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    mixed = p.mixing_stage(spark, kept, sf_dir).cache()
    taken, times = Counter(), Counter(r.doc_id for r in mixed.collect())
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    assert max(times.values()) <= 2 and mixed.columns == docs.columns
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.15 * t + 200
    out = p.tokens_stage(spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == times
    text, own = {r.doc_id: r.text for r in rows}, codec(queries.MODEL)
    assert all(r.token_ids == own.encode(text[r.doc_id], add_eos=True) and r.n_tokens == len(r.token_ids) for r in out[:40])


def test_near_duplicates_judges_rows_of_one_id_apart(spark, sf_dir, docs):
    a, b, c, d = (prose(i, 60, 5000) for i in range(4))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d), (3, d + " more"), (4, c + " more"), (None, b + " more"), (None, prose(9, 60)), (5, None), (5, ""), (5, b)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    got = Counter((r.doc_id, r.text) for r in p.near_duplicates_stage(spark, df, sf_dir).collect())
    kept = [(1, a), (2, b), (3, c), (None, prose(9, 60)), (5, None), (5, "")]
    assert got in (Counter([*kept, (3, d)]), Counter([*kept, (3, d + " more")]))


def test_mixing_takes_rows_of_one_id_apart(spark, sf_dir, docs):
    texts = [prose(i, 20 + i % 60) for i in range(400)]
    df = spark.createDataFrame([([1, None, i][i % 3], t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)], docs.schema)
    times = Counter(r.text for r in p.mixing_stage(spark, df, sf_dir).collect())
    sizes, taken = Counter(), Counter()
    for i, t in enumerate(texts):
        sizes["ab"[i % 2]] += len(t.split())
        taken["ab"[i % 2]] += times[t] * len(t.split())
    assert max(times.values()) <= 2
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 0.02 * t + 80


def test_clashing_columns(spark, sf_dir, docs):
    """Columns of any name come through all stages as they were."""
    names = ["kept", "k", "own_label", "own_id", "copies", "copy", "n_words", "_n", "row", "nth", "name", "n", "own_key", "f0", "score", "size", "target", "rate", "class_id", "grams", "root", "base_failed", "with.dot"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    plain, kept = docs, wide
    for name, stage in p.STAGES[:-1]:
        kept, plain = stage(spark, kept, sf_dir).cache(), stage(spark, plain, sf_dir).cache()
        assert kept.columns == wide.columns, name
        assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in plain.collect()), name
        assert all(r[n] == f"{n} {r.doc_id}" for r in kept.where("doc_id is not null").limit(50).collect() for n in names), name
    assert p.tokens_stage(spark, kept, sf_dir).count() == plain.count()


def test_null_columns_and_repeated_rows(spark, sf_dir, docs):
    """A row of nulls and a text repeated by a third of all rows crash no stage."""
    base = docs.where("doc_id < 60 and length(text) > 200").limit(30)
    rows = [tuple(r) for r in base.collect()]
    df = spark.createDataFrame(rows + rows[:1] * (len(rows) // 2) + [(None,) * 5] * 3, docs.schema)
    for name, stage in p.STAGES:
        got = stage(spark, df, sf_dir).collect()
        if name == "near_duplicates":
            assert len(got) <= len(rows) + 1 and sum(r.doc_id is None for r in got) == 1
        if name == "tokens":
            assert len(got) == df.count()


def test_empty(spark, sf_dir, docs):
    none = docs.where(F.lit(False))
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert p.run(spark, sf_dir).count() > 100
