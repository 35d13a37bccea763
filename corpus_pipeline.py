"""The corpus pipeline: quality rules, quality classifier, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec
from palimpsest.llm.common import materialize, scratch_path, table, whole_rows
from palimpsest.llm.queries import MODEL
from palimpsest.sources.scratch import cleared, delete


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or the learned decision list go.

    Null and empty texts fail the base limits, so they go. Repeated rows are judged
    alike, texts of any length whole. Without labels only the base limits decide.
    """
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select("row.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores as poor go.

    Null and empty texts and null metadata are scored like any other; repeated rows get
    the same score. Without labels of both classes all stay.
    """
    rows = quality_classifier.featured(docs)
    model = quality_classifier.fit(rows, table(spark, sf_dir, "labels"))
    return quality_classifier.score(rows, model).where("kept").select("row.*")


def _named(docs: DataFrame) -> DataFrame:
    """Each row as ``row``, with ``name``, a hash of all of it: only equal rows share one. Nothing is written."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in cols])
    return docs.select(whole_rows(docs).alias("row"), F.concat_ws("-", F.hex(F.xxhash64(nulls, *cols)), F.hex(F.xxhash64(F.lit("row"), nulls, *cols))).alias("name"))


def _chosen(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` of ``names`` (name, n: how many rows have it, and more columns), one for each name."""
    kept = rows.join(names.where("n = 1"), "name")
    again = names.where("n > 1")
    if again.limit(1).count():  # only equal rows are sent to be told apart
        kept = kept.unionByName(rows.join(again, "name").dropDuplicates(["name"]))
    return kept


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id (null last).

    Rows are judged by their own texts, also where ids repeat or are null; of equal rows
    one stays. Texts without a word (null, empty, blank) are near to nothing: of each
    different row with one, one stays.
    """
    rows = _named(docs)
    classes = ngram_join.ngram_classes(rows.select("name", "row.text"), key="name").groupBy("name").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n"))
    ids = rows.select("name", "row.doc_id").distinct()
    heads = classes.join(ids, "name").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name", "n")).alias("head"))
    return _chosen(rows, materialize(heads.select("head.name", "head.n"), "near-duplicates")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    Copies belong to rows, not to ids: repeated and null ids are mixed row by row, and
    equal rows come as often as the mix takes them together. A null source is one of its
    own; a text without words is taken once if its source is taken from at all.
    """
    rows = _named(docs)
    mixed = mixing.mix(rows.select("name", "row.doc_id", "row.text", "row.source"), carry=["name"])
    copies = mixed.groupBy("row.name").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    taken = _chosen(rows, materialize(copies, "copies"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document kept, and a digest of what they decode to.

    Null and empty texts are the end id alone; repeated rows are encoded alike.
    """
    return sentencepiece_codec.tokenized(docs, MODEL)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: The learned stages have no SQL form; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's output is written to the shared folder; what it wrote beside that, and
    the input it has read, are deleted once the output stands, so that disk use does not add up over stages."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
