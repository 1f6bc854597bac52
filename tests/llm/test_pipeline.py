import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from emberline.llm import near_dedup, pii, quality_classifier, quality_rules

    spark.conf.set(pii.KEY, "k")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{k}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        had = {r.doc_id for r in last.select("doc_id").collect()}
        assert kept <= had, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            assert all(r.kept for r in quality_rules.judge(docs, quality_rules.references(last)).collect())
        if k == 2:
            assert all(r.kept for r in near_dedup.near_duplicates(docs, 5, 80).collect())
        if k == 3:
            original = {r.doc_id: r.text for r in last.collect()}
            own = pii.Pseudonyms("k")
            assert all(r.text == own.text(original[r.doc_id])[0] for r in docs.collect())
    assert kept == had  # packing drops nothing
    assert 0.3 * before < len(kept) < before
    assert quality_classifier.THRESHOLD == 0.3
    spark.conf.unset(pii.KEY)


def test_nulls_repeats_and_clashing_columns(spark, sf_dir):
    """Every stage after the other on rows that a pipeline may meet, and on none."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.where("doc_id < 40")
    odd = some.limit(3).select(*[F.lit(None).cast(kind).alias(c) for c, kind in docs.dtypes]).unionByName(some.limit(2).withColumn("text", F.lit("")))
    long_ = some.limit(1).withColumn("text", F.repeat(F.lit("a" * 1000), 300)).withColumn("doc_id", F.lit(10**9).cast("long"))
    mixed = some.unionByName(some).unionByName(odd).unionByName(long_)
    for name in ("__w", "pii", "made", "rep", "reference", "of_words", "sig", "quality_score"):
        mixed = mixed.withColumn(name, F.lit("clash"))
    for rows in (mixed, mixed.limit(0)):
        out = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, out, sf_dir)
            held = made.collect()
            out = spark.createDataFrame(held, made.schema)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        ids = [r.doc_id for r in held]
        assert bool(ids) == (rows is mixed)
