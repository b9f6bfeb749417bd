import corpus_pipeline
from tests.llm.conftest import ODD
from voxlog.llm.shared import Scratch

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, scratch, seen = docs.columns, Scratch(spark, "t"), [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, DATA))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] > seen[3] > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.select("doc_id").distinct().count() == seen[3]
    assert corpus_pipeline.run(spark, DATA).agg({"length": "sum"}).first() == last.agg({"length": "sum"}).first()


def test_stages_with_odd_rows(spark, docs):
    from pyspark.sql import functions as F

    df = docs(ODD).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0
        assert stage(spark, df, DATA).count() > 0
    near = corpus_pipeline.near_duplicates(spark, df, DATA).collect()
    assert sum(r["doc_id"] == 4 for r in near) == 1 and not any(r["doc_id"] == 5 for r in near)
