"""The pipeline stage by stage on a small table: columns stay, each stage's decision takes effect."""

import corpus_pipeline
from test_operators import SCHEMA, clash, rows  # noqa: F401


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"file://{tmp_path}/{name}"
        stage(spark, docs, f"file://{tmp_path}").write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, f"file://{tmp_path}")
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    final = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert final.count() == packed.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
