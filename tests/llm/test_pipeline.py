import corpus_pipeline
from scriptloom.llm import queries


def test_pipeline(spark, corpus, tmp_path):
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.filter("n_chars <> length(text)").count() == 0
    left = {r.doc_id for r in docs.collect()}
    assert 20 < len(left) < len(corpus)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == left


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; null languages and sources; columns named like results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, language int, component_id double"
    text = "the quick brown fox jumps over the lazy dog and runs away from all the other animals in this wood today with joy"
    rows = [(1, text, "en", None, 5, "k", 1, 1.0), (2, f"{text} again", None, "s", 5, None, None, None), (3, None, None, None, None, None, None, None), (None, "the dog of the fox and all the others", "en", "s", 5, "k", 2, 2.0)]
    for name, given in (("none", []), ("odd", rows)):
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / step))
            docs = spark.read.parquet(str(tmp_path / name / step))
        if given:
            assert {r.doc_id for r in docs.collect()} >= {1, None} and docs.filter("doc_id = 1").first().kept == "k"
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == docs.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
