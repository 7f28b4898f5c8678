import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_what_is_theirs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, names = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == names and 0 < out.count() <= docs.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    kept = spark.read.parquet(f"{tmp_path}/0")
    clean = first.join(labels, "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "Some words in a row.", "en", "s", 20), (2, "Some words in a row.", "en", "s", 20)]])
def test_edges(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert (docs.count() == 0) == (not rows)
