"""Evidence of questions is found for items of any number of words."""

from quillspan.plans import catalog


def test_items_of_one_word_and_of_stop_words_have_evidence(spark, tmp_path):
    spark.createDataFrame([(1, "one vex two", "en"), (2, "and of", "en"), (3, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "vex"), (2, "and of"), (3, "absent words here now")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # Item 2 has no terms, so no search finds the document that holds it.
    assert [tuple(r) for r in catalog.queries()["retrieval_metrics"](spark, str(tmp_path)).collect()] == [(2, 0.5, 0.5, 0.5)]
