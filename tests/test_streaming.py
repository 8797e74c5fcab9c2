from quillspan.streaming.ingest import DOCUMENTS, ingest


def test_new_files_are_taken_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    one = spark.createDataFrame([(1, "word " * 200, "en", "s", 1000)], DOCUMENTS)
    one.write.mode("append").parquet(source)
    ingest(spark, source, target, checkpoint)
    ingest(spark, source, target, checkpoint)
    first = spark.read.parquet(target).count()
    spark.createDataFrame([(2, "other " * 30, "en", "s", 180)], DOCUMENTS).write.mode("append").parquet(source)
    ingest(spark, source, target, checkpoint)
    got = spark.read.parquet(target)
    assert first == 2 and got.count() == 3 and got.filter("doc_id = 2").count() == 1
