import corpus_pipeline
from tissueflow.llm import decontamination, langid, neardup

SF = "/root/testdata/sf0.01"


def test_stages(spark, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, kept = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, SF), "test-stage")
        assert now.columns == docs.columns
        kept.append(now.count())
    assert kept[0] >= kept[1] > kept[2] > kept[3] > 0
    assert neardup.near_duplicates(now).filter("not kept").join(now.groupBy("doc_id").count().filter("count > 1"), "doc_id", "left_anti").count() == 0
    assert decontamination.leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert len(last) == kept[4]
    last.sort(key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(last, last[1:], strict=False))
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["ids_crc32"]) for r in last)


def test_odd_and_empty(spark, odd, empty, tmp_path):
    d = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, frame in (("odd", d), ("empty", empty)):
        path = str(tmp_path / name)
        frame.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "don't panic"), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path).count()
        assert (got > 0) == (name == "odd")


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.accepted(docs, langid.training_text(docs)).count() >= 0.99 * docs.count()
