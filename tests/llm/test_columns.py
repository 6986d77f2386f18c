"""The pipeline on tables whose other columns have the names of results, and on shared ids."""

import corpus_pipeline
from tissueflow.llm import langid, mixing, neardup

SF = "/root/testdata/sf0.01"
NAMES = ["lang_pred", "score", "phrase_rate", "cut", "copies", "inclusion", "_source", "size", "times", "taken", "_n", "target", "source_size", "key", "first", "cid", "a", "b", "n", "label", "node", "keep", "row", "kept", "component_id", "registers", "_id", "_key"]


def clashing(docs):
    """docs with a column of each name, whose value tells column and row."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in NAMES})


def test_stages_keep_columns_of_any_name(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = (corpus_pipeline.written(stage(spark, d, SF), "clash-stage") for d in (docs, plain))
        rows = docs.collect()
        assert docs.columns[-len(NAMES) :] == NAMES and rows
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in NAMES)
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())


def test_run_on_clashing_columns(spark, tmp_path):
    clashing(spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, want = (sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(p)).collect()) for p in (tmp_path, SF))
    assert got == want


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = a + " end"
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "x"), (3, c, "y"), (3, c, "x"), (5, near, "s"), (None, a, "s"), (None, a, "t"), (7, None, "s"), (7, None, "s"), (8, "", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"] or 0, r["text"] or "-") for r in neardup.deduplicated(d).collect()))
    assert got == sorted([(1, a), (2, b), (3, c), (0, a), (7, "-"), (8, "-")])
    again = [tuple(r) for r in neardup.deduplicated(d.repartition(5)).filter("doc_id = 3").collect()]
    assert again == [tuple(r) for r in neardup.deduplicated(d).filter("doc_id = 3").collect()]
    one = neardup.deduplicated(spark.createDataFrame([(5, a, "s"), (5, near, "s"), (6, near, "s")], d.schema)).collect()
    assert len(one) == 1 and one[0]["doc_id"] == 5


def test_repeated_and_accepted_alone(spark, odd, empty):
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(empty).count() == 0
    assert all(r["score"] == "x" and r["size"] == 1 and r["rank"] == 5 for r in mixing.repeated(odd).collect())
    texts = langid.training_text(odd)
    assert all(r["score"] == "x" for r in langid.accepted(odd, texts, 1.0).collect())
    assert neardup.deduplicated(empty).count() == 0
