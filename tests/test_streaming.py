"""A stream of cells into the store, with a failure on the way."""

import pytest
from pyspark.sql import functions as F

from tissueflow.sources import cell_store
from tissueflow.streaming import cells as streaming

SCHEMA = "sample_id string, cell_idx long, label int"


def files(spark, path, first, n):
    for k in range(first, first + n):
        rows = [(f"S{i % 2}", i, k) for i in range(10 * k, 10 * k + 10)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_every_row_is_there_once(spark, tmp_path, monkeypatch):
    came, store, checkpoint = (str(tmp_path / x) for x in ("came", "store", "checkpoint"))
    files(spark, came, 0, 3)
    append, calls = cell_store.append, []

    def dies_after_the_second(*args):
        done = append(*args)
        calls.append(args[2])
        if len(calls) == 2:
            raise RuntimeError("killed after the load took effect, before the stream noted it")
        return done

    monkeypatch.setattr(cell_store, "append", dies_after_the_second)
    with pytest.raises(Exception, match="killed"):
        streaming.append_stream(source(spark, came), store, checkpoint).awaitTermination()
    assert cell_store.read(spark, store).count() == 20
    streaming.append_stream(source(spark, came), store, checkpoint).awaitTermination()
    assert calls == ["stream-0", "stream-1", "stream-1", "stream-2"]
    files(spark, came, 3, 1)
    streaming.append_stream(source(spark, came), store, checkpoint).awaitTermination()
    got = cell_store.read(spark, store)
    assert sorted(r["cell_idx"] for r in got.collect()) == list(range(40)) and got.filter(F.col("label") == 3).count() == 10
