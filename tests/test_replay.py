"""A stream of slices: arrivals out of order, batches run again, failures."""

import pytest
from pyspark.sql import functions as F

from linecrest.streaming import replay

SLICES = "group_id string, slice_seq long, arrived int"


def arrive(spark, path, *rows):
    spark.createDataFrame(rows, SLICES).coalesce(1).write.mode("append").parquet(path)


def test_arrivals_out_of_order_are_reported(spark, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, ("g", 5, 0), ("g", 4, 1), ("g", 5, 2), ("h", 1, 0), ("g", 20, 3))
    q = replay.windows(spark.readStream.schema(SLICES).parquet(path), order="arrived").writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["group_id"], r["slice_seq"], r["status"], r["observed_slices"]) for r in spark.table("arrivals").collect())
    assert got == [("g", 4, "late", ""), ("g", 5, "duplicate", ""), ("g", 5, "ok", "5"), ("g", 20, "ok", "20"), ("h", 1, "ok", "1")]


def test_replay_publishes_by_slice_and_records_failures(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "c"))
    stream = lambda: spark.readStream.schema(SLICES).parquet(path)
    stage = lambda df: df.withColumn("twice", F.col("arrived") * 2)
    arrive(spark, path, ("g", 1, 1), ("g", 2, 2))
    replay.replay(stream(), stage, target, checkpoint).awaitTermination()
    arrive(spark, path, ("g", 2, 7), ("g", 3, 3))

    def broken(df):
        raise ValueError("no scores")

    with pytest.raises(Exception, match="no scores"):
        replay.replay(stream(), broken, target, checkpoint).awaitTermination()
    assert sorted((r["slice_seq"], r["error"]) for r in replay.failures(spark, target).collect()) == [(2, "ValueError"), (3, "ValueError")]
    rows = lambda: sorted((r["slice_seq"], r["twice"]) for r in replay.published(spark, target).collect())
    assert rows() == [(1, 2), (2, 4)]
    replay.replay(stream(), stage, target, checkpoint).awaitTermination()
    assert rows() == [(1, 2), (2, 14), (3, 6)]
    assert [(r["group_id"], r["slice_seq"]) for r in replay.latest(spark, target).collect()] == [("g", 3)]
