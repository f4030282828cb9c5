"""Sessions as streams of slices: windows by sequence number, and a resumable replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from linecrest.operators import slices
from linecrest.params import Reconstruction

WINDOWS = "group_id string, slice_seq long, status string, observed int, first_seq long, observed_slices string"


def windows(arrivals: DataFrame, gap: int = Reconstruction.max_span_slices, order: str | None = None) -> DataFrame:
    """A row per arriving slice (group_id, slice_seq): the slices of [S - gap, S] seen so far. Numbers may skip; one that
    is not above the group's last is `late`, or `duplicate` if it was seen, and opens no window. Slices of a micro-batch
    arrive by the column `order`, or, as nothing else tells, by their numbers. The state of a group is its last gap + 1
    numbers: what is older is dropped by number, not by time."""
    by = order or "slice_seq"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        rows = []
        arrived = pd.concat(list(batches))  # a group's slices of a micro-batch may come in several parts
        for seq in arrived.sort_values([by, "slice_seq"], kind="stable")["slice_seq"].tolist():
            if seen and seq <= seen[-1]:
                rows.append((key[0], seq, "duplicate" if seq in seen else "late", 0, None, ""))
                continue
            seen = [s for s in seen if s >= seq - gap] + [seq]
            rows.append((key[0], seq, "ok", len(seen), seen[0], ";".join(map(str, seen))))
        state.update((seen,))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WINDOWS.split(", ")]).astype({"first_seq": "Int64"})

    return arrivals.groupBy("group_id").applyInPandasWithState(step, WINDOWS, "seen array<long>", "append", GroupStateTimeout.NoTimeout)


def replay(arrivals: DataFrame, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True):
    """Run `stage` on each batch of arriving slices and publish its rows (with group_id and slice_seq) as partitions of
    slices, those of the batch in place of older ones: a batch costs what it holds, and one that is run again after a
    failure leaves the same table. Each batch is a row of `log` (version, group_id, the newest slice, when). If the stage
    fails, the batch's slices are rows of `failures` with the error, nothing is published, and the stream stops."""

    def publish(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        arrived = batch.select("group_id", "slice_seq").distinct()
        try:
            rows = stage(batch)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id", "slice_seq").parquet(f"{target}/rows")
        except Exception as e:
            told = arrived.select(F.lit(version).alias("version"), "group_id", "slice_seq", F.lit(type(e).__name__).alias("error"), F.lit(str(e)[:2000]).alias("message"), F.current_timestamp().alias("at"))
            told.write.mode("overwrite").json(f"{target}/failures/batch={version}")
            raise
        newest = arrived.groupBy("group_id").agg(F.max("slice_seq").alias("slice_seq"))
        newest.select(F.lit(version).alias("version"), "group_id", "slice_seq", F.current_timestamp().alias("published_at")).write.mode("overwrite").json(f"{target}/log/batch={version}")

    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(availableNow=True) if once else writer).start()


def published(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/rows")


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Per group the newest slice that was published, and when its batch was."""
    log = spark.read.schema("version long, group_id string, slice_seq long, published_at timestamp").json(f"{target}/log")
    return slices.latest(log.drop("batch"), "slice_seq", ("group_id",))


def failures(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("version long, group_id string, slice_seq long, error string, message string, at timestamp").json(f"{target}/failures").drop("batch")
