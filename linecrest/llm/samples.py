"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, held: int = 0) -> DataFrame:
    """text and label (0 or 1) of up to per_class documents of each class outside the held-out fold, as a stored table.
    The documents whose hash is smallest are taken, so the choice does not hang on partitions. Rows without doc_id, label
    or document are no examples; repeated rows are one; a doc_id with both labels is none; of several texts of a doc_id the
    one with the least hash counts."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("_id"), folds) != held))
    rows = rows.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other")
    picked = None
    for c in (0, 1):
        own = rows.where(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class).select("_id", "label")
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "_id")  # 2 * per_class rows are broadcast
    one = texts.groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return common.stage(one.select(F.xxhash64("_id").alias("place"), "text", "label"), f"sample-{label}")
