"""From raw documents to packed training sequences: each stage's rows are stored and are the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecrest.llm import common, jaccard, mixing, packing, quality, substring

#: Columns of documents; all stages but the last return them.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for them; the classifier's threshold is 0.3."""
    labels = common.read(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels), keep=tuple(c for c in docs.columns if c != "doc_id"))
    return scored.where("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of the n-gram Jaccard join; of several rows of that doc_id
    in one component the text with the least hash, and one of equal rows. Rows without doc_id or without words stay."""
    with common.scratch():
        joined = common.stage(jaccard.jaccard_join(docs).where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "component_id", "text_hash"), "near-copies")
        first = joined.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("_first"))
        gone = joined.join(first, "doc_id", "left").where("doc_id <> component_id OR text_hash <> _first").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_text")).distinct()
        gone = common.hold(common.stage(gone, "gone"))
        repeated = joined.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_again"), F.col("text_hash").alias("_again_text"))
        repeated = common.hold(common.stage(repeated, "repeated"))
    kept = docs.join(common.small(gone), (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_text"]), "left_anti")
    if repeated.isEmpty():
        return kept
    marked = kept.join(common.small(repeated), (kept["doc_id"].cast("long") == repeated["_again"]) & (F.xxhash64(kept["text"].cast("string")) == repeated["_again_text"]), "left")
    alone = marked.where("_again IS NULL").select(*docs.columns)
    return alone.unionByName(marked.where("_again IS NOT NULL").dropDuplicates(["_again", "_again_text"]).select(*docs.columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut out."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes it, whole or, for what is left, its first words."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    mixed = mixing.sainte_lague_mix(docs.select("doc_id", *rest), keep=rest).where("taken > 0")
    parts = mixed.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    words = (F.col("taken") - F.col("_part") * F.col("size")).cast("int")
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORD), F.lit(0))
    text = F.when(words >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(spaced, F.lit(1), words), ""))
    out = parts.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Votes of latent-semantic neighbours and chains of minimizers are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
