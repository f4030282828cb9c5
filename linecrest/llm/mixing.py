"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Every source gets a target of words. The mix is cut into equal blocks, and a highest-quotients apportionment (divisors
1, 3, 5, ...) gives each shard of each source a whole number of them. Within a shard the documents lie in a seeded
order, and its blocks are taken from the front, again and again if they are more than the shard has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The characters that end a word are space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: About how many rows share a shard, and how many blocks a shard and the smallest target get at least, of a word or more.
SHARD_ROWS = 4096
BLOCKS = 128


def _seeded(seed: int, what: str) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:{what}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("_size").cast("string")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row per source with its target, from source and source_size. Targets are weight * level, at most `most` times
    the source's size; the level is the one at which they sum to all sizes. That is where resharing the excess by weight
    ends: sources are capped in the order of size / weight, so the first ones of that order are."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", "_place")
    everything = Window.partitionBy()
    df = sources.withColumn("_place", F.row_number().over(order) - 1)
    df = df.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * most).withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight"))
    df = df.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_free", F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("_total", F.sum("source_size").over(everything))
    # the level if exactly the sources before this one are capped; the right one is the first that its source can take
    df = df.withColumn("_level", (F.col("_total") - F.col("_capped")).cast("double") / F.col("_free"))
    df = df.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    return df.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_level")).alias("target"), F.col("_total").alias("total"))


def quotas(cells: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Cells with their block size and a whole number of blocks each, `quota`, that sum to total / block_size.
    cells: target (of the cell's source), source_size, cell_size, total. A cell's vote is its share of the target.
    The divisor lies so near total / house that a cell's quota is known but for the last few blocks; only the quotients
    of these are ranked."""
    everything = Window.partitionBy()
    df = cells.withColumn("_cells", F.count("*").over(everything)).withColumn("_source_cells", F.count("*").over(Window.partitionBy("source")))
    # the smallest target of any source sets the size too, else a source of less than half a block would get none
    least = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target") / F.col("_source_cells"))).over(everything), F.lit(1.0))
    df = df.withColumn("block_size", F.greatest(F.lit(1), F.floor(F.least(F.col("total") / F.col("_cells"), least) / blocks)))
    df = df.withColumn("_house", F.floor(F.col("total") / F.col("block_size")))
    df = df.withColumn("_vote", F.col("target") * F.col("cell_size") / F.greatest(F.col("source_size"), F.lit(1)))
    per_vote = lambda sign: (F.col("_house") + sign * (F.col("_cells") / 2 + 1)) / F.greatest(F.col("total"), F.lit(1))
    df = df.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_vote") * per_vote(-1) - 0.5)))
    df = df.withColumn("_most", F.when(F.col("_vote") > 0, F.ceil(F.col("_vote") * per_vote(1) + 0.5)).otherwise(F.lit(0)))
    df = df.withColumn("_open", F.col("_house") - F.sum("_sure").over(everything))
    seats = df.where("_most > _sure").select("source", "shard", "_open", "_vote", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat"))
    seats = seats.withColumn("_rank", F.row_number().over(Window.orderBy((F.col("_vote") / (2 * F.col("_seat") - 1)).desc(), F.col("source").asc_nulls_last(), "shard", "_seat")))
    won = seats.where("_rank <= _open").groupBy("source", "shard").agg(F.count("*").alias("_won"))
    df, won = df.alias("c"), won.alias("w")
    joined = df.join(won, F.col("c.source").eqNullSafe(F.col("w.source")) & (F.col("c.shard") == F.col("w.shard")), "left")
    return joined.select("c.*", (F.col("c._sure") + F.coalesce("w._won", F.lit(0))).alias("quota")).drop("_cells", "_source_cells", "_house", "_vote", "_sure", "_most", "_open")


def sainte_lague_mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row, and the columns named by keep.

    Null and empty texts have size 0 and give nothing; a null source is a source, the last one; equal rows are taken as
    the seeded order has them; where all texts are empty nothing is taken. No document gives more than `most` times its
    size. Only source and shard totals are compared with one another; documents are ranked within a shard."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("_size"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    sources = base.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows"))
    goals = targets(sources.select("source", "source_size"), weights, most).alias("g")
    facts = sources.alias("s").join(goals, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s._rows", "g.source_size", "g.target", "g.total").withColumn("_shards", F.ceil(F.col("_rows") / SHARD_ROWS)).drop("_rows")
    facts = common.stage(facts, "sources")  # broadcast if few, since a shuffle of documents by source would gather a hot source
    rows = base.alias("d").join(common.small(facts).alias("f"), F.col("d.source").eqNullSafe(F.col("f.source"))).select("d.*", "f.source_size", "f.target", "f.total", "f._shards")
    rows = rows.withColumn("shard", (F.conv(F.substring(_seeded(seed, "shard"), 1, 8), 16, 10).cast("long") % F.col("_shards")).cast("long"))
    cells = rows.groupBy("source", "shard").agg(F.sum("_size").alias("cell_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("total").alias("total"))
    quota = common.stage(quotas(cells).select("source", "shard", "cell_size", (F.col("quota") * F.col("block_size")).alias("_words")), "quotas")
    rows = rows.alias("r").join(common.small(quota).alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.shard") == F.col("q.shard"))).select("r.*", "q.cell_size", F.least("q._words", F.col("q.cell_size") * most).alias("_words"))
    order = Window.partitionBy("source", "shard").orderBy(_seeded(seed, "order"), F.col("doc_id").asc_nulls_last(), "_size")
    rows = rows.withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rounds = F.floor(F.col("_words") / F.greatest(F.col("cell_size"), F.lit(1)))
    more = F.col("_words") - rounds * F.col("cell_size")
    rows = rows.withColumn("taken", (rounds * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), more - F.col("_end") + F.col("_size")))).cast("long"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), "taken", *(F.col(f"_keep_{c}").alias(c) for c in keep))
