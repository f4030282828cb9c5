"""Training material over sparse voxels: soft targets, directional supports, balanced samples, dataset summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import spatial

SLICE = ["group_id", "slice_seq"]
IGNORED = -100


def soft_targets(voxels: DataFrame, class_id: int, radius: float = 2.0, sigma: float = 1.0) -> DataFrame:
    """Voxels (group_id, slice_seq, x, y, z, label) with the soft target of a class - 1 on it, a Gaussian of the distance
    to its nearest voxel up to twice the radius, 0 beyond and where the label is ignored - and the boundary, 1 on
    background within the radius."""
    reach = max(2 * radius, 1.0)
    axes = ("x", "y", "z")
    own = voxels.where(F.col("label") == class_id).select(*SLICE, *axes)
    near = spatial.distance_join(voxels.where(F.col("label") != class_id).select(*SLICE, *axes), own, reach, SLICE, axes).groupBy(*SLICE, *axes).agg(F.min("distance").alias("_d"))
    df = voxels.join(near, [*SLICE, *axes], "left")
    soft = F.when(F.col("label") == IGNORED, 0.0).when(F.col("label") == class_id, 1.0).otherwise(F.coalesce(F.exp(-0.5 * (F.col("_d") / max(sigma, 1e-3)) ** 2), F.lit(0.0)))
    edge = F.coalesce((F.col("label") == 0) & (F.col("_d") <= radius), F.lit(False))
    return df.select(*SLICE, *axes, soft.alias("soft_target"), edge.cast("int").alias("boundary"))


def directional_supports(voxels: DataFrame, value: str, length: int = 11) -> DataFrame:
    """For each voxel the mean value along `length` cells centred on it: the best of X, Y and both diagonals, where a cell
    has the greatest value of its neighbours in z, and vertically, where it has that of its neighbours in x and y. Cells
    without a voxel are 0. Every slice is a task: its voxels are bounded by the grid."""
    if length < 3 or length % 2 == 0:
        raise ValueError("length must be odd and at least 3")
    reach = range(-(length // 2), length // 2 + 1)
    one = (-1, 0, 1)
    lines = {"horizontal": [[(i * a, i * b, 0) for i in reach] for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))], "vertical": [[(0, 0, i) for i in reach]]}
    spread = {"horizontal": [(0, 0, c) for c in one], "vertical": [(a, b, 0) for a in one for b in one]}

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["x", "y", "z"]].to_numpy(np.int64)
        low = at.min(axis=0) - length
        shape = at.max(axis=0) + length + 1 - low
        key = lambda p: np.ravel_multi_index((p - low).T, shape)
        order = np.argsort(key(at), kind="stable")
        keys, held = key(at)[order], pdf[value].to_numpy(float)[order]

        def look(p: np.ndarray) -> np.ndarray:
            k = key(p)
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where(keys[i] == k, held[i], 0.0)

        out = pdf[[*SLICE, "x", "y", "z"]].copy()
        for name, ways in lines.items():
            cell = {o: np.max([look(at + o + np.array(s)) for s in spread[name]], axis=0) for way in ways for o in way}
            out[f"{name}_support"] = np.clip(np.max([np.mean([cell[o] for o in way], axis=0) for way in ways], axis=0), 0, 1)
        return out

    schema = voxels.select(*SLICE, "x", "y", "z", F.lit(0.0).alias("horizontal_support"), F.lit(0.0).alias("vertical_support")).schema
    return voxels.select(*SLICE, "x", "y", "z", value).groupBy(*SLICE).applyInPandas(work, schema)


def _hashed(*parts: Column | str | int) -> Column:
    """A whole number below 2^32 from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def balanced_sample(rows: DataFrame, key: str, category: str, weights: dict[str, float], n: int, seed: int = 42, jitter: int = 0, buckets: int = 256) -> DataFrame:
    """n draws (draw, the row's key and category, jitter_x, _y, _z): each draws a category by its weight among those that
    have rows, then a row of it, with replacement. Rows are numbered within buckets of a category and buckets by their
    counts, so that no category is one task; equal seeds give equal draws."""
    held = rows.where(F.col(category).isin(*weights)).select(F.col(key).alias("_k"), F.col(category).alias("_c"), (_hashed(seed, F.col(key)) % buckets).alias("_b"), _hashed(seed, "row", F.col(key)).alias("_h"))
    inside = held.withColumn("_i", F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_h", "_k")) - 1)
    sizes = held.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_from", F.sum("_n").over(Window.partitionBy("_c").orderBy("_b")) - F.col("_n"))
    totals = sizes.groupBy("_c").agg(F.sum("_n").alias("_total"))
    worth = F.create_map(*(F.lit(v) for pair in weights.items() for v in pair))[F.col("_c")].cast("double")
    upto = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    shares = totals.withColumn("_w", worth).withColumn("_high", F.sum("_w").over(upto)).withColumn("_sum", F.sum("_w").over(Window.partitionBy()))
    shares = shares.select("_c", "_total", ((F.col("_high") - F.col("_w")) / F.col("_sum")).alias("_low"), (F.col("_high") / F.col("_sum")).alias("_high"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", _hashed(seed, "category", F.col("draw")) / F.lit(2.0**32))
    picked = draws.join(F.broadcast(shares), (F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
    spot = picked.select("draw", "_c", (_hashed(seed, "place", F.col("draw")) % F.col("_total")).alias("_spot"))
    located = spot.join(sizes, "_c").where("_spot >= _from AND _spot < _from + _n").select("draw", "_c", "_b", (F.col("_spot") - F.col("_from")).alias("_i"))
    moved = [(_hashed(seed, axis, F.col("draw")) % (2 * jitter + 1) - jitter).cast("int").alias(f"jitter_{axis}") for axis in "xyz"]
    return located.join(inside, ["_c", "_b", "_i"]).select("draw", F.col("_k").alias(key), F.col("_c").alias(category), *moved)


def dataset_summary(raw: DataFrame, keys: tuple[str, ...] = ("group_id", "slice_seq"), least_grid: tuple[int, int, int] = (400, 400, 200)) -> DataFrame:
    """Per file of raw rows (x, y, z, label): rows that are kept (finite, rounded to cells that are not negative), how
    many have each label (limited to 0..2), the bounds of their cells, the grid that holds all files and the file's
    class: the rarest label it has, pole, line or background."""
    cells = [C.voxel(F.col(c)).alias(c) for c in "xyz"]
    given = F.round(C.number(F.col("label")))
    label = F.when(given.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(2), given))).cast("int").alias("label")
    df = raw.select(*keys, *cells, label).where("x >= 0 AND y >= 0 AND z >= 0 AND label IS NOT NULL")
    counts = [F.count_if(F.col("label") == k).alias(f"label_{k}") for k in range(3)]
    bounds = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    per = df.groupBy(*keys).agg(F.count("*").alias("rows"), *counts, *bounds)
    grid = per.agg(*(F.greatest(F.lit(least), F.max(f"max_{c}") + 1).cast("int").alias(f"grid_{c}") for c, least in zip("xyz", least_grid, strict=True)))
    kind = F.when((F.col("label_1") > 0) & (F.col("label_2") > 0), "both").when(F.col("label_1") > 0, "pole").when(F.col("label_2") > 0, "line").otherwise("background")
    return per.withColumn("bucket", kind).crossJoin(F.broadcast(grid))
