"""Joins by place. A distance predicate alone plans as a nested loop, so both sides get cells of the radius, one side is
copied to the cells around its own, and Catalyst plans an equi-join with the distance as residual."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from linecrest.operators.voxels import SLICE


def distance_join(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str], axes: Sequence[str], suffix: str = "_r") -> DataFrame:
    """Pairs with equal `on` columns at most radius apart along the axes; right's columns get the suffix, and distance
    is added. The right side is copied to 3 cells per axis."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.select("*", *(cell(c).alias(f"_cell{i}") for i, c in enumerate(axes)))
    b = right.select(*(F.col(c) if c in on else F.col(c).alias(c + suffix) for c in right.columns))
    for i, c in enumerate(axes):
        b = b.withColumn(f"_cell{i}", F.explode(F.sequence(cell(c + suffix) - 1, cell(c + suffix) + 1)))
    squares = [(F.col(c) - F.col(c + suffix)) ** 2 for c in axes]
    met = a.join(b, [*on, *(f"_cell{i}" for i in range(len(axes)))]).drop(*(f"_cell{i}" for i in range(len(axes))))
    return met.withColumn("distance", F.sqrt(sum(squares[1:], squares[0]))).where(F.col("distance") <= radius)


#: Half of the 26 neighbours of a cell: those that come after it in the order of (z, y, x).
HALF_NEIGHBOURS = [(x, y, z) for z in (0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]


def neighbour_pairs(voxels: DataFrame) -> DataFrame:
    """Pairs of touching voxels (26 neighbours) of a slice, each once: 13 shifted keys and an equi-join."""
    shifts = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in HALF_NEIGHBOURS))
    a = voxels.select(*SLICE, "x", "y", "z", F.explode(shifts).alias("s"))
    a = a.select(*SLICE, F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("z") + F.col("s.dz")).alias("z"))
    return a.join(voxels.select(*SLICE, "x", "y", "z"), [*SLICE, "x", "y", "z"]).select(*SLICE, "x0", "y0", "z0", "x", "y", "z")


def touching_components(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each distinct voxel the index of the first one (in the order of z, y, x) of its 26-connected component."""
    order = np.lexsort((x, y, z))
    x, y, z = (v[order].astype(np.int64) - int(v.min()) + 1 if len(v) else v.astype(np.int64) for v in (x, y, z))
    if not len(x):
        return np.empty(0, np.int64)
    wide, high = int(x.max()) + 2, int(y.max()) + 2
    key = (z * high + y) * wide + x
    heads, tails = [], []
    for dx, dy, dz in HALF_NEIGHBOURS:
        near = key + (dz * high + dy) * wide + dx
        at = np.minimum(np.searchsorted(key, near), len(key) - 1)
        hit = np.flatnonzero(key[at] == near)
        heads.append(hit)
        tails.append(at[hit])
    a, b = np.concatenate(heads), np.concatenate(tails)
    first = np.arange(len(key))
    while len(a):
        ra, rb = first[a], first[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(first, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:  # every pointer to its root
            up = first[first]
            if (up == first).all():
                break
            first = up
    out = np.empty(len(key), np.int64)
    out[order] = order[first]
    return out


#: Slices of a group that a task takes together: small ones cost more to hand over than to work out.
TOGETHER = 8


def by_slices(df: DataFrame) -> GroupedData:
    """Groups of a few slices that follow one another."""
    return df.groupBy("group_id", F.floor(F.col("slice_seq") / TOGETHER))


def connected_components(voxels: DataFrame, grid_x: int, grid_y: int, carried: Sequence[str] = ()) -> DataFrame:
    """group_id, slice_seq, x, y, z, what is carried, and component, the least linear key (z * gy + y) * gx + x of the
    voxel's component. A slice is bounded by its grid, so a few are a group for one task."""
    kept = [*SLICE, "x", "y", "z", *carried]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (pdf[c].to_numpy(np.int64) for c in ("x", "y", "z"))
        # layers of slices lie apart, so no components of two of them touch
        base, number = z.min(), pd.factorize(pdf["slice_seq"])[0]
        first = touching_components(x, y, z - base + number * (z.max() - base + 2))
        key = (z * grid_y + y) * grid_x + x
        return pdf[kept].assign(component=key[first])

    schema = voxels.select(*kept).withColumn("component", F.lit(0).cast("long")).schema
    return by_slices(voxels.select(*kept)).applyInPandas(label, schema)


def clusters(points: DataFrame, keys: Sequence[str], axes: Sequence[str], radius: float, order: str) -> DataFrame:
    """points with `cluster`, the least `order` value among those that steps of at most radius reach within equal keys
    (DBSCAN of one point). Groups are the objects of a window of slices."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(cluster=pdf[order].to_numpy()[near_components(pdf[list(axes)].to_numpy(float), radius)])

    schema = points.withColumn("cluster", F.col(order)).schema
    return points.groupBy(*keys).applyInPandas(label, schema)


def near_components(p: np.ndarray, radius: float) -> np.ndarray:
    """For each point the smallest index that steps of at most radius reach."""
    first = np.arange(len(p))
    if len(p) < 2:
        return first
    cell = np.floor(p / radius).astype(np.int64)
    where: dict[tuple, list[int]] = {}
    for i, c in enumerate(map(tuple, cell.tolist())):
        where.setdefault(c, []).append(i)
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * p.shape[1]), -1).reshape(-1, p.shape[1]).tolist()

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = first[first[i]]
            i = first[i]
        return i

    for c, members in where.items():
        around = [j for s in steps for j in where.get(tuple(a + b for a, b in zip(c, s, strict=True)), ())]
        for i in members:
            near = np.asarray(around)[((p[around] - p[i]) ** 2).sum(1) <= radius * radius]
            for j in near.tolist():
                a, b = root(i), root(j)
                if a != b:
                    first[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(p))])
