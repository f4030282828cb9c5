"""From labelled voxels to components: statistics, shapes, plausibility gates and parametric poles and lines.

`points` is a table of group_id, slice_seq, component, x, y, z and whatever scores the step reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import spatial
from linecrest.operators.voxels import SLICE, candidates
from linecrest.params import Detection, Grid

COMPONENT = (*SLICE, "component")


def of_class(voxels: DataFrame, class_name: str, grid: Grid = Grid(), p: Detection = Detection()) -> DataFrame:
    """Voxels of pole or line components of enough voxels, with their component and score. Lines go by hysteresis: weak
    components count if they hold a strong voxel."""
    flagged = candidates(voxels, p)
    mask, least, score = ("pole_candidate", p.pole_min_voxels, "pole_score") if class_name == "pole" else ("line_weak", p.line_min_voxels, "line_score")
    flagged = flagged.withColumn("score", F.col(score).cast("float"))
    points = spatial.connected_components(flagged.where(mask), grid.x, grid.y, ("score", "line_strong"))
    # one exchange by component, which aggregates by component need not repeat
    whole = Window.partitionBy(*COMPONENT)
    points = points.withColumn("_n", F.count("*").over(whole)).withColumn("_strong", F.bool_or("line_strong").over(whole))
    if class_name == "line":
        points = points.where("_strong")
    return points.where(F.col("_n") >= least).select(*SLICE, "x", "y", "z", "component", "score")


def _score_stats(score: str = "score") -> list[Column]:
    s = F.col(score).cast("double")
    q = lambda p: F.percentile(s, F.lit(p))
    return [F.count("*").alias("n_voxels"), F.avg(s).alias("score_mean"), F.stddev_pop(s).alias("score_std"), q(0.1).alias("score_p10"), q(0.5).alias("score_p50"), q(0.9).alias("score_p90"), F.max(s).alias("score_max")]


def score_stats(points: DataFrame, score: str = "score") -> DataFrame:
    return points.groupBy(*COMPONENT).agg(*_score_stats(score))


def _extents(v: float) -> list[Column]:
    cells = {c: F.max(c) - F.min(c) + 1 for c in ("x", "y", "z")}
    return [
        *((cells[c] * v).alias(f"{c}_span_ft") for c in ("x", "y", "z")),
        (F.count("*") / (cells["x"] * cells["y"] * cells["z"])).alias("bbox_density"),
        *(F.avg(c).alias(f"center_{c}") for c in ("x", "y", "z")),
        (F.min("z") * v).cast("double").alias("min_z_ft"),
        (F.max("z") * v).cast("double").alias("max_z_ft"),
    ]


def _spans(df: DataFrame, v: float) -> DataFrame:
    return df.withColumn("horizontal_span_ft", F.sqrt(F.col("x_span_ft") ** 2 + F.col("y_span_ft") ** 2)).withColumn("center_z_ft", F.col("center_z") * v)


def extents(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Spans in feet, share of the bounding box, and center."""
    return _spans(points.groupBy(*COMPONENT).agg(*_extents(grid.voxel_ft)), grid.voxel_ft)


def _edge(grid: Grid) -> Column:
    return F.min(F.least(F.col("x"), grid.x - 1 - F.col("x"), F.col("y"), grid.y - 1 - F.col("y"))).alias("edge_distance_vox")


def edge_features(points: DataFrame, grid: Grid = Grid(), width: int = Detection.edge_width) -> DataFrame:
    """How near the component comes to the sides of the slice."""
    return points.groupBy(*COMPONENT).agg(_edge(grid)).withColumn("touches_xy_edge", F.col("edge_distance_vox") <= width)


def covariance(points: DataFrame) -> DataFrame:
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    return points.groupBy(*COMPONENT).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs)).where("n > 2").drop("n")


class Parts:
    """Rows of arrays in runs, one run a component; results have a row per run."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sum(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, self.starts, axis=0)

    def order(self, v: np.ndarray) -> np.ndarray:
        """Rows by run, then value, then as they were."""
        return np.lexsort((v, self.of))

    def quantile(self, v: np.ndarray, q: float) -> np.ndarray:
        if v.ndim == 2:
            return np.stack([self.quantile(c, q) for c in v.T], axis=1)
        up, at = v[self.order(v)], q * (self.sizes - 1)
        low = np.floor(at).astype(np.int64)
        below, above = up[self.starts + low], up[self.starts + np.minimum(low + 1, self.sizes - 1)]
        return below + (at - low) * (above - below)

    def axes(self, around: np.ndarray) -> np.ndarray:
        """Leading directions of rows around a point; the largest component of each (the first of equal ones) is positive."""
        d = np.linalg.eigh(self.sum(around[:, :, None] * around[:, None, :]))[1][:, :, -1]
        top = np.take_along_axis(d, np.round(np.abs(d), 9).argmax(axis=1)[:, None], 1)
        return np.where(top < 0, -d, d)


#: Shape columns of a component.
SHAPES = "principal_dx double, principal_dy double, principal_dz double, principal_verticality double, linearity double, planarity double, scattering double, radius_p50_ft double, radius_p90_ft double, xy_path_length_ft double, xy_endpoint_distance_ft double, xy_tortuosity double, quadratic_rmse_ft double, sag_estimate_ft double, endpoint1_x double, endpoint1_y double, endpoint1_z double, endpoint2_x double, endpoint2_y double, endpoint2_z double"


def shapes_of(p: np.ndarray, sizes: np.ndarray, voxel_ft: float = 0.5) -> np.ndarray:
    """The SHAPES of components, given by their points one after another, all at once. The axis is that of the points
    around their median; linearity, planarity and scattering are those of the sample covariance. A component of one
    point stands upright and has no extent."""
    parts = Parts(sizes)
    n, one = parts.sizes, parts.sizes < 2
    around = p - parts.quantile(p, 0.5)[parts.of]
    axis = np.where(one[:, None], [0.0, 0.0, 1.0], parts.axes(around))
    centred = p - (parts.sum(p) / n[:, None])[parts.of]
    spread = parts.sum(centred[:, :, None] * centred[:, None, :]) / np.maximum(n - 1, 1)[:, None, None]
    e = np.where(n[:, None] > 2, np.maximum(np.linalg.eigvalsh(spread)[:, ::-1], 0), 0)
    forms = np.stack([e[:, 0] - e[:, 1], e[:, 1] - e[:, 2], e[:, 2]], axis=1) / np.maximum(e[:, :1], 1e-9)
    own = axis[parts.of]
    radial = np.linalg.norm(around - (around * own).sum(axis=1, keepdims=True) * own, axis=1) * voxel_ft
    along = (around[:, :2] * parts.axes(around[:, :2])[parts.of]).sum(axis=1)
    line = p[parts.order(along)]
    step = np.linalg.norm(np.diff(line[:, :2], axis=0, prepend=line[:1, :2]), axis=1)
    step[parts.starts] = 0.0
    first, last = line[parts.starts], line[parts.starts + n - 1]
    path, apart = parts.sum(step) * voxel_ft, np.linalg.norm((last - first)[:, :2], axis=1) * voxel_ft
    bend = np.where(one, 1.0, path / np.maximum(apart, 1e-6))
    rmse, sag = _sags(along * voxel_ft, p[:, 2] * voxel_ft, parts, voxel_ft)
    return np.column_stack([axis, np.abs(axis[:, 2]), forms, parts.quantile(radial, 0.5), parts.quantile(radial, 0.9), path, apart, bend, rmse, sag, first, last])


def _sags(s: np.ndarray, z: np.ndarray, parts: Parts, voxel_ft: float) -> tuple[np.ndarray, np.ndarray]:
    """Errors of parabolas through wires seen from the side, and how far their middles hang below their ends: 0 for what
    has fewer than six points or three places along, or no length."""
    up = np.round(s, 6)[parts.order(np.round(s, 6))]
    new = np.diff(up, prepend=up[0]) != 0
    new[parts.starts] = True
    low, high = (parts.quantile(s, q) for q in (0.0, 1.0))
    fit = (parts.sizes >= 6) & (high - low >= max(2 * voxel_ft, 1e-6)) & (parts.sum(new.astype(int)) >= 3)
    u = (s - ((low + high) / 2)[parts.of]) / np.maximum((high - low) / 2, 1e-9)[parts.of]
    powers = u[:, None] ** np.arange(3)
    left, right = parts.sum(powers[:, :, None] * powers[:, None, :]), parts.sum(powers * z[:, None])
    size = np.linalg.eigvalsh(left)
    fit &= size[:, 0] > 1e-13 * size[:, 2]
    c = np.zeros_like(right)
    c[fit] = np.linalg.solve(left[fit], right[fit][:, :, None])[:, :, 0]
    rest = ((powers * c[parts.of]).sum(axis=1) - z) ** 2
    return np.where(fit, np.sqrt(parts.sum(rest) / parts.sizes), 0.0), np.maximum(c[:, 2], 0.0)


def _by_component(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The components of slices of a group, their points one after another by z, y and x, and how many each has."""
    seq, component, p = pd.factorize(pdf["slice_seq"])[0], pdf["component"].to_numpy(np.int64), pdf[["x", "y", "z"]].to_numpy(float)
    order = np.lexsort((*p.T, component, seq))
    seq, component = seq[order], component[order]
    starts = np.flatnonzero(np.append(True, (seq[1:] != seq[:-1]) | (component[1:] != component[:-1])))
    return pdf[list(COMPONENT)].iloc[order[starts]].reset_index(drop=True), p[order], np.diff(np.append(starts, len(p)))


def shapes(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """SHAPES of every component. Components of a few slices are worked out together; a slice is bounded by its grid."""
    names = [c.split()[0] for c in SHAPES.split(", ")]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found, p, sizes = _by_component(pdf)
        return pd.concat([found, pd.DataFrame(shapes_of(p, sizes, grid.voxel_ft), columns=names)], axis=1)

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*COMPONENT).schema.fields)
    return spatial.by_slices(points.select(*COMPONENT, "x", "y", "z")).applyInPandas(work, f"{keys}, {SHAPES}")


def pole_gate(edge: Column | None = None, partial: float = 4.0, whole: float = 10.0, most: float = 90.0, radius: float = 3.5, verticality: float = 0.65, tilt: float = 0.65) -> Column:
    """Whether a component may be a pole by its shape; one at the side of the slice may be the part of one."""
    least = F.when(edge, partial).otherwise(whole) if edge is not None else F.lit(whole)
    z, h = F.col("z_span_ft"), F.col("horizontal_span_ft")
    return F.coalesce((z >= least) & (z <= most) & (F.col("radius_p90_ft") <= radius) & (F.col("principal_verticality") >= verticality) & (h / F.greatest(z, F.lit(1e-6)) <= tilt), F.lit(False))


def line_gate(span: float = 0.5, verticality: float = 0.85, steep: float = 2.5, tortuosity: float = 4.0) -> Column:
    z, h = F.col("z_span_ft"), F.col("horizontal_span_ft")
    return F.coalesce((h >= span) & (F.col("principal_verticality") <= verticality) & (z / F.greatest(h, F.lit(1e-6)) <= steep) & (F.col("xy_tortuosity") <= tortuosity), F.lit(False))


def strict_pole_gate() -> Column:
    """The earlier, stricter gate (fixed values)."""
    return pole_gate(None, whole=12.0, most=85.0)


def strict_line_gate() -> Column:
    return line_gate(8.0, 0.55, 0.75, 1.8)


def features(points: DataFrame, class_name: str, grid: Grid = Grid()) -> DataFrame:
    """All features of the components of a class, with the gate as physical_ok: one aggregate, and the shapes."""
    df = _spans(points.groupBy(*COMPONENT).agg(*_score_stats(), *_extents(grid.voxel_ft), _edge(grid)), grid.voxel_ft)
    df = df.withColumn("touches_xy_edge", F.col("edge_distance_vox") <= Detection.edge_width).join(shapes(points, grid), list(COMPONENT))
    df = df.withColumn("vertical_head_mean", F.col("principal_verticality")).withColumn("horizontal_head_mean", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("principal_verticality") ** 2)))
    df = df.withColumn("class_name", F.lit(class_name))
    df = df.withColumn("partial_pole_candidate", ((F.col("class_name") == "pole") & F.col("touches_xy_edge") & (F.col("principal_verticality") >= 0.65)).cast("int"))
    return df.withColumn("physical_ok", pole_gate(F.col("touches_xy_edge")) if class_name == "pole" else line_gate())


def accept(components: DataFrame, threshold: float) -> DataFrame:
    """refiner_probability at the threshold and a possible shape."""
    ok = (F.col("refiner_probability") >= threshold) & F.col("physical_ok")
    return components.withColumn("component_accept", ok).withColumn("accept_mode", F.when(ok, "refiner_plus_loose_hard_gate").otherwise("rejected"))


def pole_parameters(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Base and top of each component taken as a pole: medians of the lowest and highest 15 % of its points."""
    w = Window.partitionBy(*COMPONENT)
    df = points.select(*COMPONENT, "x", "y", "z").withColumn("low", F.percentile("z", F.lit(0.15)).over(w)).withColumn("high", F.percentile("z", F.lit(0.85)).over(w))
    part = lambda c, cond: F.median(F.when(cond, F.col(c)))
    low, high = F.col("z") <= F.col("low"), F.col("z") >= F.col("high")
    df = df.groupBy(*COMPONENT).agg(part("x", low).alias("base_x"), part("y", low).alias("base_y"), F.min("z").cast("double").alias("base_z"), part("x", high).alias("top_x"), part("y", high).alias("top_y"), F.max("z").cast("double").alias("top_z"))
    v = grid.voxel_ft
    return df.withColumn("height_ft", (F.col("top_z") - F.col("base_z") + 1) * v).withColumn("tilt_ft", F.sqrt((F.col("top_x") - F.col("base_x")) ** 2 + (F.col("top_y") - F.col("base_y")) ** 2) * v)


def line_vertices(points: DataFrame, bin_voxels: float = 2.0) -> DataFrame:
    """Polylines: medians of the points in bins along each component's horizontal axis."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        found, p, sizes = _by_component(pdf)
        parts = Parts(sizes)
        around = (p - parts.quantile(p, 0.5)[parts.of])[:, :2]
        s = (around * parts.axes(around)[parts.of]).sum(axis=1)
        bins = np.floor((s - parts.quantile(s, 0.0)[parts.of]) / bin_voxels).astype(np.int64)
        order = parts.order(bins)
        of, bins = parts.of[order], bins[order]
        new = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(bins) != 0)))
        held = of[new]
        index = np.arange(len(new)) - np.searchsorted(held, held)
        middle = Parts(np.diff(np.append(new, len(p)))).quantile(p[order], 0.5)
        return found.iloc[held].reset_index(drop=True).assign(vertex_index=index.astype(np.int32), x=middle[:, 0], y=middle[:, 1], z=middle[:, 2])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*COMPONENT).schema.fields)
    return spatial.by_slices(points.select(*COMPONENT, "x", "y", "z")).applyInPandas(work, f"{keys}, vertex_index int, x double, y double, z double")


def ground_truth_shares(points: DataFrame, truth: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Per component the share of points on, and near, a voxel of ground truth: a bucketed join and two existence tests."""
    near = spatial.distance_join(points.select(*COMPONENT, "x", "y", "z"), truth.select(*SLICE, "x", "y", "z"), p.near_distance, SLICE, ("x", "y", "z"))
    least = near.groupBy(*COMPONENT, "x", "y", "z").agg(F.min("distance").alias("distance"))
    met = points.select(*COMPONENT, "x", "y", "z").join(least, [*COMPONENT, "x", "y", "z"], "left")
    share = lambda limit: F.avg(F.when(F.col("distance") <= limit, 1.0).otherwise(0.0))
    return met.groupBy(*COMPONENT).agg(share(p.exact_distance).alias("exact_gt_fraction"), share(p.near_distance).alias("near_gt_fraction"))


def voxel_classes(rows: DataFrame, pole_points: DataFrame, line_points: DataFrame) -> DataFrame:
    """Class of every source row by the accepted component of its voxel: 1 pole, 2 line, a pole where both are; 0 in
    neither, -1 outside the grid."""
    keys = [*SLICE, "x", "y", "z"]
    df = rows.join(pole_points.select(*keys, F.lit(True).alias("_pole")).distinct(), keys, "left").join(line_points.select(*keys, F.lit(True).alias("_line")).distinct(), keys, "left")
    return df.withColumn("stage2_class", F.when(~F.col("in_grid"), -1).when(F.col("_pole"), 1).when(F.col("_line"), 2).otherwise(0)).drop("_pole", "_line")


def attachments(poles: DataFrame, lines: DataFrame, radius: float = 12.0, voxel_ft: float = 0.5) -> DataFrame:
    """Nearest pole top of both ends of each line (feet), and how many ends have one within radius."""
    tops = poles.select(*SLICE, F.col("component").alias("pole"), (F.col("center_x") * voxel_ft).alias("px"), (F.col("center_y") * voxel_ft).alias("py"), F.col("max_z_ft").alias("pz"))
    ends = lines.select(*COMPONENT, F.explode(F.array(*(F.struct(F.lit(i).alias("end"), *((F.col(f"endpoint{i}_{c}") * voxel_ft).alias(f"p{c}") for c in "xyz")) for i in (1, 2)))).alias("e")).select(*COMPONENT, "e.*")
    near = spatial.distance_join(ends, tops, radius, SLICE, ("px", "py", "pz"))
    best = near.groupBy(*COMPONENT, "end").agg(F.min(F.struct("distance", "pole_r")).alias("b"))
    both = best.groupBy(*COMPONENT).agg(F.count("*").alias("ends"), F.count_distinct("b.pole_r").alias("poles"), F.min(F.when(F.col("end") == 1, F.col("b.distance"))).alias("endpoint1_pole_dist_ft"), F.min(F.when(F.col("end") == 2, F.col("b.distance"))).alias("endpoint2_pole_dist_ft"))
    return lines.select(*COMPONENT).join(both, list(COMPONENT), "left").select(*COMPONENT, "endpoint1_pole_dist_ft", "endpoint2_pole_dist_ft", F.coalesce("ends", F.lit(0)).alias("pole_supports"), F.coalesce(F.col("poles") > 1, F.lit(False)).alias("distinct_poles"))
