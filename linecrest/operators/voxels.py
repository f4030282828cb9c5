"""From raw rows to the occupied voxels of a slice. All steps are column expressions and window functions; slices are
told apart by group_id and slice_seq, so every shuffle is on these keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.params import Detection, Grid

SLICE = ("group_id", "slice_seq")
REQUIRED = ("x", "y", "z")


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, names=REQUIRED) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required local columns: {', '.join(missing)}")
    return df


def quantize(raw: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Rows with finite coordinates, rounded half to even, that lie in the grid; invalid labels become -100, no label
    column 0."""
    df = require(raw)
    for c in REQUIRED:
        df = df.withColumn(c, C.voxel(C.number(F.col(c))))
    inside = [F.col(c).between(0, n - 1) for c, n in (("x", grid.x), ("y", grid.y), ("z", grid.z))]
    df = df.where(inside[0] & inside[1] & inside[2])
    return df.withColumn("label", C.valid_label(F.col("label")) if "label" in df.columns else F.lit(0))


def clip_to_grid(raw: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """As quantize, but rows outside are moved to the border (the dense loader's rule); rows without a finite coordinate
    go."""
    df = require(raw)
    for c in REQUIRED:
        df = df.withColumn(c, C.voxel(C.number(F.col(c))))
    df = df.dropna(subset=list(REQUIRED))
    for c, n in (("x", grid.x), ("y", grid.y), ("z", grid.z)):
        df = df.withColumn(c, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c))))
    return df


def keep_last(voxels: DataFrame) -> DataFrame:
    """The row with the largest source_row of each voxel: a partial aggregate, so only one row per voxel and task is
    shuffled."""
    keys = [*SLICE, *REQUIRED]
    rest = [c for c in voxels.columns if c not in keys]
    last = voxels.groupBy(*keys).agg(F.max_by(F.struct(*rest), "source_row").alias("_last"))
    return last.select(*keys, "_last.*").select(*voxels.columns)


def normalized_distance(voxels: DataFrame, column: str = "dist_center_ft") -> DataFrame:
    """Distances over the largest absolute one of the slice's valid rows, or 1 if that is less; 0 where unknown.
    To be used before keep_last."""
    d = C.number(F.col(column))
    top = F.max(F.abs(d)).over(Window.partitionBy(*SLICE))
    return voxels.withColumn("dist_value", F.coalesce(d / F.greatest(top, F.lit(1.0)), F.lit(0.0)))


def centers(raw: DataFrame, names=("center_x", "center_y", "center_z")) -> DataFrame:
    """Medians of the finite center values of each slice."""
    return raw.groupBy(*SLICE).agg(*(F.median(C.number(F.col(c))).alias(c) for c in names))


def resolved_centers(slices: DataFrame, given: DataFrame, manifest: DataFrame, raw: DataFrame, first_rows: int = 256) -> DataFrame:
    """A center per slice: a given one, else the manifest's, else the median of the first rows; the source says which,
    and is `skipped` where none is finite in all three."""
    names = ("center_x", "center_y", "center_z")
    head = raw.where(F.col("source_row") <= first_rows)
    found = slices.select(*SLICE).distinct()
    for label, table in (("given", given), ("manifest", manifest), ("rows", centers(head))):
        found = found.join(table.select(*SLICE, F.struct(*(C.number(F.col(c)).alias(c) for c in names)).alias(label)), list(SLICE), "left")
    whole = lambda s: F.col(f"{s}.center_x").isNotNull() & F.col(f"{s}.center_y").isNotNull() & F.col(f"{s}.center_z").isNotNull()
    pick = F.when(whole("given"), "given").when(whole("manifest"), "manifest").when(whole("rows"), "rows").otherwise("skipped")
    found = found.withColumn("center_source", pick)
    value = lambda c: F.when(F.col("center_source") == "given", F.col(f"given.{c}")).when(F.col("center_source") == "manifest", F.col(f"manifest.{c}")).when(F.col("center_source") == "rows", F.col(f"rows.{c}"))
    return found.select(*SLICE, "center_source", *(value(c).alias(c) for c in names))


def core_of(voxels: DataFrame, core: int = Detection.core) -> DataFrame:
    """The cube of `core` cells that each voxel is in."""
    return voxels.select("*", *(F.floor(F.col(c) / core).cast("int").alias(f"core_{c}") for c in REQUIRED))


def active_cores(voxels: DataFrame, core: int = Detection.core) -> DataFrame:
    """Cores that hold voxels, with the corner of each, its center and its number of voxels."""
    keys = [f"core_{c}" for c in REQUIRED]
    counted = core_of(voxels, core).groupBy(*SLICE, *keys).agg(F.count("*").alias("n_voxels"))
    return counted.select("*", *((F.col(k) * core).alias(f"origin_{c}") for k, c in zip(keys, REQUIRED, strict=True)), *((F.col(k) * core + core // 2).alias(f"center_{c}") for k, c in zip(keys, REQUIRED, strict=True)))


def all_cores(slices: DataFrame, grid: Grid = Grid(), core: int = Detection.core) -> DataFrame:
    """Every core of the grid, for each slice."""
    df = slices.select(*SLICE).distinct()
    for c, n in (("x", grid.x), ("y", grid.y), ("z", grid.z)):
        df = df.withColumn(f"core_{c}", F.explode(F.sequence(F.lit(0), F.lit(-(-n // core) - 1))))
    return df


def box_rows(voxels: DataFrame, start: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Voxels of a half-open box, with their place in it."""
    for c, s, n in zip(REQUIRED, start, shape, strict=True):
        voxels = voxels.where((F.col(c) >= s) & (F.col(c) < s + n))
    return voxels.select("*", *((F.col(c) - s).alias(f"local_{c}") for c, s in zip(REQUIRED, start, strict=True)))


def halo_patches(voxels: DataFrame, core: int = Detection.core, halo: int = 8) -> DataFrame:
    """Each voxel once for every core whose patch (the core and `halo` cells around it) holds it: what a tiled scorer
    reads. A voxel is in 8 patches at most."""
    df = voxels
    for c in REQUIRED:
        low, high = F.floor((F.col(c) - halo) / core), F.floor((F.col(c) + halo) / core)
        df = df.withColumn(f"core_{c}", F.explode(F.sequence(F.greatest(low, F.lit(0)), high).cast("array<int>")))
    cores = core_of(voxels, core).select(*SLICE, *(f"core_{c}" for c in REQUIRED)).distinct()
    return df.join(cores, [*SLICE, *(f"core_{c}" for c in REQUIRED)], "left_semi")


def pooled(voxels: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """Rectangular pooling of sparse voxels: the maximum and mean of each column in cubes of `factor` cells."""
    keys = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in REQUIRED]
    return voxels.groupBy(*SLICE, *keys).agg(F.count("*").alias("n_voxels"), *(f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("max", F.max), ("mean", F.avg))))


def candidates(voxels: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Which voxels may be of a pole, weakly of a line, or strongly of a line. Scores are single precision, and so are
    the thresholds that they are held against."""
    pole, line = F.col("pole_score").cast("float"), F.col("line_score").cast("float")
    single = lambda v: F.lit(v).cast("float")
    rival = line >= single(p.line_competition) * pole
    return voxels.select(
        "*",
        ((pole >= single(p.pole_candidate)) & (pole >= single(p.pole_competition) * line)).alias("pole_candidate"),
        ((line >= single(p.line_weak)) & rival).alias("line_weak"),
        ((line >= single(p.line_strong)) & rival).alias("line_strong"),
    )


def row_level_scores(rows: DataFrame, voxels: DataFrame, pole_threshold: float, line_threshold: float) -> DataFrame:
    """Scores and predicted class of every source row, from the voxel it was rounded to; rows outside have none, class -1."""
    keys = [*SLICE, *REQUIRED]
    placed = rows.select(*SLICE, "source_row", *(C.voxel(C.number(F.col(c))).alias(c) for c in REQUIRED))
    scored = voxels.select(*keys, "pole_score", "line_score", C.label_of(F.col("pole_score"), F.col("line_score"), pole_threshold, line_threshold).alias("pred"))
    return placed.join(scored, keys, "left").select(*SLICE, "source_row", "pole_score", "line_score", F.coalesce("pred", F.lit(-1)).alias("pred"))
