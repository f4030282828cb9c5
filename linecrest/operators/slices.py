"""Sessions as sequences of slices: paths, inventories, manifests, windows over past slices, and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = ("group_id", "slice_seq")
#: A slice's folder: session and number, in any case.
FOLDER = r"(?i)^(session\d+)_slice(\d+)$"
GAP = 9


def parse_path(path: Column) -> Column:
    """Geography, session, slice number and group of a file's path. A folder of another name is session0, number 0; a path
    of fewer than three parts has the group `ungrouped`."""
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")
    match = folder.rlike(FOLDER)
    session = F.when(match, F.regexp_extract(folder, FOLDER, 1)).otherwise("session0")
    seq = F.when(match, F.regexp_extract(folder, FOLDER, 2).cast("long")).otherwise(F.lit(0).cast("long"))
    geography = F.element_at(parts, 1)
    group = F.when(F.size(parts) >= 3, F.concat_ws("/", geography, session)).otherwise("ungrouped")
    return F.struct(geography.alias("geography"), session.alias("session"), seq.alias("slice_seq"), group.alias("group_id"))


def split_group(path: Column) -> Column:
    """The session that a path's second part names anywhere, else the part itself."""
    part = F.get(F.split(path, "/"), F.lit(1))
    return F.coalesce(F.nullif(F.regexp_extract(part, r"(?i)(session\d+)", 1), F.lit("")), part)


def inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """Matched files with group and number; the rest is what unmatched() returns."""
    parts = F.split(path, "/")
    matched = (F.size(parts) >= 3) & F.get(parts, F.size(parts) - 2).rlike(FOLDER)
    return paths.where(matched).select(path, parse_path(F.col(path)).alias("p")).select(path, "p.*")


def unmatched(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.select(path).exceptAll(inventory(paths, path).select(path))


def coverage(inventory: DataFrame) -> DataFrame:
    """Per group: files, slices, first, last, missing and duplicate numbers, and whether it is valid."""
    df = inventory.groupBy("group_id").agg(F.count("*").alias("files"), F.count_distinct("slice_seq").alias("slices"), F.min("slice_seq").alias("first"), F.max("slice_seq").alias("last"))
    df = df.withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("slices")).withColumn("duplicates", F.col("files") - F.col("slices"))
    return df.withColumn("status", F.when(F.col("duplicates") > 0, "duplicate").when(F.col("missing") > 0, "gaps").otherwise("complete"))


def largest_valid(coverage: DataFrame) -> DataFrame:
    """The group with the most slices among those without duplicates, the first by name among equals."""
    return coverage.where("duplicates = 0").orderBy(F.desc("slices"), "group_id").limit(1)


def missing_sequences(slices: DataFrame) -> DataFrame:
    """Numbers between a group's first and last slice that it has not."""
    bounds = slices.groupBy("group_id").agg(F.min("slice_seq").alias("a"), F.max("slice_seq").alias("b"))
    every = bounds.select("group_id", F.explode(F.sequence("a", "b")).alias("slice_seq"))
    return every.join(slices.select(*SLICE).distinct(), list(SLICE), "left_anti")


def upsert(manifest: DataFrame, rows: DataFrame, key: tuple[str, ...] = SLICE) -> DataFrame:
    """The manifest with rows in place of those of equal key. rows must have its columns."""
    return manifest.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows.select(*manifest.columns))


def latest(rows: DataFrame, order: str, key: tuple[str, ...] = SLICE) -> DataFrame:
    """The last row of each key, by order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def pending(slices: DataFrame, done: DataFrame) -> DataFrame:
    """Slices whose keys the manifest of a stage does not have."""
    return slices.join(done.select(*SLICE), list(SLICE), "left_anti")


def window_members(slices: DataFrame, gap: int = GAP) -> DataFrame:
    """For each slice S the slices of its group in [S - gap, S]: a range frame over the sequence number."""
    w = Window.partitionBy("group_id").orderBy("slice_seq").rangeBetween(-gap, 0)
    members = F.array_sort(F.collect_list("slice_seq").over(w))
    return slices.select(*SLICE).distinct().select(*SLICE, members.alias("members")).select(*SLICE, F.size("members").alias("observed"), F.element_at("members", 1).alias("first_seq"), F.array_join("members", ";").alias("observed_slices"))


def in_windows(objects: DataFrame, slices: DataFrame, gap: int = GAP) -> DataFrame:
    """Objects once for every window that holds their slice, named by its last slice: window_seq. An equi-join on the
    group and number, since each slice is spread over gap + 1 windows."""
    spread = objects.withColumn("window_seq", F.explode(F.sequence(F.col("slice_seq"), F.col("slice_seq") + gap)))
    ends = slices.select("group_id", F.col("slice_seq").alias("window_seq")).distinct()
    return spread.join(ends, ["group_id", "window_seq"], "left_semi")


def deltas(slices: DataFrame, value: str) -> DataFrame:
    """Each slice's step from the group's slice before it."""
    w = Window.partitionBy("group_id").orderBy("slice_seq")
    return slices.select(*SLICE, F.lag("slice_seq").over(w).alias("previous_seq"), (F.col(value) - F.lag(value).over(w)).alias("delta"))


def increasing(arrivals: DataFrame, order: str) -> DataFrame:
    """Per group: whether slices arrive with ever greater numbers, and how many do not."""
    w = Window.partitionBy("group_id").orderBy(order)
    step = arrivals.select("group_id", (F.col("slice_seq") - F.lag("slice_seq").over(w)).alias("step"))
    return step.groupBy("group_id").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("strictly_increasing"), F.count_if(F.col("step") <= 0).alias("violations"))


def merge_timings(*stages: DataFrame) -> DataFrame:
    """Timings of all stages by slice; where stages give the same column, the later one counts."""
    out = stages[0]
    for more in stages[1:]:
        both = [c for c in more.columns if c in out.columns and c not in SLICE]
        joined = out.join(more.select(*SLICE, *(F.col(c).alias(f"_new_{c}") for c in more.columns if c not in SLICE)), list(SLICE), "full")
        old = [F.coalesce(f"_new_{c}", c).alias(c) if c in both else F.col(c) for c in out.columns if c not in SLICE]
        out = joined.select(*SLICE, *old, *(F.col(f"_new_{c}").alias(c) for c in more.columns if c not in SLICE and c not in both))
    return out


def even_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows spread evenly over the order, the first and last among them."""
    ranked = rows.withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    spot = F.floor(F.col("id") * (F.col("_total") - 1) / F.lit(max(n - 1, 1)))
    picks = rows.sparkSession.range(n).crossJoin(rows.agg(F.count("*").alias("_total"))).select(spot.alias("_at")).distinct()
    return ranked.join(F.broadcast(picks), "_at", "left_semi").drop("_at")


def top_k(rows: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(score), *ties).limit(k)


def group_split(rows: DataFrame, group: str = "group_id", seed: int = 42, validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """train, val or test for whole groups, in a seeded order; of three groups or more each part has one at least."""
    groups = rows.select(group).distinct()
    ranked = groups.withColumn("_r", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), group)))
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy()))
    tests, vals = (F.when(F.col("_n") >= 3, F.greatest(F.lit(1), F.floor(F.col("_n") * share))).otherwise(F.lit(0)) for share in (test, validation))
    part = F.when(F.col("_r") <= tests, "test").when(F.col("_r") <= tests + vals, "val").otherwise("train")
    return ranked.select(group, part.alias("split"))


def compare(reference: DataFrame, variant: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """A row of differences of two tables: keys that one lacks, and the largest difference of each column of numbers; a
    number against none is infinitely far."""
    both = reference.select(*keys, *(F.col(c).alias(f"a_{c}") for c in numbers), F.lit(1).alias("_a")).join(variant.select(*keys, *(F.col(c).alias(f"b_{c}") for c in numbers), F.lit(1).alias("_b")), keys, "full")
    apart = lambda c: F.when(F.col(f"a_{c}").isNull() != F.col(f"b_{c}").isNull(), F.lit(float("inf"))).otherwise(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")))
    met = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count_if(~met).alias("key_mismatches"), *(F.coalesce(F.max(F.when(met, apart(c))), F.lit(0.0)).alias(f"max_{c}") for c in numbers))
