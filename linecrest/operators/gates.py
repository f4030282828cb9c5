"""Choices and summaries over whole runs: equivalence gates, the fastest admissible mode, roll-ups of sessions, facts of
log lines, shipping rules and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import slices

#: How far a variant's numbers may be from the reference's.
TOLERANCES = {"label_mismatches": 0.0, "topology_mismatches": 0.0, "score": 1e-4, "geometry": 1e-6, "probability": 1e-5}
#: File endings that never leave with results.
FORBIDDEN_ENDINGS = ("pt", "pth", "onnx", "npz", "joblib", "pkl")


def equivalence_gate(differences: DataFrame, tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """Rows of differences with `failed`, the names of the differences beyond their tolerance (or unknown), and `passed`."""
    beyond = [F.when(C.number(F.col(name)) <= most, F.lit(None)).otherwise(F.lit(name)) for name, most in tolerances.items()]
    failed = F.array_compact(F.array(*beyond))
    return differences.withColumn("failed", F.array_join(failed, ";")).withColumn("passed", F.size(failed) == 0)


def best_mode(runs: DataFrame, priority: list[str], recommended: Column | None = None, fallback: str = "full_cpu") -> DataFrame:
    """One row, `mode`: the recommended one if it passed, else the passing one of the greatest speedup (the earlier in
    `priority` of equal ones; modes outside of it are not chosen), else the fallback. runs: mode, passed, speedup."""
    place = F.array_position(F.lit(priority), F.col("mode"))
    own = (F.col("mode") == recommended) if recommended is not None else F.lit(False)
    able = runs.where(F.col("passed") & (place > 0))
    best = F.max_by("mode", F.struct(F.coalesce(own, F.lit(False)).alias("own"), F.coalesce("speedup", F.lit(0.0)).alias("speedup"), -place))
    return able.agg(F.coalesce(best, F.lit(fallback)).alias("mode"))


def best_batch(runs: DataFrame) -> DataFrame:
    """The passing batch size of the least mean time, the smaller of equal ones. runs: batch_size, passed, mean_ms."""
    return runs.where("passed").agg(F.min_by(F.struct("batch_size", "mean_ms"), F.struct("mean_ms", "batch_size")).alias("b")).select("b.*")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each session's snapshot of the greatest number."""
    return slices.latest(snapshots, "slice_seq", ("group_id",))


def greatest_counter(ids: DataFrame, column: str, pattern: str = r"/C(\d+)$") -> DataFrame:
    """The greatest number that ids of a group end with, 0 without any."""
    n = F.regexp_extract(column, pattern, 1)
    return ids.groupBy("group_id").agg(F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0).cast("long")).alias("counter"))


def numbered(objects: DataFrame, prefix: str, digits: int, number: str = "ordinal") -> DataFrame:
    """objects with `id`: their group, the prefix and their number, padded."""
    return objects.withColumn("id", F.concat(F.col("group_id").cast("string"), F.lit(f"/{prefix}"), F.lpad(F.col(number).cast("string"), digits, "0")))


def roll_up(sessions: DataFrame, cells: DataFrame, snapshots: DataFrame, counts: list[str]) -> DataFrame:
    """A row per session: its coverage columns, evaluated voxels and accuracy of its confusion cells (label, pred, n), and
    `counts` of its newest snapshot, null if it has none."""
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    scored = cells.groupBy("group_id").agg(F.sum("n").alias("evaluated"), (right / F.sum("n")).alias("accuracy"))
    last = latest_snapshots(snapshots).select("group_id", F.col("slice_seq").alias("final_seq"), *counts)
    return sessions.join(scored, "group_id", "left").join(last, "group_id", "left").fillna({"evaluated": 0})


def metric_table(models: DataFrame, classes: tuple[str, ...] = ("pole", "line"), metrics: tuple[str, ...] = ("precision", "recall", "iou")) -> DataFrame:
    """A row per model and class from columns <class>_<metric>; what a model does not state is 0."""
    parts = [F.struct(F.lit(c).alias("class_name"), *(F.coalesce(C.number(F.col(f"{c}_{m}")), F.lit(0.0)).alias(m) for m in metrics)) for c in classes]
    return models.select("model", F.explode(F.array(*parts)).alias("p")).select("model", "p.*")


def mode_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each column has each value, nulls among them."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return rows.selectExpr(f"stack({len(columns)}, {pairs}) as (field, value)").groupBy("field", "value").agg(F.count("*").alias("n"))


def log_facts(lines: DataFrame) -> DataFrame:
    """What log lines (group_id, ordinal, line) tell of slices: a row per `seq=<n>` line and `<name>=<ms>ms` in it."""
    names = F.regexp_extract_all("line", F.lit(r"([A-Za-z_0-9]+)=[0-9.]+ms"), 1)
    values = F.regexp_extract_all("line", F.lit(r"[A-Za-z_0-9]+=([0-9.]+)ms"), 1)
    df = lines.select("group_id", "ordinal", F.regexp_extract("line", r"\bseq=(\d+)", 1).alias("seq"), names.alias("names"), values.alias("values")).where("seq <> ''")
    each = df.select("group_id", "ordinal", F.col("seq").cast("long").alias("slice_seq"), F.explode(F.arrays_zip("names", "values")).alias("t"))
    return each.select("group_id", "ordinal", "slice_seq", F.col("t.names").alias("metric"), F.col("t.values").cast("double").alias("ms"))


def shippable(files: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_ENDINGS) -> DataFrame:
    """Files (path, and their content or fingerprint) with `forbidden`, whether they may not leave by their ending."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("forbidden", ending.isin(*forbidden))


def latencies(arrived: DataFrame, published: DataFrame) -> DataFrame:
    """Milliseconds from a slice's arrival (arrived_at) to its window's publication (published_at); null while it is not
    published."""
    ms = (F.unix_micros("published_at") - F.unix_micros("arrived_at")) / 1000.0
    return arrived.join(published, list(slices.SLICE), "left").select(*slices.SLICE, ms.alias("latency_ms"))


def completeness(expected: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Per group how many of its slices each stage has, and a state: complete, partial (some stage has some) or empty."""
    out = expected.select(*slices.SLICE).distinct()
    for name, done in stages.items():
        out = out.join(done.select(*slices.SLICE).distinct().withColumn(name, F.lit(1)), list(slices.SLICE), "left")
    df = out.groupBy("group_id").agg(F.count("*").alias("slices"), *(F.count(name).alias(name) for name in stages))
    every, none = F.lit(True), F.lit(True)
    for name in stages:
        every, none = every & (F.col(name) == F.col("slices")), none & (F.col(name) == 0)
    return df.withColumn("state", F.when(every, "complete").when(none, "empty").otherwise("partial"))


def forbidden_features(names: list[str], forbidden: list[str]) -> list[str]:
    """The names that a model must not have as input, in their order."""
    return [n for n in names if n in set(forbidden)]


def nested(config: Column, path: str, default: Column) -> Column:
    """A value of a JSON text by its dotted path, or the default if it or a part of its path is missing."""
    value = F.try_variant_get(F.try_parse_json(config), "$." + path, "string")
    return F.coalesce(value, default)
