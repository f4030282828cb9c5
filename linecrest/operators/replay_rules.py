"""Rules that the published tables of a replayed session keep, as a table of violations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.params import Reconstruction

R = Reconstruction()
#: What a finished session states of itself, and each published window again.
CONTRACT = {"max_sequence_gap": float(R.max_span_slices), "max_observed_centers": R.max_span_slices + 1.0, "max_span_length_ft": R.max_span_length, "slice_length_ft": R.slice_length}


def _told(df: DataFrame, rule: str, seq: Column | None, detail: Column, severity: str = "error") -> DataFrame:
    at = F.lit(None) if seq is None else seq
    return df.select("group_id", at.cast("long").alias("slice_seq"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def contract_breaches(stated: DataFrame, level: str, expected: dict[str, float] = CONTRACT) -> DataFrame:
    """Values of `expected` that rows (group_id, perhaps slice_seq) state otherwise or not at all, one row each."""
    seq = F.col("slice_seq") if "slice_seq" in stated.columns else None
    wrong = F.filter(F.array(*(F.when(C.number(F.col(k)).eqNullSafe(F.lit(v)), F.lit(None)).otherwise(F.lit(k)) for k, v in expected.items())), lambda c: c.isNotNull())
    return _told(stated.withColumn("_wrong", F.explode(wrong)), f"{level}_contract", seq, F.col("_wrong"))


def sequence_breaches(rows: DataFrame, level: str, order: str | None = None) -> DataFrame:
    """Numbers of a table that are no whole numbers, that come twice, and, with an order, that are not above the one
    before them."""
    seq = C.number(F.col("slice_seq"))
    known = rows.withColumn("_seq", F.when(seq == F.floor(seq), seq.cast("long")))
    bad = _told(known.where("_seq IS NULL"), f"{level}_invalid_sequence", None, F.col("slice_seq"))
    twice = known.where("_seq IS NOT NULL").groupBy("group_id", "_seq").count().where("count > 1")
    out = bad.unionByName(_told(twice, f"{level}_duplicate_sequence", F.col("_seq"), F.col("count")))
    if order:
        before = F.lag("_seq").over(Window.partitionBy("group_id").orderBy(order))
        falls = known.where("_seq IS NOT NULL").withColumn("_before", before).where("_seq < _before")
        out = out.unionByName(_told(falls, f"{level}_not_increasing", F.col("_seq"), F.col("_before")))
    return out


def absent(rows: DataFrame, known: DataFrame, rule: str, severity: str = "error") -> DataFrame:
    """Slices of rows that known has not."""
    keys = ["group_id", "slice_seq"]
    return _told(rows.select(*keys).distinct().join(known.select(*keys), keys, "left_anti"), rule, F.col("slice_seq"), F.lit(None), severity)


def window_breaches(timing: DataFrame, gap: int = R.max_span_slices) -> DataFrame:
    """Timings whose window has more slices than gap + 1, or does not begin gap numbers before its slice."""
    many = _told(timing.where(F.col("window_observed") > gap + 1), "window_too_large", F.col("slice_seq"), F.col("window_observed"))
    first = _told(timing.where(F.col("window_first_seq") != F.col("slice_seq") - gap), "window_lower_bound", F.col("slice_seq"), F.col("window_first_seq"))
    return many.unionByName(first)


def source_breaches(objects: DataFrame, sources: str, what: str, gap: int = R.max_span_slices) -> DataFrame:
    """Published objects (group_id, window_seq and an array of slice numbers) that use slices older than their window or
    after it, once per object and kind."""
    low = F.col("window_seq") - gap
    old = objects.where(F.exists(sources, lambda s: s < low)).withColumn("_at", F.array_min(sources))
    new = objects.where(F.exists(sources, lambda s: s > F.col("window_seq"))).withColumn("_at", F.array_max(sources))
    return _told(old, f"{what}_stale_source", F.col("window_seq"), F.col("_at")).unionByName(_told(new, f"{what}_future_source", F.col("window_seq"), F.col("_at")))


def violations(sessions: DataFrame, manifest: DataFrame, timing: DataFrame, snapshots: DataFrame, latest: DataFrame, objects: Iterable[tuple[DataFrame, str, str]] = (), artifacts: DataFrame | None = None, gap: int = R.max_span_slices) -> DataFrame:
    """All violations (group_id, slice_seq, rule, severity, detail).

    sessions: group_id, completed and CONTRACT's values. manifest: group_id, slice_seq (as text), ordinal (its order).
    timing: group_id, slice_seq, window_observed, window_first_seq. snapshots: group_id, slice_seq, completed and
    CONTRACT's values. latest: group_id of each pointer to a newest window; a session has one. objects: tables with
    window_seq, their column of source slices, and a name. artifacts: group_id, slice_seq, path, length (null: missing)."""
    listed = manifest.select("group_id", C.number(F.col("slice_seq")).cast("long").alias("slice_seq")).where("slice_seq IS NOT NULL")
    pointers = sessions.select("group_id").join(latest.groupBy("group_id").count(), "group_id", "left").withColumn("n", F.coalesce("count", F.lit(0).cast("long")))
    found = [
        _told(sessions.where("NOT coalesce(completed, false)"), "session_not_completed", None, F.lit(None)),
        contract_breaches(sessions, "session"),
        sequence_breaches(manifest, "manifest", "ordinal"),
        sequence_breaches(timing, "timing"),
        absent(listed, timing.withColumn("slice_seq", C.number(F.col("slice_seq")).cast("long")), "timing_missing", "warning"),
        window_breaches(timing.withColumn("slice_seq", C.number(F.col("slice_seq")).cast("long")), gap),
        _told(pointers.where("n <> 1"), "latest_pointer", None, F.col("n")),
        absent(listed, snapshots, "snapshot_missing"),
        _told(snapshots.where("NOT coalesce(completed, false)"), "snapshot_not_completed", F.col("slice_seq"), F.lit(None)),
        contract_breaches(snapshots.where("completed"), "snapshot"),
        *(source_breaches(df, column, name, gap) for df, column, name in objects),
    ]
    if artifacts is not None:
        found.append(_told(artifacts.where("coalesce(length, 0) = 0"), "artifact_missing_or_empty", F.col("slice_seq"), F.col("path")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def verdict(violations: DataFrame) -> DataFrame:
    """One row: ok if there is no error, and how many errors and warnings there are."""
    error = F.col("severity") == "error"
    return violations.agg(F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings")).withColumn("ok", F.col("errors") == 0)
