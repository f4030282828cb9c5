"""What the registered queries of session reconstruction are fed with."""

import numpy as np
import pandas as pd
import pytest

from linecrest.operators import reconstruct as R
from linecrest.plans import stage3


@pytest.fixture
def found(spark):
    rows = [("g", s, c, x + 3 * c, c, z) for s in range(1, 13) for c in (1, 2, 3) for x in range(3) for z in range(4)]
    df = spark.createDataFrame(rows, "group_id string, slice_seq long, component int, x int, y int, z int")
    return stage3.queries(lambda spark, d: df)


def fed(monkeypatch, found, spark):
    got = []
    monkeypatch.setattr(stage3.R, "reconstruct", lambda objects, windows: got.append((objects, windows)))
    monkeypatch.setattr(stage3.R, "summary", lambda windows: windows)
    found["window_summary"](spark, "")
    return got[0]


def test_every_slice_has_its_window(spark, found, monkeypatch):
    _, windows = fed(monkeypatch, found, spark)
    assert sorted(r["slice_seq"] for r in windows.collect()) == list(range(1, 13))


def test_every_observation_is_a_pole(spark, found, monkeypatch):
    objects, _ = fed(monkeypatch, found, spark)
    assert objects.where("kind = 'pole'").count() == 36
    got = []
    for name in ("nearest_pole", "adjusted_heights"):
        keep = getattr(stage3.R, name)
        monkeypatch.setattr(stage3.R, name, lambda *a, keep=keep, at=name == "nearest_pole": got.append(a[1 if at else 0]) or keep(*a))
    found["nearest_pole"](spark, "")
    found["pole_height_adjust"](spark, "")
    assert [g.count() for g in got] == [36, 36, 36]


def test_windows_are_not_joined_to_few_tasks(spark, found):
    from pyspark.sql import functions as F

    windows = found["window_summary"](spark, "")
    assert windows.select(F.spark_partition_id().alias("task"), "window_seq").distinct().groupBy("task").count().count() > 1


def test_joins_that_cannot_be_are_told_at_once():
    rng = np.random.default_rng(6)
    frags = []
    for k in range(60):
        at, way = rng.uniform(0, 60, 2), rng.choice([0.0, 0.1])
        x = np.linspace(0, 12, 5)
        frags.append(R.Fragment(f"L{k}", int(rng.integers(0, 4)), 0.8, np.column_stack([at[0] + x, at[1] / 20 + way * x, 20 + 0.02 * x])))
    pairs = np.argwhere(np.triu(np.ones((60, 60), bool), 1))
    for bridge in (False, True):
        limits = R.Limits.of(R.R, bridge)
        may = R._may_join(frags, pairs, limits, R.R)
        joined = np.array([R.join_of(frags[i], frags[j], limits) is not None for i, j in pairs.tolist()])
        assert joined.sum() > 10 and not (joined & ~may).any() and may.sum() < len(pairs) / 2


def fragments(n=60, slices=4):
    rng = np.random.default_rng(6)
    frags = []
    for k in range(n):
        at, way = rng.uniform(0, 60, 2), rng.choice([0.0, 0.1])
        x = np.linspace(0, 12, int(rng.integers(2, 6)))
        frags.append(R.Fragment(f"L{k:02}", int(rng.integers(0, slices)), 0.8, np.column_stack([at[0] + x, at[1] / 20 + way * x, 20 + 0.02 * x])))
    return sorted(frags, key=lambda f: (f.seq, f.key))


def test_joins_of_all_pairs_are_those_of_each_pair():
    frags = fragments()
    pairs = np.argwhere(np.triu(np.ones((60, 60), bool), 1))
    for bridge in (False, True):
        limits = R.Limits.of(R.R, bridge)
        want = [{"i": i, "j": j, **c} for i, j in pairs.tolist() if (c := R.join_of(frags[i], frags[j], limits))]
        got = R.joins_of(frags, pairs, limits)
        got = [dict(zip(got, v, strict=True)) | {"bridge": bridge} for v in zip(*(v.tolist() for v in got.values()), strict=True)]
        assert len(want) > 10 and got == sorted(want, key=lambda c: (c["cost"], c["i"], c["j"]))


def test_windows_of_a_run_choose_among_its_joins(monkeypatch):
    frags = fragments(80, 12)
    at = [f.seq for f in frags]
    alone = {w: R.match_fragments([f for f in frags if w - 9 <= f.seq <= w]) for w in range(12)}
    monkeypatch.setattr(R, "join_of", lambda *a: pytest.fail("joins are worked out pair by pair"))
    run = R.Candidates.of(frags)
    for w in range(12):
        low, high = np.searchsorted(at, w - 9), np.searchsorted(at, w, side="right")
        assert run.chosen(low, high) == alone[w] == R.match_fragments(frags[low:high])
    assert len(alone[11]) > 10


def test_poles_of_a_window_are_those_of_merge_poles(spark):
    rng = np.random.default_rng(8)
    rows = [(f"P{k:02}", int(rng.integers(1, 5)), *rng.uniform(0, 40, 3).round(2).tolist(), float(h)) for k, h in enumerate(rng.uniform(-5, 40, 40))]
    rows = [(k, s, x, y, z, x + 1, y, z + abs(h), h if h > 0 else None) for k, s, x, y, z, h in rows]
    names = ["key", "slice_seq", "x", "y", "z", "top_x", "top_y", "top_z", "value"]
    df = spark.createDataFrame([("g", *r) for r in rows], "group_id string, key string, slice_seq long, x double, y double, z double, top_x double, top_y double, top_z double, value double")
    for n in (2, 40):
        some = df.where(f"key < 'P{n:02}'").withColumnsRenamed({"key": "pole", "x": "base_x", "y": "base_y", "z": "base_z", "value": "height_ft"})
        want = R.merge_poles(some).orderBy("cluster").collect()
        got = R.merged_poles(pd.DataFrame(rows[:n], columns=names))
        assert len(want) == len(got) > n // 4
        for w, g in zip(want, got, strict=True):
            assert np.allclose([w["world_x_ft"], w["world_y_ft"], w["base_z_ft"], w["baseline_height_ft"], w["min_height_ft"], w["max_height_ft"], w["median_ft"]], [*g["xy"], g["base_z"], g["baseline"], g["low"], g["high"], g["median"]])
            assert w["source_slices"] == ";".join(map(str, g["slices"]))


def test_components_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    rows = [("g", s, c, x + 3 * c, c, z) for s in range(1, 4) for c in (1, 2) for x in range(3) for z in range(4)]
    df = spark.createDataFrame(rows, "group_id string, slice_seq long, component int, x int, y int, z int")
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    points = df.mapInPandas(look, df.schema).where(F.col("component") > 0)
    assert stage3.queries(lambda spark, d: points)["window_summary"](spark, "").count() == 3
    assert seen.value == len(rows)


def test_windows_side_by_side_are_those_alone():
    frags = fragments(80, 12)
    pole = lambda x, y: {"xy": np.array([x, y]), "base_z": 0.0, "baseline": 21.0, "height": 21.0, "low": 15.0, "high": 25.0, "median": 21.0, "hidden": False, "slices": [1]}
    windows = [([pole(x, y) for x in (0.0, 30.0, 72.0) for y in (0.0, 3.0 * k)], [f for f in frags if w - 9 <= f.seq <= w]) for k, w in enumerate((3, 6, 9, 11), 1)]
    centers = {1: np.array([25.0, 0.0])}
    alone = [R.reconstruct_window([dict(q) for q in poles], own, centers) for poles, own in windows]
    together = R.reconstruct_windows([(poles, own, centers, R.match_fragments(own)) for poles, own in windows])
    assert together == alone and sum(len(w["chains"]) for w in alone) > 10 and any(w["completed"] for w in alone)


def test_slices_without_number_or_group_are_no_windows(spark):
    rows = [(g, s, 1, x, 1, z) for g, s in (("g", 1), ("g", None), (None, 2)) for x in range(3) for z in range(4)]
    df = spark.createDataFrame(rows, "group_id string, slice_seq long, component int, x int, y int, z int")
    got = stage3.queries(lambda spark, d: df)["window_summary"](spark, "").collect()
    assert [(r["group_id"], r["window_seq"]) for r in got] == [("g", 1)]


def test_components_of_slices_taken_together_stay_apart(spark):
    from linecrest.operators import components as K
    from linecrest.operators import spatial as P

    rows = [("g", s, x, 1, z) for s in (0, 1, 2, None) for x in (0, 1, 5) for z in (0, 7)]
    got = P.connected_components(spark.createDataFrame(rows, "group_id string, slice_seq long, x int, y int, z int"), 16, 16)
    want = {(1 + z * 16) * 16 + x for x in (0, 5) for z in (0, 7)}
    assert {r["component"] for r in got.collect()} == want and got.select("slice_seq", "component").distinct().count() == 16
    assert K.line_vertices(got).select("slice_seq", "component").distinct().count() == 16
