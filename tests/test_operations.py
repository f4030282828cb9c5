"""Rules, gates, samples and the refiner on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linecrest.operators import fields, gates, metrics, refiner, replay_rules


def test_a_sound_replay_has_no_violations(spark):
    told = "completed boolean, max_sequence_gap int, max_observed_centers int, max_span_length_ft double, slice_length_ft double"
    sessions = spark.createDataFrame([("g", True, 9, 10, 450.0, 50.0)], "group_id string, " + told)
    manifest = spark.createDataFrame([("g", "1", 0), ("g", "2", 1)], "group_id string, slice_seq string, ordinal int")
    timing = spark.createDataFrame([("g", 1, 1, -8), ("g", 2, 2, -7)], "group_id string, slice_seq long, window_observed int, window_first_seq long")
    snapshots = spark.createDataFrame([("g", i, True, 9, 10, 450.0, 50.0) for i in (1, 2)], "group_id string, slice_seq long, " + told)
    latest = sessions.select("group_id")
    files = spark.createDataFrame([("g", 1, "p", 5)], "group_id string, slice_seq long, path string, length long")
    poles = spark.createDataFrame([("g", 2, [-7, 2])], "group_id string, window_seq long, s array<long>")
    sound = replay_rules.violations(sessions, manifest, timing, snapshots, latest, [(poles, "s", "pole")], files)
    assert sound.count() == 0 and replay_rules.verdict(sound).collect()[0]["ok"]
    late = replay_rules.violations(sessions, manifest, timing.where("slice_seq = 2"), snapshots.where("slice_seq = 2"), latest.limit(0), [(poles.withColumn("window_seq", F.lit(1)), "s", "pole")], files.withColumn("length", F.lit(0)))
    assert sorted(r["rule"] for r in late.collect()) == ["artifact_missing_or_empty", "latest_pointer", "pole_future_source", "snapshot_missing", "timing_missing"]
    v = replay_rules.verdict(late).collect()[0]
    assert (v["errors"], v["warnings"], v["ok"]) == (4, 1, False)


def test_gate_falls_back_and_prefers_the_recommended(spark):
    runs = spark.createDataFrame([("a", True, 2.0), ("b", True, 2.0), ("c", False, 9.0)], "mode string, passed boolean, speedup double")
    pick = lambda df, **k: gates.best_mode(df, ["b", "a", "c"], **k).collect()[0]["mode"]
    assert pick(runs) == "b" and pick(runs, recommended=F.lit("a")) == "a" and pick(runs, recommended=F.lit("c")) == "b"
    assert pick(runs.where("NOT passed")) == "full_cpu"


def test_roc_auc_counts_ties_by_half(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "score double, label int")
    assert metrics.roc_auc(df).collect()[0][0] == pytest.approx(0.875)
    assert metrics.roc_auc(df.where("label = 1")).collect()[0][0] is None


def test_samples_follow_weights_not_sizes(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") < 10, "rare").otherwise("hot").alias("c"))
    draw = lambda seed: fields.balanced_sample(rows, "k", "c", {"rare": 1.0, "hot": 1.0, "none": 5.0}, 1000, seed=seed, jitter=1).orderBy("draw").collect()
    got = draw(1)
    assert len(got) == 1000 and got == draw(1) and got != draw(2)
    rare = [r["k"] for r in got if r["c"] == "rare"]
    assert 430 < len(rare) < 570 and len(set(rare)) == 10 and {r["jitter_x"] for r in got} == {-1, 0, 1}


def test_supports_equal_a_dense_grid(spark):
    rng = np.random.default_rng(5)
    dense = np.zeros((12, 11, 9))
    at = np.unique(rng.integers(0, (12, 11, 9), (150, 3)), axis=0)
    dense[tuple(at.T)] = rng.uniform(size=len(at))
    df = spark.createDataFrame([("g", 1, *map(int, p), float(dense[tuple(p)])) for p in at], "group_id string, slice_seq long, x int, y int, z int, v double")
    wide = np.pad(dense, 3)
    for r in fields.directional_supports(df, "v", 5).collect():
        x, y, z = r["x"] + 3, r["y"] + 3, r["z"] + 3
        along = [np.mean([wide[x + i * a, y + i * b, z - 1 : z + 2].max() for i in range(-2, 3)]) for a, b in ((1, 0), (0, 1), (1, 1), (1, -1))]
        up = np.mean([wide[x - 1 : x + 2, y - 1 : y + 2, z + i].max() for i in range(-2, 3)])
        assert r["horizontal_support"] == pytest.approx(max(along)) and r["vertical_support"] == pytest.approx(up)


def test_refiner_learns_and_refuses(spark):
    rng = np.random.default_rng(2)
    rows = [(float(h), float(rng.normal()), int(h > 5) if i % 10 else -1, 1.0) for i, h in enumerate(rng.uniform(0, 10, 300))]
    df = spark.createDataFrame(rows, "height double, noise double, target int, weight double")
    model = refiner.train(df, ["height", "noise", "absent"], trees=20, depth=5)
    out = refiner.apply(model, df.withColumn("height", F.when(F.col("height") > 9.5, float("inf")).otherwise(F.col("height"))))
    near = out.where("height BETWEEN 6 AND 9").agg(F.min("refiner_probability")).collect()[0][0]
    assert near > 0.8 and out.where("isnan(refiner_probability) OR refiner_probability IS NULL").count() == 0
    assert out.where("height = double('inf') AND refiner_probability > 0.5").count() == 0
    assert [r["feature"] for r in refiner.importance(model, spark, 2).collect()][0] == "height"
    with pytest.raises(ValueError, match="center_x"):
        refiner.train(df.withColumn("center_x", F.lit(1.0)), ["height", "center_x"])
    with pytest.raises(ValueError, match="both"):
        refiner.train(df.where("target = 1"), ["height"])


def test_threshold_search_has_the_thresholds_of_its_sql(spark):
    # 0.2 + 3 * 0.05 is a little more than 0.35, so poles of bin 7 of 20 do not pass it
    rows = [(0, 7, 0, 50), (1, 8, 0, 100), (2, 0, 20, 100), (0, 0, 0, 100)]
    hist = spark.createDataFrame(rows, "label int, pole_bin int, line_bin int, n long")
    grid = metrics.threshold_grid(hist, 16, 0.2, 0.95)
    assert {r["pole_threshold"] for r in grid.collect()} == {0.2 + i * 0.05 for i in range(16)}
    assert [r["line_threshold"] for r in metrics.threshold_grid(hist, 4, 0.3, 0.675).collect()][:4] == [0.3 + i * 0.125 for i in range(4)]
    best = metrics.threshold_search(hist, 16).collect()[0]
    assert (round(best["pole_threshold"], 6), best["line_threshold"]) == (0.35, 0.2)
