"""Registered queries of running the engine: rules of a replay, gates, roll-ups, logs, samples and training material. Their
tables are the views' slices and voxels with faults at fixed places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecrest.operators import fields, gates, metrics, reconstruct, replay_rules, slices, voxels
from linecrest.plans import views
from linecrest.plans.views import PATHS_SQL, RAW_SQL, SCORED_SQL, SLICES_SQL, VOXELS_SQL

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return keep


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _days(spark, d) -> DataFrame:
    """group_id, slice_seq, the least event_id as order, how many events, and their mean value."""
    return views.slices(spark, d).groupBy("group_id", "slice_seq").agg(F.min("event_id").alias("ordinal"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("v"))


_DAYS = f"WITH {SLICES_SQL}, days AS (SELECT group_id, slice_seq, min(event_id) AS ordinal, count(*) AS n, round(avg(value), 6) AS v FROM slices GROUP BY ALL)"


@query(_DAYS + """, manifest AS (SELECT group_id, CASE WHEN slice_seq % 11 = 5 THEN 'x' || slice_seq ELSE CAST(slice_seq AS VARCHAR) END AS s, ordinal FROM days
  UNION ALL SELECT group_id, CAST(slice_seq AS VARCHAR), ordinal + 1000000000 FROM days WHERE slice_seq % 7 = 3 AND slice_seq % 11 <> 5),
m AS (SELECT group_id, TRY_CAST(s AS BIGINT) AS q, s, ordinal FROM manifest), listed AS (SELECT DISTINCT group_id, q FROM m WHERE q IS NOT NULL),
t AS (SELECT group_id, slice_seq AS q, CASE WHEN slice_seq % 9 = 4 THEN 11 ELSE 10 END AS observed, slice_seq - CASE WHEN slice_seq % 8 = 2 THEN 8 ELSE 9 END AS low FROM days WHERE slice_seq % 5 <> 1),
snap AS (SELECT group_id, slice_seq AS q, slice_seq % 12 <> 6 AS completed, CASE WHEN slice_seq % 10 = 7 THEN 8.0 ELSE 9.0 END AS gap FROM days WHERE slice_seq % 13 <> 8),
lagged AS (SELECT *, lag(q) OVER (PARTITION BY group_id ORDER BY ordinal) AS before FROM m WHERE q IS NOT NULL), e AS (SELECT DISTINCT group_id FROM days)
SELECT group_id, NULL::BIGINT AS slice_seq, 'session_not_completed' AS rule, 'error' AS severity, NULL::VARCHAR AS detail FROM e WHERE group_id = 2
UNION ALL SELECT group_id, NULL, 'session_contract', 'error', 'max_span_length_ft' FROM e WHERE group_id = 3
UNION ALL SELECT group_id, NULL, 'manifest_invalid_sequence', 'error', s FROM m WHERE q IS NULL
UNION ALL SELECT group_id, q, 'manifest_duplicate_sequence', 'error', CAST(count(*) AS VARCHAR) FROM m WHERE q IS NOT NULL GROUP BY group_id, q HAVING count(*) > 1
UNION ALL SELECT group_id, q, 'manifest_not_increasing', 'error', CAST(before AS VARCHAR) FROM lagged WHERE q < before
UNION ALL SELECT group_id, q, 'timing_missing', 'warning', NULL FROM listed ANTI JOIN t USING (group_id, q)
UNION ALL SELECT group_id, q, 'window_too_large', 'error', CAST(observed AS VARCHAR) FROM t WHERE observed > 10
UNION ALL SELECT group_id, q, 'window_lower_bound', 'error', CAST(low AS VARCHAR) FROM t WHERE low <> q - 9
UNION ALL SELECT group_id, NULL, 'latest_pointer', 'error', CASE WHEN group_id = 1 THEN '2' ELSE '0' END FROM e WHERE group_id IN (1, 4)
UNION ALL SELECT group_id, q, 'snapshot_missing', 'error', NULL FROM listed ANTI JOIN snap USING (group_id, q)
UNION ALL SELECT group_id, q, 'snapshot_not_completed', 'error', NULL FROM snap WHERE NOT completed
UNION ALL SELECT group_id, q, 'snapshot_contract', 'error', 'max_sequence_gap' FROM snap WHERE completed AND gap <> 9
UNION ALL SELECT group_id, slice_seq, 'pole_stale_source', 'error', CAST(slice_seq - 10 AS VARCHAR) FROM days WHERE slice_seq % 6 = 1
UNION ALL SELECT group_id, slice_seq, 'pole_future_source', 'error', CAST(slice_seq + 1 AS VARCHAR) FROM days WHERE slice_seq % 6 = 2
UNION ALL SELECT group_id, slice_seq, 'artifact_missing_or_empty', 'error', 'p' || slice_seq FROM days WHERE slice_seq % 15 IN (3, 4)""")
def replay_violations(spark, d):
    days = _days(spark, d)
    seq, when = F.col("slice_seq"), lambda k, r, a, b: F.when(F.col("slice_seq") % k == r, a).otherwise(b)
    text = seq.cast("string")
    manifest = days.select("group_id", when(11, 5, F.concat(F.lit("x"), text), text).alias("slice_seq"), "ordinal")
    manifest = manifest.unionByName(days.where("slice_seq % 7 = 3 AND slice_seq % 11 <> 5").select("group_id", text.alias("slice_seq"), (F.col("ordinal") + 1000000000).alias("ordinal")))
    timing = days.where("slice_seq % 5 <> 1").select("group_id", "slice_seq", when(9, 4, 11, 10).alias("window_observed"), (seq - when(8, 2, 8, 9)).alias("window_first_seq"))
    told = lambda gap, span: [gap.alias("max_sequence_gap"), F.lit(10).alias("max_observed_centers"), span.alias("max_span_length_ft"), F.lit(50.0).alias("slice_length_ft")]
    snapshots = days.where("slice_seq % 13 <> 8").select("group_id", "slice_seq", (seq % 12 != 6).alias("completed"), *told(when(10, 7, 8.0, 9.0), F.lit(450.0)))
    groups = days.select("group_id").distinct()
    sessions = groups.select("group_id", (F.col("group_id") != 2).alias("completed"), *told(F.lit(9), F.when(F.col("group_id") != 3, 450.0)))
    latest = groups.where("group_id <> 4").unionByName(groups.where("group_id = 1"))
    poles = days.select("group_id", seq.alias("window_seq"), F.array(seq, seq + when(6, 2, 1, 0), seq - when(6, 1, 10, 9)).alias("sources"))
    files = days.select("group_id", "slice_seq", F.concat(F.lit("p"), text).alias("path"), F.when(seq % 15 != 3, when(15, 4, 0, 7)).alias("length"))
    return replay_rules.violations(sessions, manifest, timing, snapshots, latest, [(poles, "sources", "pole")], files)


@query(_DAYS + """, r AS (SELECT 'mode' || (slice_seq % 40) AS mode, max(v) AS top, count(*) AS n FROM days GROUP BY ALL), g AS (
  SELECT mode, CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END AS label_mismatches, 0 AS topology_mismatches, CASE WHEN top > 90 THEN 1e-3 ELSE 1e-5 END::DOUBLE AS score, 0.0::DOUBLE AS geometry, CASE WHEN mode LIKE '%7' THEN NULL ELSE 1e-6 END::DOUBLE AS probability FROM r)
SELECT mode, concat_ws(';', CASE WHEN label_mismatches > 0 THEN 'label_mismatches' END, CASE WHEN score > 1e-4 THEN 'score' END, CASE WHEN probability IS NULL THEN 'probability' END) AS failed,
  label_mismatches = 0 AND score <= 1e-4 AND probability IS NOT NULL AS passed FROM g""")
def equivalence_gate(spark, d):
    r = _days(spark, d).groupBy(F.concat(F.lit("mode"), F.col("slice_seq") % 40).alias("mode")).agg(F.max("v").alias("top"), F.count("*").alias("n"))
    runs = r.select("mode", F.when(F.col("n") % 4 == 0, 1).otherwise(0).alias("label_mismatches"), F.lit(0).alias("topology_mismatches"), F.when(F.col("top") > 90, 1e-3).otherwise(1e-5).alias("score"), F.lit(0.0).alias("geometry"), F.when(~F.col("mode").like("%7"), 1e-6).alias("probability"))
    return gates.equivalence_gate(runs).select("mode", "failed", "passed")


@query(_DAYS + """, r AS (SELECT group_id, count(*) % 3 <> 0 AS passed, round(max(v) / 50, 1) AS speedup FROM days GROUP BY ALL)
SELECT coalesce((SELECT 'm' || group_id FROM r WHERE passed AND group_id <> 4 ORDER BY speedup DESC, group_id LIMIT 1), 'full_cpu') AS mode""")
def best_mode(spark, d):
    runs = _days(spark, d).groupBy("group_id").agg((F.count("*") % 3 != 0).alias("passed"), F.round(F.max("v") / 50, 1).alias("speedup"))
    return gates.best_mode(runs.withColumn("mode", F.concat(F.lit("m"), "group_id")), ["m0", "m1", "m2", "m3"])


@query(_DAYS + " SELECT n AS batch_size, round(avg(v), 3) AS mean_ms FROM days WHERE n % 5 <> 0 GROUP BY n ORDER BY mean_ms, batch_size LIMIT 1")
def best_batch(spark, d):
    runs = _days(spark, d).groupBy(F.col("n").alias("batch_size")).agg(F.round(F.avg("v"), 3).alias("mean_ms"))
    return gates.best_batch(runs.withColumn("passed", F.col("batch_size") % 5 != 0))


@query(_DAYS + " SELECT group_id, max(CASE WHEN n % 2 = 0 THEN slice_seq ELSE 0 END)::BIGINT AS counter FROM days GROUP BY ALL")
def greatest_counter(spark, d):
    ids = gates.numbered(_days(spark, d).withColumn("even", F.col("n") % 2 == 0), "C", 6, "slice_seq")
    return gates.greatest_counter(ids.withColumn("id", F.when(F.col("even"), F.col("id")).otherwise("P00001")), "id")


@query(_DAYS + """, s AS (SELECT group_id, count(*) AS slices, min(slice_seq) AS first_seq FROM days GROUP BY ALL), c AS (SELECT CAST(user_id % 5 AS BIGINT) AS group_id, event_id % 3 AS label, user_id % 3 AS pred, count(*) AS n FROM events WHERE user_id % 5 <> 3 GROUP BY ALL),
a AS (SELECT group_id, sum(n)::BIGINT AS evaluated, sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) AS accuracy FROM c GROUP BY ALL), l AS (SELECT group_id, max(slice_seq) AS final_seq, arg_max(n, slice_seq) AS n FROM days WHERE group_id <> 1 GROUP BY ALL)
SELECT group_id, slices, first_seq, coalesce(evaluated, 0) AS evaluated, round(accuracy, 6) AS accuracy, final_seq, l.n AS n FROM s LEFT JOIN a USING (group_id) LEFT JOIN l USING (group_id)""")
def session_roll_up(spark, d):
    days = _days(spark, d)
    sessions = days.groupBy("group_id").agg(F.count("*").alias("slices"), F.min("slice_seq").alias("first_seq"))
    cells = views.slices(spark, d).where("group_id <> 3").groupBy("group_id", (F.col("event_id") % 3).alias("label"), (F.col("user_id") % 3).alias("pred")).agg(F.count("*").alias("n"))
    return _round(gates.roll_up(sessions, cells, days.where("group_id <> 1").select("group_id", "slice_seq", "n"), ["n"]))


@query(_DAYS + """, m AS (SELECT group_id AS model, round(avg(v), 6) AS p, max(CASE WHEN group_id <> 2 THEN n END) / 7.0 AS r FROM days GROUP BY group_id)
SELECT model, 'pole' AS class_name, round(p, 6) AS precision, coalesce(round(r, 6), 0)::DOUBLE AS recall, 0.5::DOUBLE AS iou FROM m UNION ALL SELECT model, 'line', coalesce(round(r, 6), 0)::DOUBLE, round(p, 6), 0.25::DOUBLE FROM m""")
def metric_table(spark, d):
    m = _days(spark, d).groupBy(F.col("group_id").alias("model")).agg(F.round(F.avg("v"), 6).alias("pole_precision"), (F.max(F.when(F.col("group_id") != 2, F.col("n"))) / 7.0).alias("pole_recall"))
    m = m.withColumn("line_precision", F.col("pole_recall")).withColumn("line_recall", F.col("pole_precision")).withColumn("pole_iou", F.lit(0.5)).withColumn("line_iou", F.lit(0.25))
    return _round(gates.metric_table(m))


@query(f"WITH {SLICES_SQL} SELECT field, value, count(*) AS n FROM (SELECT 'event_type' AS field, event_type AS value FROM slices UNION ALL SELECT 'window', CASE WHEN user_id % 4 <> 0 THEN CAST(user_id % 4 AS VARCHAR) END FROM slices) GROUP BY ALL")
def mode_counts(spark, d):
    return gates.mode_counts(views.slices(spark, d).withColumn("window", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4)), ["event_type", "window"])


@query(f"WITH {SLICES_SQL} SELECT group_id, event_id AS ordinal, slice_seq, 'artifact_write' AS metric, (event_id % 90)::DOUBLE AS ms FROM slices WHERE event_id % 3 = 0 UNION ALL SELECT group_id, event_id, slice_seq, 'scan', (event_id % 7) + 0.5::DOUBLE FROM slices WHERE event_id % 3 = 0")
def log_facts(spark, d):
    s = views.slices(spark, d)
    fact = F.concat(F.lit("done seq="), "slice_seq", F.lit(" artifact_write="), F.col("event_id") % 90, F.lit("ms scan="), F.col("event_id") % 7, F.lit(".5ms"))
    return gates.log_facts(s.select("group_id", F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 3 == 0, fact).otherwise("waiting 5ms").alias("line")))


@query(_DAYS + " SELECT group_id, slice_seq, CASE WHEN slice_seq % 6 <> 0 THEN n * 1.5::DOUBLE END AS latency_ms FROM days")
def publish_latency(spark, d):
    t = _days(spark, d).select("group_id", "slice_seq", F.timestamp_seconds("ordinal").alias("arrived_at"), F.timestamp_micros(F.col("ordinal") * 1000000 + F.col("n") * 1500).alias("published_at"))
    return _round(gates.latencies(t.drop("published_at"), t.where("slice_seq % 6 <> 0").drop("arrived_at")))


@query(_DAYS + """, c AS (SELECT group_id, count(*) AS slices, count(*) FILTER (WHERE group_id <> 0) AS stage1, count(*) FILTER (WHERE group_id <> 0 AND (group_id = 1 OR slice_seq % 2 = 0)) AS stage2 FROM days GROUP BY ALL)
SELECT *, CASE WHEN stage1 = slices AND stage2 = slices THEN 'complete' WHEN stage1 + stage2 = 0 THEN 'empty' ELSE 'partial' END AS state FROM c""")
def session_completeness(spark, d):
    days = _days(spark, d)
    one = days.where("group_id <> 0")
    return gates.completeness(days, {"stage1": one, "stage2": one.where("group_id = 1 OR slice_seq % 2 = 0")})


@query(f"WITH {SLICES_SQL}, f AS (SELECT DISTINCT 'run' || group_id || '/s' || slice_seq || CASE slice_seq % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.NPZ' WHEN 2 THEN '.pt' ELSE '' END AS path FROM slices) SELECT path, sha256(path) AS sha256, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('npz', 'pt') AS forbidden FROM f")
def shippable_files(spark, d):
    ending = F.element_at(F.array(F.lit(".csv"), F.lit(".NPZ"), F.lit(".pt"), F.lit("")), (F.col("slice_seq") % 4 + 1).cast("int"))
    files = views.slices(spark, d).select(F.concat(F.lit("run"), "group_id", F.lit("/s"), "slice_seq", ending).alias("path")).distinct()
    return gates.shippable(files.withColumn("sha256", F.sha2("path", 256))).select("path", "sha256", "forbidden")


@query(f"""WITH {SCORED_SQL}, p AS (SELECT line_score AS s, label = 2 AS y FROM scored), e AS (SELECT s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM p GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (ORDER BY s) - neg AS below FROM e) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6)::DOUBLE AS roc_auc FROM c""")
def roc_auc(spark, d):
    return _round(metrics.roc_auc(views.scored(spark, d).select(F.col("line_score").alias("score"), (F.col("label") == 2).alias("label"))))


@query(f"""WITH {VOXELS_SQL}, v AS (SELECT group_id, slice_seq, x, y, z, label FROM voxels), n AS (SELECT a.group_id, a.slice_seq, a.x, a.y, a.z, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS dist
  FROM v a JOIN v b ON a.group_id = b.group_id AND a.slice_seq = b.slice_seq AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3 WHERE b.label = 2 AND a.label <> 2 GROUP BY ALL)
SELECT group_id, slice_seq, x, y, z, round(CASE WHEN label = -100 THEN 0 WHEN label = 2 THEN 1 WHEN dist <= 3 THEN exp(-0.5::DOUBLE * dist * dist) ELSE 0 END, 6)::DOUBLE AS soft_target, CASE WHEN label = 0 AND dist <= 1.5 THEN 1 ELSE 0 END AS boundary FROM v LEFT JOIN n USING (group_id, slice_seq, x, y, z)""")
def soft_targets(spark, d):
    return _round(fields.soft_targets(views.voxels(spark, d), 2, 1.5, 1.0))


@query(f"""WITH {VOXELS_SQL}, v AS (SELECT group_id, slice_seq, x, y, z, line_score AS s FROM voxels), o AS (SELECT unnest([-1, 0, 1]) AS k), i AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS i),
h AS (SELECT group_id, slice_seq, x, y, z + k AS z, max(s) AS s FROM v, o GROUP BY ALL), w AS (SELECT group_id, slice_seq, x + a.k AS x, y + b.k AS y, z, max(s) AS s FROM v, o a, o b GROUP BY ALL),
dirs AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (1, -1)) t(a, b)),
hs AS (SELECT v.group_id, v.slice_seq, v.x, v.y, v.z, a, b, sum(h.s) / 5 AS s FROM v, dirs, i, h WHERE h.group_id = v.group_id AND h.slice_seq = v.slice_seq AND h.x = v.x + i.i * a AND h.y = v.y + i.i * b AND h.z = v.z GROUP BY ALL),
hm AS (SELECT group_id, slice_seq, x, y, z, max(s) AS s FROM hs GROUP BY ALL),
vs AS (SELECT v.group_id, v.slice_seq, v.x, v.y, v.z, sum(w.s) / 5 AS s FROM v, i, w WHERE w.group_id = v.group_id AND w.slice_seq = v.slice_seq AND w.x = v.x AND w.y = v.y AND w.z = v.z + i.i GROUP BY ALL)
SELECT group_id, slice_seq, x, y, z, round(least(1, hm.s), 6) AS horizontal_support, round(least(1, vs.s), 6) AS vertical_support FROM hm JOIN vs USING (group_id, slice_seq, x, y, z)""")
def directional_supports(spark, d):
    return _round(fields.directional_supports(views.voxels(spark, d), "line_score", 5))


@query(f"""WITH {RAW_SQL}, r AS (SELECT group_id, slice_seq, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y, CAST(round_even(z, 0) AS INTEGER) AS z, least(2, label) AS label FROM raw_voxels),
k AS (SELECT * FROM r WHERE x >= 0 AND y >= 0 AND z >= 0), p AS (SELECT group_id, slice_seq, count(*) AS rows, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2,
  min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM k GROUP BY ALL)
SELECT *, CASE WHEN label_1 > 0 AND label_2 > 0 THEN 'both' WHEN label_1 > 0 THEN 'pole' WHEN label_2 > 0 THEN 'line' ELSE 'background' END AS bucket,
  (SELECT greatest(16, max(max_x) + 1) FROM p)::INTEGER AS grid_x, (SELECT greatest(16, max(max_y) + 1) FROM p)::INTEGER AS grid_y, (SELECT greatest(16, max(max_z) + 1) FROM p)::INTEGER AS grid_z FROM p""")
def dataset_summary(spark, d):
    return fields.dataset_summary(views.raw_voxels(spark, d), least_grid=(16, 16, 16))


def _hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


@query(f"""WITH held AS (SELECT vec_id AS k, label % 3 AS c, {_hash("'42:' || vec_id")} % 256 AS b, {_hash("'42:row:' || vec_id")} AS h FROM embeddings WHERE label % 3 < 2),
placed AS (SELECT k, c, row_number() OVER (PARTITION BY c ORDER BY b, h, k) - 1 AS spot, count(*) OVER (PARTITION BY c) AS total FROM held),
t AS (SELECT c, total, CASE c WHEN 0 THEN 1.0 ELSE 3.0 END::DOUBLE AS w FROM placed GROUP BY ALL), s AS (SELECT c, total, (sum(w) OVER (ORDER BY c) - w) / sum(w) OVER () AS low, sum(w) OVER (ORDER BY c) / sum(w) OVER () AS high FROM t),
draws AS (SELECT range AS draw, {_hash("'42:category:' || range")} / 4294967296.0::DOUBLE AS u, {_hash("'42:place:' || range")} AS place FROM range(500))
SELECT draw, k AS vec_id, 'c' || p.c AS category, {", ".join(f"({_hash(f"'42:{a}:' || draw")} % 5 - 2)::INTEGER AS jitter_{a}" for a in "xyz")} FROM draws JOIN s ON u >= low AND u < high JOIN placed p ON p.c = s.c AND p.spot = draws.place % s.total""")
def balanced_sample(spark, d):
    rows = views.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label") % 3).alias("category"))
    return fields.balanced_sample(rows, "vec_id", "category", {"c0": 1.0, "c1": 3.0}, 500, jitter=2)


@query("""WITH r AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN NULL ELSE vec_id % 7 END AS t FROM embeddings) SELECT vec_id, coalesce(CAST(t AS VARCHAR), 'none') AS threshold FROM r""")
def nested_settings(spark, d):
    text = F.when(F.col("vec_id") % 3 == 0, F.lit('{"line": 1}')).otherwise(F.concat(F.lit('{"pole": {"threshold": '), F.col("vec_id") % 7, F.lit("}}")))
    return views.table(spark, d, "embeddings").select("vec_id", gates.nested(text, "pole.threshold", F.lit("none")).alias("threshold"))


@query(f"WITH {RAW_SQL} SELECT group_id, slice_seq, source_row, least(15, greatest(0, CAST(round_even(x, 0) AS INTEGER))) AS x, least(15, greatest(0, CAST(round_even(y, 0) AS INTEGER))) AS y, least(7, greatest(0, CAST(round_even(z, 0) AS INTEGER))) AS z FROM raw_voxels WHERE source_row % 9 <> 0")
def clip_to_grid(spark, d):
    raw = views.raw_voxels(spark, d).withColumn("x", F.when(F.col("source_row") % 9 != 0, F.col("x")))
    return voxels.clip_to_grid(raw, views.GRID).select("group_id", "slice_seq", "source_row", "x", "y", "z")


@query(f"WITH {PATHS_SQL}, p AS (SELECT path FROM paths UNION ALL SELECT replace(path, 'session', 'part') FROM paths) SELECT path, CASE WHEN contains(path, 'session') THEN regexp_extract(path, 'session[0-9]+') ELSE split_part(path, '/', 2) END AS split_group FROM p")
def split_groups(spark, d):
    p = views.paths(spark, d)
    return p.unionByName(p.select(F.replace("path", F.lit("session"), F.lit("part")).alias("path"))).select("path", slices.split_group(F.col("path")).alias("split_group"))


@query(_DAYS + ", c AS (SELECT group_id, slice_seq, slice_seq * 100.0 AS cx, group_id * 10.0 AS cy FROM days WHERE slice_seq % 4 <> 0) SELECT event_id, (event_id % 16 + cx)::DOUBLE * 0.5 AS world_x_ft, (user_id % 16 + cy)::DOUBLE * 0.5 AS world_y_ft FROM slices JOIN c USING (group_id, slice_seq)")
def world_places(spark, d):
    objects = views.slices(spark, d).select("group_id", "slice_seq", "event_id", (F.col("event_id") % 16).alias("x"), (F.col("user_id") % 16).alias("y"))
    centers = _days(spark, d).where("slice_seq % 4 <> 0").select("group_id", "slice_seq", (F.col("slice_seq") * 100.0).alias("center_x"), (F.col("group_id") * 10.0).alias("center_y"))
    return reconstruct.to_world(objects, centers, ("x", "y")).select("event_id", "world_x_ft", "world_y_ft")


@query(f"""WITH {SCORED_SQL}, j AS (SELECT line_score AS p, label = 2 AS y, vec_id % 5 <> 0 AS ok FROM scored WHERE label <> 1), t AS (SELECT range AS k, 0.02::DOUBLE + range * 0.01::DOUBLE AS t FROM range(97)),
c AS (SELECT k, t, count(*) FILTER (WHERE y AND ok AND p + 1e-11 >= t) AS tp, count(*) FILTER (WHERE NOT y AND ok AND p + 1e-11 >= t) AS fp, count(*) FILTER (WHERE y) AS pos FROM t, j GROUP BY ALL),
m AS (SELECT k, t, tp / greatest(tp + fp, 1) AS p, tp / greatest(pos, 1) AS r, tp / greatest(fp + pos, 1) AS i FROM c)
SELECT round(t, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(i, 6) AS iou FROM m ORDER BY round(4 * i + 3 * r + p - 8 * (greatest(0, 0.9::DOUBLE - p) + 2 * greatest(0, 0.9::DOUBLE - r)), 9) DESC, t LIMIT 1""")
def refiner_threshold(spark, d):
    df = views.scored(spark, d).where("label <> 1").select(F.col("line_score").alias("probability"), (F.col("label") == 2).cast("int").alias("target"), (F.col("vec_id") % 5 != 0).alias("physical_ok"))
    return _round(metrics.refiner_threshold(df).drop("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
