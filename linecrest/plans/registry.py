"""The registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import components as K
from linecrest.operators import metrics as M
from linecrest.operators import slices as S
from linecrest.operators import spatial as P
from linecrest.operators import voxels as V
from linecrest.plans import operations, stage3, views
from linecrest.plans.views import CANDIDATES, GRID, LABEL_SQL, PATHS_SQL, RAW_SQL, SCORED_SQL, SLICES_SQL, VOXELS_SQL

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of doubles differ in their last digits by the order of their terms."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- voxels -----------------------------------------------------------------------------------------------------------


@query(f"WITH {VOXELS_SQL} SELECT group_id, slice_seq, x, y, z, source_row, label, line_score, pole_score, dist_center_ft FROM voxels")
def voxel_quantize_dedupe_last(spark, d):
    return views.voxels(spark, d)


@query(f"WITH {RAW_SQL} SELECT group_id, slice_seq, source_row, round(dist_center_ft / greatest(max(abs(dist_center_ft)) OVER (PARTITION BY group_id, slice_seq), 1), 6) AS dist_value FROM in_grid")
def dist_normalize(spark, d):
    return _round(V.normalized_distance(V.quantize(views.raw_voxels(spark, d), GRID)).select("group_id", "slice_seq", "source_row", "dist_value"))


@query(f"WITH {VOXELS_SQL} SELECT group_id, slice_seq, x, y, z, {LABEL_SQL.format(p=0.3, l=0.5)} AS pred FROM voxels")
def threshold_label(spark, d):
    return views.voxels(spark, d).select("group_id", "slice_seq", "x", "y", "z", C.label_of(F.col("pole_score"), F.col("line_score"), 0.3, 0.5).alias("pred"))


@query(f"""WITH {VOXELS_SQL} SELECT r.group_id, r.slice_seq, r.source_row, v.pole_score, v.line_score,
  CASE WHEN v.x IS NULL THEN -1 ELSE {LABEL_SQL.format(p=0.3, l=0.5).replace("pole_score", "v.pole_score").replace("line_score", "v.line_score")} END AS pred
FROM raw_voxels r LEFT JOIN voxels v ON v.group_id = r.group_id AND v.slice_seq = r.slice_seq
  AND v.x = round_even(r.x, 0) AND v.y = round_even(r.y, 0) AND v.z = round_even(r.z, 0)""")
def row_level_scores(spark, d):
    return V.row_level_scores(views.raw_voxels(spark, d), views.voxels(spark, d), 0.3, 0.5)


@query(f"WITH {RAW_SQL} SELECT group_id, slice_seq, median(x) AS center_x, median(y) AS center_y, median(z) AS center_z FROM raw_voxels GROUP BY ALL")
def center_median(spark, d):
    raw = views.raw_voxels(spark, d)
    return V.centers(raw.select("group_id", "slice_seq", F.col("x").alias("center_x"), F.col("y").alias("center_y"), F.col("z").alias("center_z")))


@query(f"""WITH {RAW_SQL}, s AS (SELECT DISTINCT group_id, slice_seq FROM raw_voxels),
h AS (SELECT group_id, slice_seq, median(x) AS x, median(y) AS y, median(z) AS z FROM raw_voxels WHERE source_row <= 64 GROUP BY ALL)
SELECT group_id, slice_seq, CASE WHEN slice_seq % 3 = 0 THEN 'given' WHEN slice_seq % 3 = 1 THEN 'manifest' ELSE 'rows' END AS center_source,
  CASE WHEN slice_seq % 3 = 0 THEN slice_seq * 100.0 WHEN slice_seq % 3 = 1 THEN slice_seq * 10.0 ELSE h.x END::DOUBLE AS center_x,
  CASE WHEN slice_seq % 3 < 2 THEN 0.0 ELSE h.y END::DOUBLE AS center_y, CASE WHEN slice_seq % 3 < 2 THEN 0.0 ELSE h.z END::DOUBLE AS center_z
FROM s JOIN h USING (group_id, slice_seq)""")
def center_resolution(spark, d):
    raw = views.raw_voxels(spark, d)
    s = raw.select("group_id", "slice_seq").distinct()
    at = lambda m, k: s.where(F.col("slice_seq") % 3 == m).select("group_id", "slice_seq", (F.col("slice_seq") * float(k)).alias("center_x"), F.lit(0.0).alias("center_y"), F.lit(0.0).alias("center_z"))
    rows = raw.select("group_id", "slice_seq", "source_row", F.col("x").alias("center_x"), F.col("y").alias("center_y"), F.col("z").alias("center_z"))
    return V.resolved_centers(s, at(0, 100), at(1, 10), rows, 64)


_CORES_SQL = f"WITH {VOXELS_SQL} SELECT group_id, slice_seq, CAST(x // 6 AS INTEGER) AS core_x, CAST(y // 6 AS INTEGER) AS core_y, CAST(z // 6 AS INTEGER) AS core_z, count(*) AS n_voxels"


@query(_CORES_SQL + ", " + ", ".join(f"CAST({c} // 6 AS INTEGER) * 6 AS origin_{c}, CAST({c} // 6 AS INTEGER) * 6 + 3 AS center_{c}" for c in "xyz") + " FROM voxels GROUP BY ALL")
def active_cores(spark, d):
    return V.active_cores(views.voxels(spark, d), 6)


@query(f"WITH {VOXELS_SQL} SELECT s.group_id, s.slice_seq, CAST(a.i AS INTEGER) AS core_x, CAST(b.i AS INTEGER) AS core_y, CAST(c.i AS INTEGER) AS core_z FROM (SELECT DISTINCT group_id, slice_seq FROM voxels) s, range(3) a(i), range(3) b(i), range(2) c(i)")
def all_cores(spark, d):
    return V.all_cores(views.voxels(spark, d), GRID, 6)


@query(f"WITH {VOXELS_SQL} SELECT group_id, slice_seq, x - 3 AS local_x, y - 2 AS local_y, z - 1 AS local_z, label FROM voxels WHERE x >= 3 AND x < 9 AND y >= 2 AND y < 10 AND z >= 1 AND z < 5")
def box_rows(spark, d):
    return V.box_rows(views.voxels(spark, d), (3, 2, 1), (6, 8, 4)).select("group_id", "slice_seq", "local_x", "local_y", "local_z", "label")


@query(f"""WITH {VOXELS_SQL}, cores AS (SELECT DISTINCT group_id, slice_seq, x // 6 AS cx, y // 6 AS cy, z // 6 AS cz FROM voxels)
SELECT v.group_id, v.slice_seq, CAST(cx AS INTEGER) AS core_x, CAST(cy AS INTEGER) AS core_y, CAST(cz AS INTEGER) AS core_z, count(*) AS n_rows, CAST(sum(v.x + 17 * v.y + 289 * v.z) AS BIGINT) AS place_sum
FROM voxels v JOIN cores c USING (group_id, slice_seq) WHERE v.x BETWEEN cx * 6 - 2 AND cx * 6 + 7 AND v.y BETWEEN cy * 6 - 2 AND cy * 6 + 7 AND v.z BETWEEN cz * 6 - 2 AND cz * 6 + 7 GROUP BY ALL""")
def halo_patches(spark, d):
    p = V.halo_patches(views.voxels(spark, d), 6, 2)
    return p.groupBy("group_id", "slice_seq", "core_x", "core_y", "core_z").agg(F.count("*").alias("n_rows"), F.sum((F.col("x") + 17 * F.col("y") + 289 * F.col("z")).cast("long")).alias("place_sum"))


@query(f"WITH {VOXELS_SQL} SELECT group_id, slice_seq, CAST(x // 4 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, CAST(z // 4 AS INTEGER) AS z, count(*) AS n_voxels, max(line_score) AS max_line_score, round(avg(line_score), 6) AS mean_line_score FROM voxels GROUP BY group_id, slice_seq, x // 4, y // 4, z // 4")
def pooled_scores(spark, d):
    return _round(V.pooled(views.voxels(spark, d), 4, ["line_score"]))


# --- metrics ----------------------------------------------------------------------------------------------------------

_CM = f"""WITH {VOXELS_SQL}, cm AS (SELECT label, {LABEL_SQL.format(p=0.3, l=0.5)} AS pred, count(*) AS n FROM voxels WHERE label >= 0 GROUP BY ALL)"""
_RATES = """c(class_id) AS (VALUES (0), (1), (2)), t AS (
  SELECT {keys} class_id, CAST(sum(CASE WHEN label = class_id AND pred = class_id THEN n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN label <> class_id AND pred = class_id THEN n ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = class_id AND pred <> class_id THEN n ELSE 0 END) AS BIGINT) AS fn FROM cm, c GROUP BY {keys} class_id
), m AS (SELECT *, tp + fn AS support, tp / greatest(tp + fp, 1) AS "precision", tp / greatest(tp + fn, 1) AS recall,
    2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, 5 * tp / greatest(5 * tp + fp + 4 * fn, 1) AS f2, tp / greatest(tp + fp + fn, 1) AS iou FROM t)"""


def _cm(spark, d):
    v = views.voxels(spark, d)
    return M.confusion_matrix(v.withColumn("pred", C.label_of(F.col("pole_score"), F.col("line_score"), 0.3, 0.5)))


@query(_CM + " SELECT * FROM cm")
def confusion_matrix(spark, d):
    return _cm(spark, d)


@query(_CM + ", " + _RATES.format(keys="") + """ SELECT class_id, tp, fp, fn, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2, round(iou, 6) AS iou FROM m""")
def class_metrics(spark, d):
    return _round(M.class_metrics(_cm(spark, d)))


@query(_CM + ", " + _RATES.format(keys="") + " SELECT round((SELECT sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n) FROM cm), 6) AS accuracy, round(avg(iou), 6) AS mean_iou FROM m")
def overall_accuracy(spark, d):
    return _round(M.overall(_cm(spark, d)))


@query(f"WITH {SCORED_SQL} SELECT vec_id, round(pole_score, 6) AS pole_score, round(line_score, 6) AS line_score FROM scored")
def score_fusion(spark, d):
    return _round(views.scored(spark, d).select("vec_id", "pole_score", "line_score"))


_HIST = f"""WITH {SCORED_SQL}, hist AS (SELECT label, CAST(greatest(0, least(20, round_even(pole_score * 20, 0))) AS INTEGER) AS pole_bin,
  CAST(greatest(0, least(20, round_even(line_score * 20, 0))) AS INTEGER) AS line_bin, count(*) AS n FROM scored GROUP BY ALL)"""
_GRID_CM = """, g AS (SELECT {low} + i * {step} AS t FROM range({n}) r(i)), cm AS (
  SELECT a.t AS pole_threshold, b.t AS line_threshold, label, CASE WHEN pole_bin / 20.0 >= a.t AND (line_bin / 20.0 < b.t OR pole_bin >= line_bin) THEN 1 WHEN line_bin / 20.0 >= b.t THEN 2 ELSE 0 END AS pred, CAST(sum(n) AS BIGINT) AS n
  FROM hist, g a, g b GROUP BY ALL)"""


@query(_HIST + " SELECT * FROM hist")
def score_histogram(spark, d):
    return M.score_histogram(views.scored(spark, d))


@query(_HIST + _GRID_CM.format(low="0.3::DOUBLE", step="0.125::DOUBLE", n=4) + " SELECT * FROM cm")
def cm_from_histogram(spark, d):
    hist = M.score_histogram(views.scored(spark, d))
    return M.cm_from_histogram(hist, M.threshold_grid(hist, 4, 0.3, 0.675))


@query(_HIST + _GRID_CM.format(low="0.20::DOUBLE", step="0.05::DOUBLE", n=16) + ", " + _RATES.format(keys="pole_threshold, line_threshold,") + """, w AS (
  SELECT pole_threshold, line_threshold, sum(greatest(0, 0.95::DOUBLE - "precision") + greatest(0, 0.95::DOUBLE - recall) + greatest(0, 0.8::DOUBLE - iou)) AS gap, min(least("precision", recall, iou)) AS low, avg(iou) AS iou, avg("precision" + recall) / 2 AS pr
  FROM m WHERE class_id > 0 GROUP BY ALL), s AS (SELECT pole_threshold, line_threshold, round(CASE WHEN gap <= 1e-12 THEN 100 ELSE 0 END + 3 * low + 2 * iou + pr - 12 * gap, 9) AS score FROM w)
SELECT round(pole_threshold, 6) AS pole_threshold, round(line_threshold, 6) AS line_threshold, round(score, 6) AS score FROM s ORDER BY s.score DESC, s.pole_threshold, s.line_threshold LIMIT 1""")
def threshold_search(spark, d):
    return _round(M.threshold_search(M.score_histogram(views.scored(spark, d)), 16))


@query(f"""WITH {VOXELS_SQL}, k(label) AS (VALUES (0), (1), (2)), c AS (SELECT k.label, count(v.label) AS n FROM k LEFT JOIN voxels v USING (label) GROUP BY ALL), w AS (
  SELECT label, n, greatest(1, least(25, sum(greatest(n, 1)) OVER () / (3.0::DOUBLE * greatest(n, 1)))) AS w FROM c)
SELECT label, n, round(CASE WHEN label > 0 THEN greatest(w, 8) ELSE w END, 6)::DOUBLE AS weight FROM w""")
def class_weights(spark, d):
    return _round(M.class_weights(views.voxels(spark, d)))


_PR = """WITH s AS (SELECT d.doc_id, round(length(d.text) % 1000 / 1000.0, 3)::DOUBLE AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id)), e AS (
  SELECT score AS threshold, count(*) AS n, sum(label) AS pos FROM s GROUP BY ALL), c AS (
  SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS predicted, sum(pos) OVER () AS positives FROM e WINDOW w AS (ORDER BY threshold DESC))
"""


def _judged(spark, d):
    docs, labels = views.table(spark, d, "documents"), views.table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.round(F.length("text") % 1000 / 1000, 3).alias("score"), F.col("quality").alias("label"))


@query(_PR + "SELECT threshold, tp, predicted, round(tp / predicted, 6) AS \"precision\", round(tp / greatest(positives, 1), 6) AS recall FROM c")
def refiner_pr_curve(spark, d):
    return _round(M.precision_recall_curve(_judged(spark, d)))


@query(_PR + ", r AS (SELECT threshold, tp / predicted AS p, tp / greatest(positives, 1) AS r FROM c) SELECT round(sum((r - before) * p), 6) AS average_precision FROM (SELECT *, coalesce(lag(r) OVER (ORDER BY threshold DESC), 0) AS before FROM r)")
def refiner_average_precision(spark, d):
    return _round(M.average_precision(_judged(spark, d)))


# --- components -------------------------------------------------------------------------------------------------------

_WEAK = f"""WITH RECURSIVE {VOXELS_SQL}, weak AS (
  SELECT *, (CAST(z AS BIGINT) * 16 + y) * 16 + x AS key, line_score::FLOAT >= 0.6::FLOAT AS strong FROM voxels WHERE line_score::FLOAT >= 0.4::FLOAT AND line_score::FLOAT >= 0.55::FLOAT * pole_score::FLOAT
), edges AS (
  SELECT a.group_id, a.slice_seq, a.key AS a, b.key AS b FROM weak a JOIN weak b ON a.group_id = b.group_id AND a.slice_seq = b.slice_seq
    AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND a.key <> b.key
), cc(group_id, slice_seq, key, component) USING KEY (group_id, slice_seq, key) AS (
  SELECT group_id, slice_seq, key, key FROM weak
  UNION
  SELECT e.group_id, e.slice_seq, e.b, min(c.component) FROM cc c JOIN edges e ON e.group_id = c.group_id AND e.slice_seq = c.slice_seq AND e.a = c.key
    JOIN recurring.cc r ON r.group_id = e.group_id AND r.slice_seq = e.slice_seq AND r.key = e.b WHERE c.component < r.component GROUP BY ALL
)"""
_POINTS = _WEAK + """, held AS (
  SELECT group_id, slice_seq, component FROM cc JOIN weak USING (group_id, slice_seq, key) GROUP BY ALL HAVING bool_or(strong) AND count(*) >= 3
), points AS (SELECT group_id, slice_seq, component, x, y, z, CAST(line_score::FLOAT AS DOUBLE) AS score, label FROM cc JOIN weak USING (group_id, slice_seq, key) JOIN held USING (group_id, slice_seq, component))"""


def _weak(spark, d):
    return V.candidates(views.voxels(spark, d), CANDIDATES).where("line_weak")


def points(spark: SparkSession, d: str) -> DataFrame:
    return K.of_class(views.voxels(spark, d), "line", GRID, CANDIDATES)


@query(_WEAK + " SELECT group_id, slice_seq, x, y, z, component FROM cc JOIN weak USING (group_id, slice_seq, key)")
def connected_components(spark, d):
    return P.connected_components(_weak(spark, d), GRID.x, GRID.y)


@query(_WEAK + " SELECT group_id, slice_seq, count(*) AS pairs, CAST(sum(a * 31 + b) AS BIGINT) AS pair_sum FROM edges WHERE a < b GROUP BY ALL")
def neighbour_pairs(spark, d):
    p = P.neighbour_pairs(_weak(spark, d))
    a, b = C.linear_key(F.col("x0"), F.col("y0"), F.col("z0"), 16, 16), C.linear_key(F.col("x"), F.col("y"), F.col("z"), 16, 16)
    return p.groupBy("group_id", "slice_seq").agg(F.count("*").alias("pairs"), F.sum(F.least(a, b) * 31 + F.greatest(a, b)).alias("pair_sum"))


@query(_POINTS + " SELECT group_id, slice_seq, component, x, y, z FROM points")
def hysteresis_components(spark, d):
    return points(spark, d).select("group_id", "slice_seq", "component", "x", "y", "z")


_Q = "round(quantile_cont(score, {}), 6)"


@query(_POINTS + f" SELECT group_id, slice_seq, component, count(*) AS n_voxels, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std, {_Q.format(0.1)} AS score_p10, {_Q.format(0.5)} AS score_p50, {_Q.format(0.9)} AS score_p90, round(max(score), 6) AS score_max FROM points GROUP BY ALL")
def component_stats(spark, d):
    return _round(K.score_stats(points(spark, d)))


_EXTENTS = """, ext AS (SELECT group_id, slice_seq, component, count(*) AS n, (max(x) - min(x) + 1) * 0.5::DOUBLE AS x_span_ft, (max(y) - min(y) + 1) * 0.5::DOUBLE AS y_span_ft, (max(z) - min(z) + 1) * 0.5::DOUBLE AS z_span_ft,
  avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z, min(z) * 0.5::DOUBLE AS min_z_ft, max(z) * 0.5::DOUBLE AS max_z_ft FROM points GROUP BY ALL)"""


@query(_POINTS + _EXTENTS + " SELECT group_id, slice_seq, component, x_span_ft, y_span_ft, z_span_ft, round(n / (8 * x_span_ft * y_span_ft * z_span_ft), 6) AS bbox_density, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(center_z, 6) AS center_z, min_z_ft, max_z_ft, round(sqrt(x_span_ft * x_span_ft + y_span_ft * y_span_ft), 6) AS horizontal_span_ft, round(center_z * 0.5, 6) AS center_z_ft FROM ext")
def component_extents(spark, d):
    return _round(K.extents(points(spark, d), GRID))


@query(_POINTS + " SELECT group_id, slice_seq, component, min(least(x, 15 - x, y, 15 - y)) AS edge_distance_vox, min(least(x, 15 - x, y, 15 - y)) <= 1 AS touches_xy_edge FROM points GROUP BY ALL")
def edge_features(spark, d):
    return K.edge_features(points(spark, d), GRID, 1)


@query(_POINTS + " SELECT group_id, slice_seq, component, " + ", ".join(f"round(covar_samp({a}, {b}), 6) + 0.0 AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM points GROUP BY ALL HAVING count(*) > 2")
def component_covariance(spark, d):
    return _round(K.covariance(points(spark, d)))


@query()
def pca_features(spark, d):
    return _round(K.shapes(points(spark, d), GRID))


@query()
def component_features(spark, d):
    return _round(K.features(points(spark, d), "line", GRID))


@query()
def line_vertices(spark, d):
    return K.line_vertices(points(spark, d))


@query(_POINTS + """, q AS (SELECT *, quantile_cont(z, 0.15) OVER w AS lo, quantile_cont(z, 0.85) OVER w AS hi FROM points WINDOW w AS (PARTITION BY group_id, slice_seq, component)), b AS (
  SELECT group_id, slice_seq, component, median(CASE WHEN z <= lo THEN x END)::DOUBLE AS base_x, median(CASE WHEN z <= lo THEN y END)::DOUBLE AS base_y, min(z)::DOUBLE AS base_z,
    median(CASE WHEN z >= hi THEN x END)::DOUBLE AS top_x, median(CASE WHEN z >= hi THEN y END)::DOUBLE AS top_y, max(z)::DOUBLE AS top_z FROM q GROUP BY ALL)
SELECT *, (top_z - base_z + 1) * 0.5::DOUBLE AS height_ft, round(sqrt((top_x - base_x) * (top_x - base_x) + (top_y - base_y) * (top_y - base_y)) * 0.5, 6) AS tilt_ft FROM b""")
def pole_parameters(spark, d):
    return _round(K.pole_parameters(points(spark, d), GRID))


_GATED = _POINTS + _EXTENTS + """, f AS (SELECT group_id, slice_seq, component, z_span_ft, sqrt(x_span_ft * x_span_ft + y_span_ft * y_span_ft) AS h, z_span_ft / (z_span_ft + x_span_ft + y_span_ft) AS v, x_span_ft AS r FROM ext)"""


def _gated(spark, d):
    e = K.extents(points(spark, d), GRID)
    return e.withColumn("principal_verticality", F.col("z_span_ft") / (F.col("z_span_ft") + F.col("x_span_ft") + F.col("y_span_ft"))).withColumn("radius_p90_ft", F.col("x_span_ft")).withColumn("xy_tortuosity", F.lit(1.5))


@query(_GATED + " SELECT group_id, slice_seq, component, z_span_ft >= 1 AND z_span_ft <= 90 AND r <= 3.5 AND v >= 0.4 AND h / greatest(z_span_ft, 1e-6) <= 1.5 AS physical_ok FROM f")
def pole_gate(spark, d):
    return _gated(spark, d).select("group_id", "slice_seq", "component", K.pole_gate(whole=1.0, verticality=0.4, tilt=1.5).alias("physical_ok"))


@query(_GATED + " SELECT group_id, slice_seq, component, h >= 0.5 AND v <= 0.85 AND z_span_ft / greatest(h, 1e-6) <= 2.5 AS physical_ok FROM f")
def line_gate(spark, d):
    return _gated(spark, d).select("group_id", "slice_seq", "component", K.line_gate().alias("physical_ok"))


@query(_GATED + " SELECT group_id, slice_seq, component, ok AS component_accept, CASE WHEN ok THEN 'refiner_plus_loose_hard_gate' ELSE 'rejected' END AS accept_mode FROM (SELECT *, v >= 0.3 AND h >= 0.5 AND v <= 0.85 AND z_span_ft / greatest(h, 1e-6) <= 2.5 AS ok FROM f)")
def accept(spark, d):
    return K.accept(_gated(spark, d).withColumn("physical_ok", K.line_gate()).withColumn("refiner_probability", F.col("principal_verticality")), 0.3).select("group_id", "slice_seq", "component", "component_accept", "accept_mode")


@query(_POINTS + """ SELECT r.group_id, r.slice_seq, r.source_row, CASE WHEN g.source_row IS NULL THEN -1 WHEN p.x IS NOT NULL AND p.component % 2 = 0 THEN 1 WHEN p.x IS NOT NULL THEN 2 ELSE 0 END AS stage2_class
FROM raw_voxels r LEFT JOIN in_grid g USING (group_id, slice_seq, source_row) LEFT JOIN points p ON p.group_id = g.group_id AND p.slice_seq = g.slice_seq AND p.x = g.x AND p.y = g.y AND p.z = g.z""")
def voxel_component_labels(spark, d):
    raw = views.raw_voxels(spark, d).select("group_id", "slice_seq", "source_row", *(C.voxel(F.col(c)).alias(c) for c in "xyz"))
    raw = raw.withColumn("in_grid", F.col("x").between(0, 15) & F.col("y").between(0, 15) & F.col("z").between(0, 7))
    p = points(spark, d)
    return K.voxel_classes(raw, p.where("component % 2 = 0"), p.where("component % 2 = 1")).select("group_id", "slice_seq", "source_row", "stage2_class")


@query(_POINTS + """, gt AS (SELECT group_id, slice_seq, x, y, z FROM voxels WHERE label = 2), near AS (
  SELECT p.group_id, p.slice_seq, p.component, p.x, p.y, p.z, min(sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2 + (p.z - g.z) ** 2)) AS dist FROM points p JOIN gt g ON p.group_id = g.group_id AND p.slice_seq = g.slice_seq
    AND abs(p.x - g.x) <= 2 AND abs(p.y - g.y) <= 2 AND abs(p.z - g.z) <= 2 GROUP BY ALL)
SELECT group_id, slice_seq, component, round(avg(CASE WHEN dist <= 1e-9 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS exact_gt_fraction, round(avg(CASE WHEN dist <= 2.5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS near_gt_fraction
FROM points LEFT JOIN near USING (group_id, slice_seq, component, x, y, z) GROUP BY ALL""")
def gt_proximity(spark, d):
    return _round(K.ground_truth_shares(points(spark, d), views.voxels(spark, d).where("label = 2")))


_TARGETS = """, near AS (SELECT group_id, slice_seq, component, avg(CASE WHEN label = 2 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM points GROUP BY ALL), t AS (
  SELECT CASE WHEN share >= 0.2 THEN 1 WHEN NOT (h >= 0.5 AND v <= 0.85 AND z_span_ft / greatest(h, 1e-6) <= 2.5) THEN 0 ELSE -1 END AS target FROM f JOIN near USING (group_id, slice_seq, component))"""


@query(_GATED + _TARGETS + " SELECT 'line' AS class_name, target, count(*) AS n, sum(CASE target WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.75::DOUBLE ELSE 0 END) AS weight FROM t GROUP BY ALL")
def target_counts(spark, d):
    share = points(spark, d).join(views.voxels(spark, d).select("group_id", "slice_seq", "x", "y", "z", "label"), ["group_id", "slice_seq", "x", "y", "z"]).groupBy(*K.COMPONENT).agg(F.avg(F.when(F.col("label") == 2, 1.0).otherwise(0.0)).alias("gt_exact_fraction"))
    df = _gated(spark, d).withColumn("physical_ok", K.line_gate()).join(share, list(K.COMPONENT)).withColumn("gt_near_fraction", F.lit(0.0)).withColumn("gt_exact_fraction", F.when(F.col("gt_exact_fraction") >= 0.2, 1.0).otherwise(0.0))
    return M.noise_tolerant_targets(df, "line").groupBy(F.lit("line").alias("class_name"), "target").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("weight"))


# --- sessions ---------------------------------------------------------------------------------------------------------

_SEEN = f"WITH {SLICES_SQL}, seen AS (SELECT DISTINCT group_id, slice_seq FROM slices WHERE (group_id * 7 + slice_seq) % 11 <> 0)"
_INV = f"WITH {PATHS_SQL}, inv AS (SELECT path, split_part(path, '/', 1) AS geography, regexp_extract(split_part(path, '/', 2), '^(session[0-9]+)_slice([0-9]+)$', 1) AS session, CAST(regexp_extract(split_part(path, '/', 2), '^(session[0-9]+)_slice([0-9]+)$', 2) AS BIGINT) AS slice_seq FROM paths), i AS (SELECT *, geography || '/' || session AS group_id FROM inv)"
_COVER = _INV + ", c AS (SELECT group_id, count(*) AS files, count(DISTINCT slice_seq) AS slices, min(slice_seq) AS \"first\", max(slice_seq) AS \"last\" FROM i GROUP BY ALL), v AS (SELECT *, \"last\" - \"first\" + 1 - slices AS missing, files - slices AS duplicates FROM c)"


def _seen(spark, d):
    return views.slices(spark, d).select("group_id", "slice_seq").distinct().where((F.col("group_id") * 7 + F.col("slice_seq")) % 11 != 0)


@query(_INV + " SELECT path, geography, session, slice_seq, group_id FROM i")
def session_inventory(spark, d):
    return S.inventory(views.paths(spark, d))


@query(_COVER + " SELECT *, CASE WHEN duplicates > 0 THEN 'duplicate' WHEN missing > 0 THEN 'gaps' ELSE 'complete' END AS status FROM v")
def session_coverage(spark, d):
    return S.coverage(S.inventory(views.paths(spark, d)))


@query(_COVER + " SELECT group_id, slices FROM v WHERE duplicates = 0 ORDER BY slices DESC, group_id LIMIT 1")
def largest_valid_session(spark, d):
    return S.largest_valid(S.coverage(S.inventory(views.paths(spark, d)))).select("group_id", "slices")


@query(f"WITH {PATHS_SQL} SELECT replace(path, '_slice', '-part') AS path FROM paths WHERE path LIKE '%_slice1%'")
def unmatched_inputs(spark, d):
    p = views.paths(spark, d)
    return S.unmatched(p.unionByName(p.where("path LIKE '%_slice1%'").select(F.regexp_replace("path", "_slice", "-part").alias("path"))))


@query(_SEEN + ", b AS (SELECT group_id, min(slice_seq) AS a, max(slice_seq) AS b FROM seen GROUP BY ALL) SELECT b.group_id, r.i AS slice_seq FROM b, range(0, 400) r(i) WHERE r.i BETWEEN b.a AND b.b AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.group_id = b.group_id AND s.slice_seq = r.i)")
def missing_sequences(spark, d):
    return S.missing_sequences(_seen(spark, d))


@query(f"WITH {SLICES_SQL}, m AS (SELECT group_id, slice_seq, count(*) AS n, 'old' AS state FROM slices GROUP BY ALL) SELECT group_id, slice_seq, CASE WHEN slice_seq % 2 = 0 OR slice_seq > 25 THEN n + 1 ELSE n END AS n, CASE WHEN slice_seq % 2 = 0 OR slice_seq > 25 THEN 'new' ELSE state END AS state FROM m")
def manifest_upsert(spark, d):
    m = views.slices(spark, d).groupBy("group_id", "slice_seq").agg(F.count("*").alias("n")).withColumn("state", F.lit("old"))
    new = m.where("slice_seq % 2 = 0 OR slice_seq > 25").withColumn("n", F.col("n") + 1).withColumn("state", F.lit("new"))
    return S.upsert(m.where("slice_seq <= 25"), new)


@query(f"WITH {SLICES_SQL} SELECT DISTINCT group_id, slice_seq FROM slices WHERE slice_seq % 3 <> 0")
def resume_pending(spark, d):
    s = views.slices(spark, d).select("group_id", "slice_seq").distinct()
    return S.pending(s, s.where("slice_seq % 3 = 0"))


@query(f"WITH {SLICES_SQL} SELECT group_id, slice_seq, event_id, round(value, 6) AS value FROM slices QUALIFY row_number() OVER (PARTITION BY group_id, slice_seq ORDER BY event_id DESC) = 1")
def latest_per_slice(spark, d):
    return _round(S.latest(views.slices(spark, d).select("group_id", "slice_seq", "event_id", "value"), "event_id"))


@query(_SEEN + """, w AS (SELECT a.group_id, a.slice_seq, list_sort(list(b.slice_seq)) AS m FROM seen a JOIN seen b ON a.group_id = b.group_id AND b.slice_seq BETWEEN a.slice_seq - 9 AND a.slice_seq GROUP BY ALL)
SELECT group_id, slice_seq, CAST(len(m) AS INTEGER) AS observed, m[1] AS first_seq, array_to_string(m, ';') AS observed_slices FROM w""")
def rolling_window_members(spark, d):
    return S.window_members(_seen(spark, d))


@query(_SEEN + ", o AS (SELECT s.group_id, s.slice_seq, s.event_id FROM slices s JOIN seen USING (group_id, slice_seq)) SELECT e.group_id, e.slice_seq AS window_seq, count(*) AS n, CAST(sum(o.event_id) AS BIGINT) AS id_sum FROM seen e JOIN o ON o.group_id = e.group_id AND o.slice_seq BETWEEN e.slice_seq - 9 AND e.slice_seq GROUP BY ALL")
def window_objects(spark, d):
    seen = _seen(spark, d)
    objects = views.slices(spark, d).join(seen, ["group_id", "slice_seq"], "left_semi")
    return S.in_windows(objects, seen).groupBy("group_id", "window_seq").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


_STATS = "count(ms) AS n, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(min(ms), 6) AS min, round(max(ms), 6) AS max, round(sum(ms), 4) AS total"
_LONG = f"WITH {SLICES_SQL}, t AS (SELECT group_id, 'stage1_ms' AS metric, value AS ms FROM slices UNION ALL SELECT group_id, 'stage2_ms', value * (1 + slice_seq % 4) FROM slices)"


def _timed(spark, d):
    return views.slices(spark, d).select("group_id", "slice_seq", F.col("value").alias("stage1_ms"), (F.col("value") * (1 + F.col("slice_seq") % 4)).alias("stage2_ms"))


@query(_LONG + f" SELECT metric, {_STATS} FROM t GROUP BY ALL")
def timing_stats(spark, d):
    df = M.timing_stats(_timed(spark, d), ["stage1_ms", "stage2_ms"])
    return _round(df.withColumn("total", F.round("total", 4)))


@query(_LONG + f" SELECT group_id, metric, {_STATS} FROM t GROUP BY ALL")
def timing_by_group(spark, d):
    df = M.timing_stats(_timed(spark, d), ["stage1_ms", "stage2_ms"], ("group_id",))
    return _round(df.withColumn("total", F.round("total", 4)))


@query(f"""WITH {SLICES_SQL}, t AS (SELECT group_id, slice_seq, round(avg(value), 6) AS v, count(*) AS n FROM slices GROUP BY ALL)
SELECT group_id, slice_seq, CASE WHEN slice_seq % 3 <> 0 THEN v END AS stage1_ms, CASE WHEN slice_seq % 3 = 1 THEN n WHEN slice_seq % 3 = 2 THEN n + 1 ELSE n + 1 END AS total_n, CASE WHEN slice_seq % 3 <> 1 THEN round(v * 2, 6) END AS stage2_ms FROM t""")
def timing_full_outer(spark, d):
    t = views.slices(spark, d).groupBy("group_id", "slice_seq").agg(F.round(F.avg("value"), 6).alias("v"), F.count("*").alias("n"))
    one = t.where("slice_seq % 3 <> 0").select("group_id", "slice_seq", F.col("v").alias("stage1_ms"), F.col("n").alias("total_n"))
    two = t.where("slice_seq % 3 <> 1").select("group_id", "slice_seq", (F.col("n") + 1).alias("total_n"), F.round(F.col("v") * 2, 6).alias("stage2_ms"))
    return _round(S.merge_timings(one, two))


@query(_SEEN + ", t AS (SELECT group_id, slice_seq, max(event_id) AS top FROM slices JOIN seen USING (group_id, slice_seq) GROUP BY ALL) SELECT group_id, slice_seq, lag(slice_seq) OVER w AS previous_seq, top - lag(top) OVER w AS delta FROM t WINDOW w AS (PARTITION BY group_id ORDER BY slice_seq)")
def slice_deltas(spark, d):
    t = views.slices(spark, d).join(_seen(spark, d), ["group_id", "slice_seq"], "left_semi").groupBy("group_id", "slice_seq").agg(F.max("event_id").alias("top"))
    return S.deltas(t, "top")


@query(f"WITH {SLICES_SQL}, t AS (SELECT group_id, slice_seq - lag(slice_seq) OVER (PARTITION BY group_id ORDER BY event_id) AS step FROM slices) SELECT group_id, coalesce(bool_and(step > 0), true) AS strictly_increasing, count_if(step <= 0)::BIGINT AS violations FROM t GROUP BY ALL")
def increasing_check(spark, d):
    return S.increasing(views.slices(spark, d), "event_id")


@query(f"WITH {SCORED_SQL} SELECT vec_id, round(line_score, 6) AS line_score FROM scored ORDER BY scored.line_score DESC, vec_id LIMIT 3")
def topk_candidates(spark, d):
    return _round(S.top_k(views.scored(spark, d).select("vec_id", "line_score"), "line_score", 3, "vec_id"))


@query(f"WITH {SCORED_SQL} SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY pole_score DESC, line_score, vec_id) AS r FROM scored) WHERE r = 1")
def best_candidate(spark, d):
    df = views.scored(spark, d)
    return df.groupBy("label").agg(F.max_by("vec_id", F.struct("pole_score", -F.col("line_score"), -F.col("vec_id"))).alias("vec_id"))


@query("WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM r WHERE i IN (SELECT CAST(floor(k * ((SELECT count(*) FROM embeddings) - 1) / 31.0) AS BIGINT) FROM range(32) t(k))")
def even_sample(spark, d):
    return S.even_sample(views.table(spark, d, "embeddings").select("vec_id"), ["vec_id"], 32)


@query(_INV + ", g AS (SELECT DISTINCT group_id FROM i), r AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM g) SELECT group_id, CASE WHEN r <= greatest(1, floor(n * 0.2)) THEN 'test' WHEN r <= 2 * greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM r")
def group_split(spark, d):
    return S.group_split(S.inventory(views.paths(spark, d)))


@query(f"WITH {PATHS_SQL} SELECT path, regexp_replace(path, '[^A-Za-z0-9_.-]+', '__', 'g') AS safe_id, list_transform(regexp_extract_all(path, '-?[0-9]+'), lambda x: CAST(x AS BIGINT)) AS numbers, sha256(path) AS fingerprint FROM paths")
def path_functions(spark, d):
    return views.paths(spark, d).select("path", C.safe_id(F.col("path")).alias("safe_id"), C.whole_numbers(F.col("path")).alias("numbers"), F.sha2("path", 256).alias("fingerprint"))


@query(f"""WITH {VOXELS_SQL}, a AS (SELECT * FROM voxels WHERE source_row % 50 <> 0), b AS (SELECT group_id, slice_seq, x, y, z, line_score + CASE WHEN source_row % 7 = 0 THEN 0.25 ELSE 0 END AS line_score, pole_score FROM voxels WHERE source_row % 60 <> 0)
SELECT count(*) FILTER (WHERE a.x IS NULL OR b.x IS NULL) AS key_mismatches, round(coalesce(max(abs(a.line_score - b.line_score)), 0), 6) AS max_line_score, round(coalesce(max(abs(a.pole_score - b.pole_score)), 0), 6) AS max_pole_score
FROM a FULL JOIN b ON a.group_id = b.group_id AND a.slice_seq = b.slice_seq AND a.x = b.x AND a.y = b.y AND a.z = b.z""")
def variant_equivalence(spark, d):
    v = views.voxels(spark, d)
    other = v.where("source_row % 60 <> 0").withColumn("line_score", F.col("line_score") + F.when(F.col("source_row") % 7 == 0, 0.25).otherwise(0.0))
    return _round(S.compare(v.where("source_row % 50 <> 0"), other, ["group_id", "slice_seq", "x", "y", "z"], ["line_score", "pole_score"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | stage3.queries(points) | operations.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | stage3.oracle_sql(_POINTS) | operations.oracle_sql()
