"""Evaluation of classes and scores, threshold search, and statistics of timings. A metric is an aggregate over counts,
so per-file partial counts add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecrest.functions import columns as C

CLASSES = (0, 1, 2)


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by label and prediction; labels other than 0, 1 and 2 do not count."""
    return df.where(F.col(label).isin(*CLASSES)).groupBy(*keys, F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def _rate(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1, f2 and iou from tp, fp and fn; what has no rows is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    df = df.withColumn("support", tp + fn).withColumn("precision", _rate(tp, tp + fp)).withColumn("recall", _rate(tp, tp + fn))
    df = df.withColumn("f1", _rate(2 * tp, 2 * tp + fp + fn)).withColumn("f2", _rate(5 * tp, 5 * tp + fp + 4 * fn))
    return df.withColumn("iou", _rate(tp, tp + fp + fn))


def class_metrics(cm: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per class: what a confusion matrix of label, pred and n says of it."""
    each = cm.withColumn("class_id", F.explode(F.array(*map(F.lit, CLASSES))))
    is_label, is_pred = F.col("label") == F.col("class_id"), F.col("pred") == F.col("class_id")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return rates(each.groupBy(*keys, "class_id").agg(count(is_label & is_pred).alias("tp"), count(~is_label & is_pred).alias("fp"), count(is_label & ~is_pred).alias("fn")))


def overall(cm: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and mean IoU of a confusion matrix."""
    share = cm.groupBy(*keys).agg((F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("accuracy"))
    mean = class_metrics(cm, keys).groupBy(*keys).agg(F.avg("iou").alias("mean_iou"))
    return share.join(mean, list(keys)) if keys else share.crossJoin(mean)  # a row each


def score_histogram(df: DataFrame, bins: int = 21, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts by label, pole bin and line bin; a bin is the score times bins - 1, half to even."""
    bin_of = lambda c: C.clamp(F.rint(F.col(c) * (bins - 1)), 0, bins - 1).cast("int")
    return df.where(F.col("label").isin(*CLASSES)).groupBy(*keys, F.col("label").cast("int").alias("label"), bin_of("pole_score").alias("pole_bin"), bin_of("line_score").alias("line_bin")).agg(F.count("*").alias("n"))


def cm_from_histogram(hist: DataFrame, thresholds: DataFrame, bins: int = 21) -> DataFrame:
    """Confusion matrices for pairs of thresholds (pole_threshold, line_threshold), from a histogram: bins**2 * 3 rows at
    most meet a grid of thresholds, whatever the corpus."""
    score = lambda c: F.col(c) / (bins - 1)
    both = hist.crossJoin(F.broadcast(thresholds))
    pred = C.label_of(score("pole_bin"), score("line_bin"), F.col("pole_threshold"), F.col("line_threshold"))
    return both.groupBy("pole_threshold", "line_threshold", "label", pred.alias("pred")).agg(F.sum("n").alias("n"))


def threshold_grid(df: DataFrame, steps: int, low: float, high: float) -> DataFrame:
    """All pairs of `steps` thresholds, low + i * step: the step is one number, rounded to 12 digits, so that a step such as
    0.05 is that number and a threshold has the last digit which decides about a score of the same value."""
    spark = df.sparkSession
    step = round((high - low) / max(1, steps - 1), 12)
    t = spark.range(steps).select((F.lit(low) + F.col("id") * step).alias("t"))
    return t.select(F.col("t").alias("pole_threshold")).crossJoin(t.select(F.col("t").alias("line_threshold")))


def threshold_search(hist: DataFrame, steps: int = 31, low: float = 0.20, high: float = 0.95, precision: float = 0.95, recall: float = 0.95, iou: float = 0.80, bins: int = 21) -> DataFrame:
    """The pair of thresholds whose poles and lines come nearest to the targets, the smaller thresholds among equals.
    The score is 3 times the least of all rates, 2 times the mean iou and the mean of precisions and recalls, less 12 for
    each unit short of a target, and 100 more if none is short."""
    cm = cm_from_histogram(hist, threshold_grid(hist, steps, low, high), bins)
    m = class_metrics(cm, ("pole_threshold", "line_threshold")).where("class_id > 0")
    short = lambda c, goal: F.greatest(F.lit(0.0), F.lit(goal) - F.col(c))
    gap = F.sum(short("precision", precision) + short("recall", recall) + short("iou", iou))
    least = F.min(F.least("precision", "recall", "iou"))
    both = m.groupBy("pole_threshold", "line_threshold").agg(gap.alias("gap"), least.alias("least"), F.avg("iou").alias("iou"), (F.avg(F.col("precision") + F.col("recall")) / 2).alias("pr"))
    worth = F.when(F.col("gap") <= 1e-12, 100.0).otherwise(0.0) + 3 * F.col("least") + 2 * F.col("iou") + F.col("pr") - 12 * F.col("gap")
    return both.select("pole_threshold", "line_threshold", F.round(worth, 9).alias("score")).orderBy(F.desc("score"), "pole_threshold", "line_threshold").limit(1)


def class_weights(df: DataFrame, most: float = 25.0, rare_least: float = 8.0) -> DataFrame:
    """total / (3 n) of each class, between 1 and `most`; of poles and lines at least `rare_least`."""
    counts = df.where(F.col("label").isin(*CLASSES)).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(c,) for c in CLASSES], "label int").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    counted = F.greatest(F.col("n"), F.lit(1))
    weight = C.clamp(F.sum(counted).over(Window.partitionBy()) / (3.0 * counted), 1.0, most)
    return every.select("label", "n", F.when(F.col("label") > 0, F.greatest(weight, F.lit(rare_least))).otherwise(weight).alias("weight"))


def noise_tolerant_targets(df: DataFrame, class_name: str) -> DataFrame:
    """1 where ground truth touches or is near enough; 0 where it is not and the shape is impossible; else -1 (left out
    of training). Limits (fixed values): pole 0.30 and 0.20, line 0.20 and 0.10."""
    exact, near = {"pole": (0.30, 0.20), "line": (0.20, 0.10)}[class_name]
    positive = (F.col("gt_near_fraction") >= exact) | (F.col("gt_exact_fraction") >= near)
    target = F.when(positive, 1).when(~F.col("physical_ok"), 0).otherwise(-1)
    return df.withColumn("target", target).withColumn("sample_weight", F.when(target == 1, 1.0).when(target == 0, 0.75).otherwise(0.0))


def timing_stats(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row per timing column and key: count, mean, p50, p95, min, max and total of its numbers."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as (metric, ms)").withColumn("ms", C.number(F.col("ms")))
    quantile = lambda q: F.percentile("ms", F.lit(q))
    return long.groupBy(*keys, "metric").agg(F.count("ms").alias("n"), F.avg("ms").alias("mean"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.sum("ms").alias("total"))


def _running(each: DataFrame, columns: list[str], bins: int = 1024) -> DataFrame:
    """each (threshold, distinct, mostly within 0 and 1) with above_<column>, the sum of a column at and above the
    threshold, and all_<column>. Sums run within bins of thresholds, then over the bins, so that no task has them all."""
    binned = each.withColumn("_bin", F.floor(C.clamp(F.col("threshold")) * bins))
    down = Window.partitionBy("_bin").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    totals = binned.groupBy("_bin").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    higher = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_bin", *(F.coalesce(F.sum(f"_{c}").over(higher), F.lit(0)).alias(f"_{c}") for c in columns), *(F.sum(f"_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in columns))
    met = binned.join(F.broadcast(totals), "_bin")
    return met.select(*each.columns, *((F.sum(c).over(down) + F.col(f"_{c}")).alias(f"above_{c}") for c in columns), *(f"all_{c}" for c in columns))


def precision_recall_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """A row per distinct score: how many are at or above it, and precision and recall there."""
    each = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    tp, n = F.col("above_pos"), F.col("above_n")
    return _running(each, ["n", "pos"]).select("threshold", tp.alias("tp"), n.alias("predicted"), (tp / n).alias("precision"), (tp / F.greatest(F.col("all_pos"), F.lit(1))).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The mean of the precision at each distinct score, weighted by the positives that have it."""
    each = df.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    part = F.col("pos") * F.col("above_pos") / F.col("above_n") / F.greatest(F.col("all_pos"), F.lit(1))
    return _running(each, ["n", "pos"]).agg(F.sum(part).alias("average_precision"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The share of pairs of a positive and a negative in which the positive has the greater score, equal ones by half;
    null without such pairs."""
    y = F.col(label).cast("long")
    each = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    below = F.col("all_neg") - F.col("above_neg") + F.col("neg") / 2
    worth = F.col("pos") * below / F.nullif(F.col("all_pos") * F.col("all_neg"), F.lit(0))
    return _running(each, ["pos", "neg"]).agg(F.sum(worth).alias("roc_auc"))


def refiner_threshold(df: DataFrame, steps: int = 97, low: float = 0.02, high: float = 0.98, precision: float = 0.9, recall: float = 0.9) -> DataFrame:
    """The probability from which components count as accepted: the best of `steps` by 4 iou + 3 recall + precision, less
    8 for each unit of precision and 16 of recall short of the targets. Probabilities are counted by how many steps they pass."""
    passed = F.floor((F.col("probability") - low) / ((high - low) / (steps - 1)) + 1e-9)
    counts = df.groupBy(F.least(F.lit(steps - 1), passed).alias("k")).agg(F.sum(F.when(F.col("physical_ok") & (F.col("target") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("physical_ok") & (F.col("target") == 0), 1).otherwise(0)).alias("fp"), F.sum((F.col("target") == 1).cast("int")).alias("pos"))
    grid = df.sparkSession.range(steps).select(F.col("id").alias("step"))
    met = grid.join(F.broadcast(counts), F.col("k") >= F.col("step"), "left")
    total = counts.agg(F.sum("pos").alias("total"))
    m = met.groupBy("step").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp")).crossJoin(total)
    m = rates(m.withColumn("fn", F.coalesce("total", F.lit(0)) - F.col("tp")))
    gap = F.greatest(F.lit(0.0), precision - F.col("precision")) + 2 * F.greatest(F.lit(0.0), recall - F.col("recall"))
    worth = F.round(4 * F.col("iou") + 3 * F.col("recall") + F.col("precision") - 8 * gap, 9)
    return m.select((low + F.col("step") * (high - low) / (steps - 1)).alias("threshold"), "precision", "recall", "iou", worth.alias("score")).orderBy(F.desc("score"), "threshold").limit(1)
