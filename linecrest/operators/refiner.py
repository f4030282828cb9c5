"""The learned refiner of components: a forest over their features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecrest.functions import columns as C
from linecrest.operators import gates

#: Columns that tell where a component lies or what it truly is.
FORBIDDEN = ("group_id", "slice_seq", "component", "center_x", "center_y", "center_z", "label", "target", "weight")


def inputs(components: DataFrame, names: list[str]) -> list[Column]:
    """The features as numbers; missing columns, nulls and infinities are 0."""
    return [(F.coalesce(C.number(F.col(n)), F.lit(0.0)) if n in components.columns else F.lit(0.0)).alias(n) for n in names]


def train(components: DataFrame, names: list[str], trees: int = 600, depth: int = 20, leaf: int = 2, seed: int = 42) -> PipelineModel:
    """A forest from components with target 0 or 1 (-1, ambiguous, takes no part) and weight; each class weighs the same
    in sum. Splits choose among the square root of the features."""
    wrong = gates.forbidden_features(names, list(FORBIDDEN))
    if wrong:
        raise ValueError(f"not allowed as features: {', '.join(wrong)}")
    df = components.where("target IN (0, 1)").select(F.col("target").cast("double").alias("target"), F.coalesce(C.number(F.col("weight")), F.lit(0.0)).alias("weight"), *inputs(components, names))
    sums = {r["target"]: r["total"] for r in df.groupBy("target").agg(F.sum("weight").alias("total")).collect()}
    if len(sums) < 2:
        raise ValueError("the refiner needs components of both targets")
    each = sum(sums.values()) / 2
    balanced = F.col("weight") * F.when(F.col("target") == 1, each / sums[1.0]).otherwise(each / sums[0.0])
    forest = RandomForestClassifier(labelCol="target", featuresCol="features", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed, probabilityCol="probability")
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    return PipelineModel([vectors, forest.fit(vectors.transform(df.withColumn("w", balanced)))])


def apply(model: PipelineModel, components: DataFrame) -> DataFrame:
    """components with refiner_probability."""
    names = model.stages[0].getInputCols()
    made = [f"_in_{n}" for n in names]
    df = components.select("*", *(c.alias(m) for c, m in zip(inputs(components, names), made, strict=True)))
    vectors = VectorAssembler(inputCols=made, outputCol="features")
    scored = model.stages[1].transform(vectors.transform(df))
    return scored.withColumn("refiner_probability", vector_to_array("probability")[1]).drop(*made, "features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, spark, k: int = 20) -> DataFrame:
    """The k most important features, ties by name."""
    rows = [(n, float(v)) for n, v in zip(model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)
