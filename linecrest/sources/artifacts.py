"""What stages leave behind: scored voxels as partitions of slices, tables as CSV or JSON, manifests by slice, settings."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linecrest.functions import columns as C
from linecrest.operators import gates, slices

#: The version that artifacts carry; others are refused.
VERSION = "linecrest-1"
REQUIRED = ("x", "y", "z", "pole_score", "line_score")
DEFAULTS = {"dist_value": ("double", "0"), "label": ("int", "0"), "semantic": ("int", "0"), "objectness": ("double", "0")}


def paths(path: Column, suffix: str, stage: str) -> Column:
    """Where a stage keeps what it made of a source: <stage>/<path without .csv or .csv.gz>_<suffix>."""
    return F.concat(F.lit(f"{stage}/"), C.without_csv(path), F.lit(f"_{suffix}"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Scored voxels, a partition a slice; the slices of `scores` replace theirs, others stay. Spark's committer makes
    a job's files visible when all of them are written."""
    missing = [c for c in (*slices.SLICE, *REQUIRED) if c not in scores.columns]
    if missing:
        raise ValueError(f"scored voxels lack {', '.join(missing)}")
    scores.withColumn("contract_version", F.lit(VERSION)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*slices.SLICE).parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scored voxels with the defaults of columns that are not there. Rows that lack a required value, or of another
    version, raise when they are read."""
    df = spark.read.parquet(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"artifact {path} lacks {', '.join(missing)}")
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & F.col(c).isNotNull()
    version = F.col("contract_version") if "contract_version" in df.columns else F.lit(VERSION)
    fine = F.when(~whole, F.raise_error(F.lit(f"artifact {path}: scores and coordinates differ in number"))).when(F.coalesce(version, F.lit(VERSION)) != VERSION, F.raise_error(F.concat(F.lit(f"artifact {path}: version "), version))).otherwise(F.lit(True))
    more = [(F.coalesce(F.col(c).cast(t), F.lit(v).cast(t)) if c in df.columns else F.lit(v).cast(t)).alias(c) for c, (t, v) in DEFAULTS.items()]
    return df.where(fine).select(*slices.SLICE, *(c for c in df.columns if c not in (*slices.SLICE, *DEFAULTS, "contract_version")), *more)


def write_table(df: DataFrame, path: str, form: str = "csv", compression: str = "none") -> None:
    """A small result as one file (csv with its header, also without rows, or json)."""
    out = df.coalesce(1).write.mode("overwrite").option("compression", compression)
    out.option("header", "true").csv(path) if form == "csv" else out.json(path)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table by its header, with the schema's columns in its order: those it lacks are null, a path that is not
    there or a file without a header has no rows."""
    wanted = StructType.fromDDL(schema)
    nothing = spark.createDataFrame([], wanted)
    if not _there(spark, path):
        return nothing
    df = spark.read.option("header", "true").csv(path)
    if not df.columns:
        return nothing
    return df.select(*((F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest's rows; none if it was never written. After a stop between the two steps of write_manifest its new
    form is taken. A manifest that cannot be read raises: it is never taken for an empty one."""
    wanted = StructType.fromDDL(schema)
    there = next((p for p in (path, path + ".next") if _there(spark, p + "/_SUCCESS")), None)
    if there is None:
        if _there(spark, path):
            raise OSError(f"manifest {path} is not complete; it is not replaced")
        return spark.createDataFrame([], wanted)
    try:
        df = spark.read.parquet(there)
    except AnalysisException as e:
        raise OSError(f"manifest {there} cannot be read; it is not replaced") from e
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))


def write_manifest(rows: DataFrame, path: str, schema: str) -> DataFrame:
    """Rows in place of those of equal group and slice, ordered by both. The new form is complete beside the old one
    before it takes its place."""
    spark = rows.sparkSession
    whole = slices.upsert(read_manifest(spark, path, schema), rows).orderBy(*slices.SLICE)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".next"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old) and fs.exists(new):
        fs.rename(new, old)
        whole = slices.upsert(read_manifest(spark, path, schema), rows).orderBy(*slices.SLICE)
    whole.write.mode("overwrite").parquet(path + ".next")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"manifest {path}.next could not take its place")
    return read_manifest(spark, path, schema)


def repaired(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The manifest with rows for slices whose artifacts are there but which it does not have."""
    return manifest.unionByName(slices.pending(artifacts, manifest), allowMissingColumns=True)


def settings(spark: SparkSession, path: str, defaults: dict, features: str | None = None, forbidden: tuple[str, ...] = ()) -> dict:
    """A JSON file's settings over their defaults, nested by dots. Where `features` names a list of model inputs, the
    forbidden ones raise."""
    found = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()))

    def get(name: str):
        at = found
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return at

    wrong = gates.forbidden_features(list(get(features) or []), list(forbidden)) if features else []
    if wrong:
        raise ValueError(f"{path}: not allowed as features: {', '.join(wrong)}")
    return {name: default if get(name) is None else get(name) for name, default in defaults.items()}
