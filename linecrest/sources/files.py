"""Files of slices and objects: listings, sessions, and reads that report what they could not read.

Every file is one slice or one slice's objects, bounded by the grid; it is parsed whole in one task, by its own header."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from linecrest.operators import slices


def _plain(file: Column) -> Column:
    """A file's whole path without what differs in writing: local paths begin with one slash."""
    return F.regexp_replace(file, "^file:/+", "/")


def _held(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def listing(spark: SparkSession, root: str, pattern: str = "*.{csv,csv.gz}") -> DataFrame:
    """Files below root: file (whole path), path (below root) and length. Contents are not read. Spark makes no rows for
    files without bytes, so these come from the list of names that its reader holds in any case."""
    held = _held(spark, root, pattern)
    names = spark.createDataFrame([(unquote(n),) for n in held.inputFiles()], "name string").select(_plain(F.col("name")).alias("file"))
    df = names.join(held.select(_plain(F.col("path")).alias("file"), "length"), "file", "left")
    below = F.lit(re.sub("^file:/+", "/", root).rstrip("/") + "/")
    return df.select("file", F.element_at(F.split("file", F.concat(F.lit(r"\Q"), below, F.lit(r"\E"))), -1).alias("path"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def session(files: DataFrame, group: str) -> DataFrame:
    """A session's slices (slice_seq, path, ...) by number and path. group is geography/sessionN; the session's case does
    not matter. An error if it has another form, if no file matches, or if a number has two files."""
    if not pd.Series([group]).str.fullmatch(r"[^/]+/(?i:session)\d+").iloc[0]:
        raise ValueError(f"a session is geography/sessionN, not {group!r}")
    geography, name = group.split("/")
    parts = F.split("path", "/")
    met = files.where((F.element_at(parts, 1) == geography) & (F.size(parts) >= 3) & F.get(parts, F.size(parts) - 2).rlike(slices.FOLDER))
    met = met.select("*", slices.parse_path(F.col("path")).alias("_p")).where(F.lower("_p.session") == name.lower())
    out = met.select(F.col("_p.slice_seq").alias("slice_seq"), *files.columns)
    twice = out.groupBy("slice_seq").count().agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("count") > 1, F.col("slice_seq")))).alias("twice")).collect()[0]
    if not twice["n"]:
        raise FileNotFoundError(f"no slices of {group}")
    if twice["twice"]:
        raise ValueError(f"more than one file for slices {twice['twice'][:20]} of {group}")
    return out.orderBy("slice_seq", "path")


def from_manifest(files: DataFrame, manifest: DataFrame, missing: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Files that a manifest (path) names, and an audit of those that are not there; with missing="error" these raise."""
    gone = manifest.select("path").join(files.select("path"), "path", "left_anti").select("path", F.lit("source").alias("kind"), F.lit("missing").alias("reason"), F.lit("").alias("missing_columns"))
    if missing == "error":
        some = [r["path"] for r in gone.limit(20).collect()]
        if some:
            raise FileNotFoundError(f"missing sources: {some}")
    return files.join(manifest.select("path").distinct(), "path", "left_semi"), gone


def read(spark: SparkSession, files: DataFrame, root: str, schema: str, kind: str = "slice", pattern: str = "*.{csv,csv.gz}") -> DataFrame:
    """The rows of CSV files (path below root), with file_row from 1, and rows of `reason` for files that are missing,
    empty (empty_file), without a header (no_columns), not readable (read_error) or without some columns
    (missing_columns). Numbers that are none are null; other columns are left out. Split with rows() and audit()."""
    wanted = StructType.fromDDL(schema)
    numbers = {f.name for f in wanted if isinstance(f.dataType, NumericType)}
    head = ["path", "kind", "reason", "missing_columns", "file_row"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def report(path: str, reason: str, missing: str = "") -> pd.DataFrame:
            return pd.DataFrame([[path, kind, reason, missing, None]], columns=head).reindex(columns=[*head, *wanted.names]).astype(object)

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content is None or not len(content):
                    yield report(path, "missing" if content is None else "empty_file")
                    continue
                try:
                    text = gzip.decompress(content) if path.endswith(".gz") else content
                    df = pd.read_csv(io.BytesIO(text), dtype=str, keep_default_na=False)
                except pd.errors.EmptyDataError:
                    yield report(path, "no_columns")
                    continue
                except Exception as e:  # whatever is wrong with a file is a row of the audit
                    yield report(path, f"read_error:{type(e).__name__}")
                    continue
                missing = [c for c in wanted.names if c not in df.columns]
                if missing:
                    yield report(path, "missing_columns", ";".join(missing))
                    continue
                df = df[wanted.names].astype(object)
                df = df.where(df.map(lambda v: v.strip() != ""), None)
                df.insert(0, "file_row", range(1, len(df) + 1))
                yield df.assign(path=path, kind=kind, reason=None, missing_columns="")[[*head, *wanted.names]].astype(object)

    content = _held(spark, root, pattern).select(_plain(F.col("path")).alias("file"), "content")
    names = listing(spark, root, pattern).join(content, "file", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))
    met = files.select("path").distinct().join(names, "path", "left")
    text = ", ".join(["path string, kind string, reason string, missing_columns string, file_row long", *(f"`{c}` string" for c in wanted.names)])
    out = met.mapInPandas(parse, text)
    return out.select(*head, *(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) if f.name in numbers else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def rows(read: DataFrame) -> DataFrame:
    return read.where("reason IS NULL").drop("kind", "reason", "missing_columns")


def audit(read: DataFrame) -> DataFrame:
    return read.where("reason IS NOT NULL").select("path", "kind", "reason", "missing_columns")


def has_column(spark: SparkSession, file: str, column: str = "label") -> bool:
    """Whether a CSV file has a column, from its header alone."""
    return column in spark.read.option("header", "true").csv(file).columns
