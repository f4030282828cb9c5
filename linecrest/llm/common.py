"""What the corpus operators share: stage tables in the cluster's shared folder and vectorised word hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is set, a session in one process, as in tests, gets
    a temporary one that its context keeps (the setting itself is fixed once a session has started); on a cluster a
    folder of one machine would lose rows, so there the setting is asked for."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="linecrest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage: a lost executor costs no more
    than the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linecrest-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


#: Tables staged within each open scratch().
_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What is staged within is deleted at the end, but for tables that hold() names: for steps whose result is staged."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(*_scratch.pop())


def hold(table: DataFrame) -> DataFrame:
    """A table staged within scratch() that stays."""
    for tables in _scratch:
        tables[:] = [t for t in tables if t is not table]
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_staged_at", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows of texts that Python code turns into results at once.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of SLICE_ROWS rows, so that what is made of long texts does not stand in memory for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def with_columns(batch: pa.RecordBatch, kept: Iterable[str], **columns) -> pa.RecordBatch:
    """The kept columns of a batch as they are, so that no value passes through another type, and new ones."""
    arrays = [batch.column(c) for c in kept] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, [*kept, *columns])


def repeat_rows(batch: pa.RecordBatch, kept: Iterable[str], times: np.ndarray, **columns) -> pa.RecordBatch:
    """The kept columns with each row so many times, and new columns."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), times))
    arrays = [batch.column(c).take(at) for c in kept] + [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, [*kept, *columns])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- words as 64-bit hashes ------------------------------------------------------------------------------------------

#: The white space that ends a word: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so its powers have inverses modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        with np.errstate(over="ignore"):
            _powers, _inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)]), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, first byte and end byte (in UTF-8) of each word of the whole text. Words are runs of bytes other than
    space and 0x09 to 0x0D; lower: A-Z count as a-z. Null and empty texts have no words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        byte = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * powers[: len(data)], dtype=np.uint64)])
        hashes = mix((total[ends] - total[starts]) * inverses[starts])
    return hashes, starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for i in range(1, k):
            out = out * np.uint64(0xD1342543DE82EF95) + words[i : i + n]
    return mix(out)


# --- tables that may be small -----------------------------------------------------------------------------------------

#: Rows of a few numbers up to which a stored table is broadcast.
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if a count shows that it has at most BROADCAST_ROWS; else
    it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


# --- connected components ---------------------------------------------------------------------------------------------


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that links reach, for every node of a link but the roots; a staged table. links:
    a and b. Large stars and small stars in turn (Kiveris et al. 2014), each round a table of the shared folder; a star's
    centre is never gathered in one task, since the least neighbour is a partial aggregate and joins split what is uneven."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")  # large star
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")  # small star
        discard(large)
        now = _mark(edges)
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found._staged_at = edges._staged_at
    return found
