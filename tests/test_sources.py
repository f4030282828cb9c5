"""Readers and writers: round trips, and each way a file can be wrong."""

import gzip
import os

import pytest

from linecrest.operators import slices as S
from linecrest.sources import artifacts as A
from linecrest.sources import files as FI

HEADER = "x,y,z,label\n"


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / "in" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(gzip.compress(text.encode()) if path.endswith(".gz") else text.encode())

    put("A/Session1_slice3/f.csv", HEADER + "1,2,3,0\n4,x,6,1\n")
    put("A/session1_slice10/f.csv.gz", "label,z,y,x\n2,9,8,7\n")
    put("A/session2_slice1/a.csv", HEADER)
    put("A/session2_slice1/b.csv", "x,y\n1,2\n")
    put("A/other/f.csv", "")
    put("A/session3_slice1/f.csv", "\n\n")
    return str(tmp_path / "in")


def test_session_is_found_by_number(spark, tree):
    files = FI.listing(spark, tree)
    assert [(r["slice_seq"], r["path"]) for r in FI.session(files, "A/session1").collect()] == [(3, "A/Session1_slice3/f.csv"), (10, "A/session1_slice10/f.csv.gz")]
    with pytest.raises(ValueError, match="more than one"):
        FI.session(files, "A/session2")
    with pytest.raises(FileNotFoundError):
        FI.session(files, "A/session9")
    with pytest.raises(ValueError, match="geography"):
        FI.session(files, "A/B/session1")
    assert [r["path"] for r in S.unmatched(files).collect()] == ["A/other/f.csv"]


def test_files_are_read_by_their_header_and_audited(spark, tree):
    files = FI.listing(spark, tree).select("path").union(spark.createDataFrame([("A/gone.csv",)], "path string"))
    read = FI.read(spark, files, tree, "x double, y double, z double, label int")
    rows = sorted((r["path"], r["file_row"], r["x"], r["y"], r["z"], r["label"]) for r in FI.rows(read).collect())
    assert rows == [("A/Session1_slice3/f.csv", 1, 1.0, 2.0, 3.0, 0), ("A/Session1_slice3/f.csv", 2, 4.0, None, 6.0, 1), ("A/session1_slice10/f.csv.gz", 1, 7.0, 8.0, 9.0, 2)]
    assert sorted(tuple(r)[0::2] + (r["missing_columns"],) for r in FI.audit(read).collect()) == [("A/gone.csv", "missing", ""), ("A/other/f.csv", "empty_file", ""), ("A/session2_slice1/b.csv", "missing_columns", "z;label"), ("A/session3_slice1/f.csv", "no_columns", "")]
    assert FI.has_column(spark, f"{tree}/A/Session1_slice3/f.csv") and not FI.has_column(spark, f"{tree}/A/session2_slice1/b.csv")


def test_manifest_names_files(spark, tree):
    m = spark.createDataFrame([("A/Session1_slice3/f.csv",), ("A/gone.csv",)], "path string")
    kept, gone = FI.from_manifest(FI.listing(spark, tree), m)
    assert [r["path"] for r in kept.collect()] == ["A/Session1_slice3/f.csv"] and [r["path"] for r in gone.collect()] == ["A/gone.csv"]
    with pytest.raises(FileNotFoundError):
        FI.from_manifest(FI.listing(spark, tree), m, "error")


def test_scores_come_back_and_replace_their_slices_only(spark, tmp_path):
    path, schema = str(tmp_path / "scores"), "group_id string, slice_seq long, x int, y int, z int, pole_score double, line_score double"
    A.write_scores(spark.createDataFrame([("g", 1, 1, 1, 1, 0.5, 0.5), ("g", 2, 2, 2, 2, 0.1, 0.9)], schema), path)
    A.write_scores(spark.createDataFrame([("g", 2, 3, 3, 3, 0.2, 0.8)], schema), path)
    got = sorted((r["slice_seq"], r["x"], r["line_score"], r["label"], r["objectness"]) for r in A.read_scores(spark, path).collect())
    assert got == [(1, 1, 0.5, 0, 0.0), (2, 3, 0.8, 0, 0.0)]
    A.write_scores(spark.createDataFrame([("g", 3, 3, 3, 3, None, 0.8)], schema), path)
    with pytest.raises(Exception, match="differ in number"):
        A.read_scores(spark, path).collect()
    with pytest.raises(ValueError, match="pole_score"):
        A.write_scores(spark.createDataFrame([("g", 1, 1)], "group_id string, slice_seq long, x int"), path)


def test_manifest_is_replaced_by_key_and_never_lost(spark, tmp_path):
    path, schema = str(tmp_path / "m"), "group_id string, slice_seq long, state string"
    row = lambda *r: spark.createDataFrame([r], schema)
    A.write_manifest(row("g", 2, "a"), path, schema)
    A.write_manifest(row("g", 1, "b"), path, schema)
    assert [tuple(r) for r in A.write_manifest(row("g", 2, "c"), path, schema).collect()] == [("g", 1, "b"), ("g", 2, "c")]
    os.rename(path, path + ".next")
    assert A.read_manifest(spark, path, schema).count() == 2
    A.write_manifest(row("h", 1, "d"), path, schema)
    assert A.read_manifest(spark, path, schema).count() == 3
    os.remove(f"{path}/_SUCCESS")
    with pytest.raises(OSError, match="not replaced"):
        A.write_manifest(row("g", 3, "e"), path, schema)
    done = spark.createDataFrame([("g", 1, "ok"), ("g", 7, "ok")], schema)
    assert A.repaired(row("g", 1, "b"), done).count() == 2


def test_tables_without_rows_keep_their_header(spark, tmp_path):
    path = str(tmp_path / "t")
    A.write_table(spark.createDataFrame([], "a int, b string"), path)
    assert A.read_table(spark, path, "b string, c double").columns == ["b", "c"]
    assert A.read_table(spark, str(tmp_path / "none"), "a int").count() == 0
    A.write_table(spark.createDataFrame([(1, "u")], "a int, b string"), path)
    assert [tuple(r) for r in A.read_table(spark, path, "b string, c double, a int").collect()] == [("u", None, 1)]


def test_settings_fall_back_and_refuse_forbidden_features(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"pole": {"threshold": 0.4}, "features": ["height", "center_x"]}')
    assert A.settings(spark, str(p), {"pole.threshold": 0.5, "line.threshold": 0.6}) == {"pole.threshold": 0.4, "line.threshold": 0.6}
    with pytest.raises(ValueError, match="center_x"):
        A.settings(spark, str(p), {}, "features", ("center_x",))
