"""Shapes of components whose form is known."""

import numpy as np
import pytest

from linecrest.operators import components as K

NAMES = [c.split()[0] for c in K.SHAPES.split(", ")]


def shapes(*parts):
    out = K.shapes_of(np.vstack(parts).astype(float), np.array([len(p) for p in parts]))
    return [dict(zip(NAMES, map(float, r), strict=True)) for r in out]


def test_shapes_of_known_forms():
    s = np.arange(-20, 21.0)
    wire = np.column_stack([s + 30, np.full(41, 4.0), 10 + s**2 / 50])
    post = np.column_stack([np.full(12, 7.0), np.full(12, 3.0), np.arange(12.0)])
    slab = np.array([(x, y, 2) for x in range(5) for y in range(5)])
    dot = np.array([(1, 2, 3)])
    w, p, b, d = shapes(wire, post, slab, dot)
    assert w["principal_verticality"] < 0.05 and w["linearity"] > 0.9
    assert w["sag_estimate_ft"] == pytest.approx(4.0) and w["quadratic_rmse_ft"] == pytest.approx(0, abs=1e-9)
    assert w["xy_path_length_ft"] == w["xy_endpoint_distance_ft"] == 20.0 and w["xy_tortuosity"] == 1.0
    assert (w["endpoint1_x"], w["endpoint2_x"]) == (10, 50)
    assert p["principal_verticality"] == 1.0 and p["linearity"] == 1.0 and p["radius_p90_ft"] == 0 and p["sag_estimate_ft"] == 0
    assert b["planarity"] == pytest.approx(1.0) and b["scattering"] == 0
    assert d["principal_dz"] == 1.0 and d["xy_tortuosity"] == 1.0 and d["endpoint1_z"] == d["endpoint2_z"] == 3.0


def test_shapes_do_not_depend_on_company():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, (30, 8, 6), (n, 3)), axis=0) for n in (2, 3, 9, 40, 17)]
    together, alone = shapes(*parts), [shapes(p)[0] for p in parts]
    for a, b in zip(together, alone, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    for a, p in zip(together, parts, strict=True):
        d = np.array([a["principal_dx"], a["principal_dy"], a["principal_dz"]])
        c = p - np.median(p, axis=0)
        assert ((c @ d) ** 2).sum() == pytest.approx(np.linalg.svd(c)[1][0] ** 2)
        r = np.linalg.norm(c - np.outer(c @ d, d), axis=1) * 0.5
        assert (a["radius_p50_ft"], a["radius_p90_ft"]) == pytest.approx((np.quantile(r, 0.5), np.quantile(r, 0.9)))


def test_vertices_are_medians_of_bins(spark):
    rows = [("g", 1, 5, x, 3, x // 4) for x in range(9)] + [("g", 1, 9, 2, y, 1) for y in range(3)] + [("g", 2, 5, 1, 1, 1)]
    df = spark.createDataFrame(rows, "group_id string, slice_seq long, component long, x int, y int, z int")
    got = sorted(tuple(r) for r in K.line_vertices(df, 2.0).collect())
    assert [r[4] for r in got if r[:3] == ("g", 1, 5)] == [0.5, 2.5, 4.5, 6.5, 8.0] and [r[3] for r in got if r[2] == 5 and r[1] == 1] == [0, 1, 2, 3, 4]
    assert [r[4:] for r in got if r[2] == 9] == [(2.0, 0.5, 1.0), (2.0, 2.0, 1.0)] and [r[4:] for r in got if r[1] == 2] == [(1.0, 1.0, 1.0)]
