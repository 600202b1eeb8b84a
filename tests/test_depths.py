"""Crossings, normals and depth profiles against plain definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import series as se
from sightline.operators import depths, geometry
from sightline.operators.matchers import Extraction

RAYS = "ear string, ray int, ox double, oy double, dx double, dy double"


def contour(spark, shapes):
    return spark.createDataFrame([(e, i, float(x), float(y)) for e, p in shapes.items() for i, (x, y) in enumerate(p)], "ear string, i int, x double, y double")


def star(seed, n):
    r = np.random.default_rng(seed)
    a = np.sort(r.uniform(0, 2 * np.pi, n))
    d = r.uniform(0.3, 2.0, n)
    return [(float(x), float(y)) for x, y in zip(d * np.cos(a), d * np.sin(a))]


def plain_hit(o, d, p):
    best = None
    turning = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))
    for i, (a, b) in enumerate(zip(p, p[1:] + p[:1])):
        e = (b[0] - a[0], b[1] - a[1])
        den = d[0] * e[1] - d[1] * e[0]
        if abs(den) <= 1e-12:
            continue
        w = (a[0] - o[0], a[1] - o[1])
        t, u = (w[0] * e[1] - w[1] * e[0]) / den, (w[0] * d[1] - w[1] * d[0]) / den
        if t >= 0 and -1e-9 <= u <= 1 + 1e-9 and (best is None or t > best[0]):
            f = (1 if turning >= 0 else -1) / math.hypot(*e)
            best = (t, o[0] + t * d[0], o[1] + t * d[1], -f * e[1], f * e[0])
    return best


def plain_distance(c, n, line):
    found = []
    for i, (a, b) in enumerate(zip(line, line[1:])):
        e = (b[0] - a[0], b[1] - a[1])
        den = n[0] * e[1] - n[1] * e[0]
        if abs(den) > 1e-12:
            w = (a[0] - c[0], a[1] - c[1])
            if 0 <= (w[0] * n[1] - w[1] * n[0]) / den <= 1:
                t = (w[0] * e[1] - w[1] * e[0]) / den
                found.append((abs(t), i, t))
    return min(found)[2] if found else 0.0


@pytest.mark.parametrize("sectors", [1, 7, 128])
def test_hits_equal_all_pairs(spark, sectors):
    shapes = {str(k): star(k, 3 + 5 * k) for k in range(6)}
    shapes["away"] = [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]
    shapes["edge"] = [(0.0, -1.0), (0.0, 1.0), (-2.0, 0.0)]  # the origin is on an edge
    origins = {e: [(0.0, 0.0), (0.1, -0.05)] for e in shapes}
    rays = [(e, 100 * k + r, *o, math.cos(r * 0.37), math.sin(r * 0.37)) for e in shapes for k, o in enumerate(origins[e]) for r in range(17)]
    rays += [(e, 500, 0.0, 0.0, 1.0, 0.0) for e in shapes]
    got = {(r.ear, r.ray): (r.t, r.cx, r.cy, r.nx, r.ny) for r in depths.ray_hits(spark.createDataFrame(rays, RAYS), contour(spark, shapes), ["ear"], sectors=sectors).collect()}
    assert len(got) == len(rays)
    for e, k, ox, oy, dx, dy in rays:
        want = plain_hit((ox, oy), (dx, dy), shapes[e])
        assert (got[e, k][0] is None) if want is None else got[e, k] == pytest.approx(want)
    assert any(v[0] is None for (e, _), v in got.items() if e == "away")


def test_reversed_outlines_have_equal_normals(spark):
    square = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    rays = spark.createDataFrame([(e, r, 0.0, 0.0, math.cos(r + 0.3), math.sin(r + 0.3)) for e in ("a", "b") for r in range(6)], RAYS)
    got = depths.ray_hits(rays, contour(spark, {"a": square, "b": square[::-1]}), ["ear"]).collect()
    one, other = ({r.ray: (r.nx, r.ny) for r in got if r.ear == e} for e in "ab")
    assert one == other and all(math.hypot(*n) == pytest.approx(1) for n in one.values())
    assert all(r.nx * r.cx + r.ny * r.cy < 0 for r in got)


def test_a_ray_without_hit_is_null_then_zero(spark):
    shapes = {"a": [(1, -1), (2, -1), (2, 1), (1, 1)]}
    rays = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.0), ("a", 1, 0.0, 0.0, -1.0, 0.0), ("a", 2, 0.0, 0.0, 0.0, 1.0)], RAYS)
    hits = depths.ray_hits(rays, contour(spark, shapes), ["ear"])
    line = contour(spark, {"a": [(1.5, -1), (1.5, 1)]})
    found = depths.line_distances(hits, line, ["ear"])
    assert {r.ray: r.distance for r in found.collect()} == {0: 0.5, 1: None, 2: None}
    (row,) = depths.profiles_of(found, ["ear"], 6, 1, 1.0).collect()
    assert row.depths[0] == row.depths[2] == row.depths[3] == row.depths[4] == row.depths[5] == 0.0 and 0 < row.depths[1] < 0.5


def test_profiles_equal_the_definition(spark):
    settings = Extraction(contour_points=50, profile_bins=19, trim_degrees=10.0, smoothing_sigma=1.0, scales=(0.5, 1.0))
    ears, polygons, lines = [], [], {}
    for k in range(4):
        side = ("left", "right")[k % 2]
        f = 1 if side == "left" else -1
        a = np.linspace(-1.5, 1.5, 40)
        d = 1 + 0.15 * np.sin(5 * a + k)
        lines[str(k)] = [(float(x), float(y)) for x, y in zip(f * d * np.cos(a), d * np.sin(a))]
        for s, grow in enumerate((1.1, 1.3)):
            shape = [(grow * x, grow * y) for x, y in lines[str(k)][::4]] + [(-0.1 * f, 0.5), (-0.1 * f, -0.5)]
            polygons += [(str(k), s, i, float(x), float(y)) for i, (x, y) in enumerate(shape[:: 1 if k < 2 else -1])]
        ears.append((str(k), side, 1.4 + k / 10, 0.0, -0.9, 0.05, 0.8))
    frame = spark.createDataFrame(ears, "ear string, side string, area double, ux double, uy double, lx double, ly double")
    shapes = spark.createDataFrame(polygons, "ear string, scale int, i int, x double, y double")
    got = {r.ear: r for r in depths.depth_profiles(shapes, contour(spark, lines), frame, settings).collect()}
    for ear, side, area, ux, uy, lx, ly in ears:
        o = ((ux + lx) / 2, (uy + ly) / 2)
        v = np.array([ux - o[0], uy - o[1]]) / math.hypot(ux - o[0], uy - o[1])
        f = 1 if side == "left" else -1
        p = np.array(lines[ear])
        arc = np.append(0, np.cumsum(np.hypot(*np.diff(p, axis=0).T)))
        at = np.linspace(0, arc[-1], 50)
        line = list(zip(np.interp(at, arc, p[:, 0]), np.interp(at, arc, p[:, 1])))
        for s in range(2):
            shape = [(x, y) for e, k, _, x, y in polygons if e == ear and k == s]
            raw, crossed = [], []
            for b in range(2, 17):
                c, n = math.cos(math.radians(10 * b)), math.sin(math.radians(10 * b)) * f
                hit = plain_hit(o, (c * v[0] - n * v[1], c * v[1] + n * v[0]), shape)
                crossed.append(hit is not None)
                raw.append(plain_distance(hit[1:3], hit[3:], line) / math.sqrt(2 * area / math.pi) if hit else 0.0)
            k = [math.exp(-0.5 * o * o) for o in range(-4, 5)]
            ref = lambda j: raw[j % 30] if j % 30 < 15 else raw[29 - j % 30]
            want = [0.0, 0.0, *[sum(w * ref(i + t - 4) for t, w in enumerate(k)) / sum(k) if crossed[i] else 0.0 for i in range(15)], 0.0, 0.0]
            mine = got[ear].profiles[s]
            assert (mine.start, mine.end) == (10.0, 170.0) and mine.depths == pytest.approx(want, abs=1e-9)
            assert any(x > 0.01 for x in want)
        assert got[ear].side == side


def test_outlines_of_no_length_are_reported(spark):
    shapes = contour(spark, {"dot": [(1, 1)], "same": [(2, 2), (2, 2)], "line": [(0, 0), (1, 0)]})
    assert {r.ear for r in geometry.zero_length(shapes).collect()} == {"dot", "same"}
    assert {r.ear for r in geometry.resample_polyline(shapes, 4).collect()} == {"line"}


def test_alignment_refuses_stretches_that_are_not_positive(spark):
    row = spark.range(1).select(*[se.aligned(F.array(*map(F.lit, [0.0, 1.0, 0.0, 0.0])), F.lit(t), F.lit(1)).alias(n) for t, n in ((1.0, "a"), (0.0, "b"), (-1.0, "c"), (float("nan"), "d"))]).first()
    assert row.a == [0.0, 0.0, 1.0, 0.0] and row.b is row.c is row.d is None
