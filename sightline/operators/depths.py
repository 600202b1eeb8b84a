"""Depth profiles: how far an outline lies inside a reference polygon, along rays from the middle of two landmarks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import series as se
from sightline.operators import geometry as ge
from sightline.operators.matchers import Extraction
from sightline.operators.workflow import landmark_rays

#: Sectors around an origin into which rays and segments are dealt.
SECTORS = 128


def _segments(points: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """keys, i, x, y, ex, ey (the step to the next point), and of closed outlines winding: 1 where they turn from x to y, else -1."""
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) if closed else F.lead(c).over(w) for c in ("x", "y")}
    seg = points.select(*keys, "i", "x", "y").withColumns({"_x": ends["x"], "_y": ends["y"]})
    if closed:
        seg = seg.withColumn("winding", F.when(F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y")).over(Window.partitionBy(*keys)) < 0, -1.0).otherwise(1.0))
    return seg.filter(F.col("_x").isNotNull()).withColumns({"ex": F.col("_x") - F.col("x"), "ey": F.col("_y") - F.col("y")}).drop("_x", "_y")


def _met(both: DataFrame) -> DataFrame:
    """Adds t and u, places on the ray (ox, oy, dx, dy) and on the segment where the two meet; parallel ones go."""
    den = F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")
    wx, wy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    both = both.filter(F.abs(den) > 1e-12)
    return both.withColumns({"t": (wx * F.col("ey") - wy * F.col("ex")) / den, "u": (wx * F.col("dy") - wy * F.col("dx")) / den})


def ray_hits(rays: DataFrame, polygons: DataFrame, keys: list[str], tolerance: float = 1e-9, sectors: int = SECTORS) -> DataFrame:
    """keys, ray, t, cx, cy, nx, ny: the furthest forward crossing of each ray with the closed polygon of its keys, and the unit normal there that points into the polygon;
    null without a crossing.  Of edges that are equally far the first one counts.

    rays: keys, ray, ox, oy, dx, dy, of which those of one polygon have few origins; polygons: keys, i, x, y.  Around each origin the segments are dealt to the sectors that they reach
    into, so that a ray meets those of its own sector alone.  Segments that come near the origin, or pass it, are dealt to all sectors."""
    width = 2 * math.pi / sectors
    origins = rays.select(*keys, "ox", "oy").distinct()
    seg = _segments(polygons, keys, True).join(origins, keys)
    ax, ay = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    bx, by = ax + F.col("ex"), ay + F.col("ey")
    start = F.atan2(ay, ax)
    turn = F.pmod(F.atan2(by, bx) - start + math.pi, F.lit(2 * math.pi)) - math.pi
    near = F.sqrt(F.least(ax * ax + ay * ay, bx * bx + by * by)) < 0.01 * F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    low, high = start + F.least(F.lit(0.0), turn) - 1e-6, start + F.greatest(F.lit(0.0), turn) + 1e-6
    reached = F.transform(F.sequence(F.floor(low / width), F.floor(high / width)), lambda k: F.pmod(k, F.lit(sectors)).cast("int"))
    everywhere = F.sequence(F.lit(0), F.lit(sectors - 1))
    dealt = seg.withColumn("_s", F.explode(F.when(near | (F.abs(turn) > math.pi - 1e-3), everywhere).otherwise(F.array_distinct(reached))))
    asked = rays.select(*keys, "ray", "ox", "oy", "dx", "dy", F.pmod(F.floor(F.atan2("dy", "dx") / width), F.lit(sectors)).cast("int").alias("_s"))
    met = _met(asked.join(dealt, [*keys, "ox", "oy", "_s"])).filter((F.col("t") >= 0) & F.col("u").between(-tolerance, 1 + tolerance))
    length = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    hit = F.struct(
        "t", (F.col("ox") + F.col("t") * F.col("dx")).alias("cx"), (F.col("oy") + F.col("t") * F.col("dy")).alias("cy"),
        (-F.col("winding") * F.col("ey") / length).alias("nx"), (F.col("winding") * F.col("ex") / length).alias("ny"),
    )
    best = met.groupBy(*keys, "ray").agg(F.max_by(hit, F.struct("t", -F.col("i"))).alias("hit"))
    return rays.select(*keys, "ray").join(best, [*keys, "ray"], "left").select(*keys, "ray", "hit.*")


def line_distances(hits: DataFrame, contours: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ray, distance, crossed of hits (of `ray_hits`): the signed distance along the normal, both ways, to the nearest crossing with the open contour (positive inwards), 0 where
    the line meets none; null where the ray has no hit.  contours: some of the keys, i, x, y."""
    on = [c for c in keys if c in contours.columns]
    lines = hits.filter(F.col("t").isNotNull()).select(*keys, "ray", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("nx").alias("dx"), F.col("ny").alias("dy"))
    met = _met(lines.join(_segments(contours, on, False), on)).filter(F.col("u").between(0, 1))
    near = met.groupBy(*keys, "ray").agg(F.min_by("t", F.struct(F.abs("t"), "i")).alias("_t"))
    found = hits.select(*keys, "ray", F.col("t").isNotNull().alias("crossed")).join(near, [*keys, "ray"], "left")
    return found.select(*keys, "ray", F.when(F.col("crossed"), F.coalesce("_t", F.lit(0.0))).alias("distance"), "crossed")


def profiles_of(depths: DataFrame, keys: list[str], bins: int, first: int, sigma: float) -> DataFrame:
    """keys, depths ARRAY<DOUBLE> of `bins` values: the depths of the rays (keys, ray numbered from 0, distance), smoothed among themselves, from bin `first` on.

    Rays without a crossing count as 0 and are 0 again after the smoothing; bins without a ray are 0."""
    whole = depths.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ray", "distance", "crossed"))).alias("rows"))
    raw = F.transform("rows", lambda r: F.coalesce(r["distance"], F.lit(0.0)))
    smooth = whole.select(*keys, "rows", (se.let(raw, lambda v: se.smooth(v, sigma)) if sigma > 0 else raw).alias("v"))
    kept = F.zip_with("v", "rows", lambda v, r: F.when(r["crossed"], v).otherwise(F.lit(0.0)))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return smooth.select(*keys, F.concat(zeros(F.lit(first)), kept, zeros(bins - first - F.size("rows"))).alias("depths"))


def depth_profiles(polygons: DataFrame, contours: DataFrame, ears: DataFrame, settings: Extraction = Extraction()) -> DataFrame:
    """ear, side, profiles ARRAY<STRUCT<depths, start, end>>: one profile for each scale in the order of settings.scales, depths as shares of the ear's radius.

    polygons: ear, scale (a number from 0), i, x, y, the closed reference outlines; contours: ear, i, x, y, the outlines from anchor to anchor; ears: ear, side, area, and
    the landmarks ux, uy, lx, ly.  Ears whose landmarks are one point, or whose outline has no length, are left out: `checks` and `geometry.zero_length` name them."""
    bins, trim = settings.profile_bins, settings.trim_degrees
    angles = [180.0 * i / (bins - 1) for i in range(bins)]
    measured = [i for i, a in enumerate(angles) if trim < a < 180 - trim]
    rays = landmark_rays(ears, [angles[i] for i in measured]).withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(len(settings.scales) - 1))))
    keys = ["ear", "scale"]
    sampled = ge.resample_polyline(contours, settings.contour_points).withColumnRenamed("k", "i")
    radius = ears.select("ear", "side", F.sqrt(2 * F.col("area") / F.pi()).alias("_r"))
    found = line_distances(ray_hits(rays, polygons, keys), sampled, keys).join(radius, "ear")
    scaled = found.join(sampled.select("ear").distinct(), "ear", "left_semi").select(*keys, "side", "ray", (F.col("distance") / F.col("_r")).alias("distance"), "crossed")
    each = profiles_of(scaled, [*keys, "side"], bins, measured[0] if measured else 0, settings.smoothing_sigma)
    profile = F.struct("depths", F.lit(float(trim)).alias("start"), F.lit(180.0 - trim).alias("end"))
    listed = F.array_sort(F.collect_list(F.struct("scale", profile.alias("p"))))
    return each.groupBy("ear", "side").agg(F.transform(listed, lambda x: x["p"]).alias("profiles"))
