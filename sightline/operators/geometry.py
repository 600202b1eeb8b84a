"""Contours, rays, polygons and runs as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a cell in which runs meet.
RUN_CELL = 256


def next_point(contour: DataFrame, key: str = "ear") -> DataFrame:
    """Adds nx, ny: the next point of the closed contour."""
    w = Window.partitionBy(key).orderBy("i")
    first = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return contour.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(first)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(first))})


def polygon_areas(contour: DataFrame, key: str = "ear") -> DataFrame:
    """key, area of the closed contour (shoelace), perimeter."""
    p = next_point(contour, key)
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    step = F.sqrt(F.pow(F.col("nx") - F.col("x"), 2) + F.pow(F.col("ny") - F.col("y"), 2))
    return p.groupBy(key).agg((F.abs(F.sum(cross)) / 2).alias("area"), F.sum(step).alias("perimeter"))


def arc_lengths(contour: DataFrame, key: str = "ear") -> DataFrame:
    """Adds s: length of the open line from the first point."""
    w = Window.partitionBy(key).orderBy("i")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    return contour.withColumn("_d", step).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def resample_polyline(contour: DataFrame, n: int, key: str = "ear") -> DataFrame:
    """key, k, x, y: n points at even arc length.  Each sample falls into one segment: a join on the key with a range.

    Outlines of no length have no such points; `zero_length` reports them."""
    w = Window.partitionBy(key).orderBy("i")
    seg = arc_lengths(contour, key).withColumns({"s2": F.lead("s").over(w), "x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "total": F.max("s").over(Window.partitionBy(key))})
    seg = seg.filter(F.col("total") > 0)
    # the sample numbers of a segment follow from its ends, so each segment makes its own samples
    low = F.ceil(F.col("s") / F.col("total") * (n - 1) - 1e-9)
    high = F.when(F.col("s2") >= F.col("total") - 1e-12, F.lit(n - 1)).otherwise(F.ceil(F.col("s2") / F.col("total") * (n - 1) - 1e-9) - 1)
    made = seg.filter(F.col("s2") > F.col("s")).filter(high >= low).withColumn("k", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    t = (F.col("k") * F.col("total") / (n - 1) - F.col("s")) / (F.col("s2") - F.col("s"))
    return made.select(key, "k", (F.col("x") + (F.col("x2") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("y2") - F.col("y")) * t).alias("y"))


def zero_length(contour: DataFrame, key: str = "ear") -> DataFrame:
    """key, reason: outlines without length, which cannot be resampled: one point, or points that are all the same."""
    box = contour.groupBy(key).agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return box.filter("w = 0 AND h = 0").select(key, F.lit("an outline of no length cannot be resampled").alias("reason"))


def densify(contour: DataFrame, spacing: float, key: str = "ear") -> DataFrame:
    """Points added until neighbours are at most `spacing` apart; the given points stay."""
    w = Window.partitionBy(key).orderBy("i")
    seg = contour.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    length = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    parts = F.coalesce(F.greatest(F.lit(1), F.ceil(length / spacing).cast("int")), F.lit(1))
    cut = seg.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = F.col("part") / F.col("parts")
    mid = lambda a, b: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * t, F.col(a))
    return cut.select(key, "i", "part", mid("x", "x2").alias("x"), mid("y", "y2").alias("y"))


def turning_angles(contour: DataFrame, span: int, n: int, key: str = "ear") -> DataFrame:
    """key, i, angle: the turn between the steps to the points `span` before and after, wrapping (n points in each contour)."""
    points = F.map_from_entries(F.collect_list(F.struct("i", F.struct("x", "y"))))
    whole = contour.groupBy(key).agg(points.alias("m"))
    get = lambda i: F.element_at("m", i)
    rows = whole.select(key, "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    p = rows.select(key, "i", get(F.col("i").cast("int")).alias("p"), get(F.pmod(F.col("i") - span, F.lit(n)).cast("int")).alias("a"), get(F.pmod(F.col("i") + span, F.lit(n)).cast("int")).alias("b"))
    ux, uy, vx, vy = F.col("p.x") - F.col("a.x"), F.col("p.y") - F.col("a.y"), F.col("b.x") - F.col("p.x"), F.col("b.y") - F.col("p.y")
    cos = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    return p.select(key, "i", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).alias("angle"))


def hull_depths(contour: DataFrame, directions: int = 32, key: str = "ear") -> DataFrame:
    """key, i, depth: distance inward from the support lines of `directions` sampled directions; it tends to the depth below the
    convex hull as these grow."""

    w = Window.partitionBy(key)
    depths = []
    for k in range(directions):
        angle = k * (2.0 * math.pi / directions)
        along = F.col("x") * math.cos(angle) + F.col("y") * math.sin(angle)
        depths.append(F.max(along).over(w) - along)
    # all directions share one window: a contour's points are shuffled once and not multiplied
    return contour.select(key, "i", F.least(*depths).alias("depth"))


def ray_crossings(rays: DataFrame, contour: DataFrame, key: str = "ear") -> DataFrame:
    """key, ray, i, t, u: where rays (ox, oy, dx, dy) meet the segments of the closed contour; parallel ones do not."""
    seg = next_point(contour, key).select(key, "i", "x", "y", (F.col("nx") - F.col("x")).alias("ex"), (F.col("ny") - F.col("y")).alias("ey"))
    both = rays.join(seg, key)
    den = F.col("dx") * F.col("ey") - F.col("dy") * F.col("ex")
    wx, wy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    t = F.when(F.abs(den) > 1e-12, (wx * F.col("ey") - wy * F.col("ex")) / den)
    u = F.when(F.abs(den) > 1e-12, (wx * F.col("dy") - wy * F.col("dx")) / den)
    return both.withColumns({"t": t, "u": u}).filter(F.col("t").isNotNull())


def furthest_crossing(rays: DataFrame, contour: DataFrame, key: str = "ear", tolerance: float = 1e-9) -> DataFrame:
    """key, ray, t: the furthest forward crossing of each ray, null without one."""
    hit = ray_crossings(rays, contour, key).filter((F.col("t") >= 0) & F.col("u").between(-tolerance, 1 + tolerance)).groupBy(key, "ray").agg(F.max("t").alias("t"))
    return rays.select(key, "ray").join(hit, [key, "ray"], "left")


def nearest_crossing(rays: DataFrame, contour: DataFrame, key: str = "ear") -> DataFrame:
    """key, ray, t: the signed crossing nearest to each ray's origin, 0 without one."""
    hit = ray_crossings(rays, contour, key).filter(F.col("u").between(0, 1)).groupBy(key, "ray").agg(F.min_by("t", F.struct(F.abs("t"), "t")).alias("t"))
    return rays.select(key, "ray").join(hit, [key, "ray"], "left").select(key, "ray", F.coalesce("t", F.lit(0.0)).alias("t"))


def snap(points: DataFrame, contour: DataFrame, key: str = "ear") -> DataFrame:
    """key, point, i: the contour vertex nearest to each point (px, py), the first on ties."""
    d = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
    return points.join(contour, key).groupBy(key, "point").agg(F.min_by("i", F.struct(F.round(d, 12), "i")).alias("i"))


def flap_path(contour: DataFrame, start: int, end: int, n: int, key: str = "ear") -> DataFrame:
    """key, forward_area, backward_area, direction: the path between two vertices of a closed contour that encloses the larger area with its chord;
    forward on ties."""
    span = (end - start) % n
    place = F.pmod(F.col("i") - start, F.lit(n))
    forward = contour.filter(place <= span).withColumn("i", place)
    backward = contour.filter((place >= span) | (place == 0)).withColumn("i", F.when(place == 0, F.lit(n)).otherwise(place))
    f = polygon_areas(forward, key).select(key, F.col("area").alias("forward_area"))
    b = polygon_areas(backward, key).select(key, F.col("area").alias("backward_area"))
    return f.join(b, key).withColumn("direction", F.when(F.round("backward_area", 12) > F.round("forward_area", 12), "backward").otherwise("forward"))


def disk_pairs(contour: DataFrame, radius: float, key: str = "ear") -> DataFrame:
    """key, i, j, d2: pairs of points of a contour at most radius apart (i = j too), by grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    near = F.array(*[F.lit(o) for o in (-1, 0, 1)])
    left = contour.select(key, F.col("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    left = left.withColumn("ax", F.explode(near)).withColumn("ay", F.explode(near)).select(key, "i", "x1", "y1", (F.col("cx") + F.col("ax")).alias("cx"), (F.col("cy") + F.col("ay")).alias("cy"))
    right = contour.select(key, F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    d2 = F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2)
    return left.join(right, [key, "cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select(key, "i", "j", "d2")


def run_pieces(runs: DataFrame, cell: int = RUN_CELL) -> DataFrame:
    """runs (start, length) cut at multiples of `cell`, with the number of the cell as _cell and the pieces' start and end (behind the last pixel) as _s and _e.  Empty runs go."""
    end = F.col("start") + F.col("length")
    cut = runs.filter(F.col("length") > 0).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((end - 1) / cell))))
    return cut.withColumns({"_s": F.greatest("start", F.col("_cell") * cell), "_e": F.least(end, (F.col("_cell") + 1) * cell)})


def run_overlaps(runs: DataFrame, mask: str = "mask", group: str = "photo", cell: int = RUN_CELL) -> DataFrame:
    """a, b, pixels: pixels shared by the masks of one photo, from runs (start, length) that do not overlap within a mask.

    Runs are cut into cells of positions and meet in those alone, so that the work follows the overlaps and not the pairs of runs of a photo."""
    pieces = run_pieces(runs, cell)
    left = pieces.select(group, "_cell", F.col(mask).alias("a"), F.col("_s").alias("s1"), F.col("_e").alias("e1"))
    right = pieces.select(group, "_cell", F.col(mask).alias("b"), F.col("_s").alias("s2"), F.col("_e").alias("e2"))
    both = left.join(right, [group, "_cell"]).filter((F.col("a") < F.col("b")) & (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    return both.groupBy("a", "b").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("pixels"))


def shares_on(features: DataFrame, bodies: DataFrame, least: float = 0.25, mask: str = "mask", group: str = "photo", cell: int = RUN_CELL) -> DataFrame:
    """mask, body, share: features of which more than `least` lies on a body of their photo, the body with the largest share (the smallest name on ties).

    features and bodies: runs (mask, photo, start, length)."""
    size = features.groupBy(group, mask).agg(F.sum("length").alias("_n"))
    a = run_pieces(features, cell).select(group, "_cell", mask, F.col("_s").alias("s1"), F.col("_e").alias("e1"))
    b = run_pieces(bodies, cell).select(group, "_cell", F.col(mask).alias("body"), F.col("_s").alias("s2"), F.col("_e").alias("e2"))
    both = a.join(b, [group, "_cell"]).filter((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    shared = both.groupBy(group, mask, "body").agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("_p")).join(size, [group, mask])
    best = shared.withColumn("share", F.col("_p") / F.col("_n")).groupBy(group, mask).agg(F.min_by(F.struct("body", "share"), F.struct(-F.col("_p"), "body")).alias("b"))
    return best.select(mask, "b.body", "b.share").filter(F.col("share") > least)


def mask_bounds(runs: DataFrame, height: str = "h", mask: str = "mask") -> DataFrame:
    """mask, pixels, top, bottom, left, right of column-major runs; a run that spans columns reaches from top to bottom."""
    first, last = F.col("start"), F.col("start") + F.col("length") - 1
    h = F.col(height)
    c1, c2 = F.floor(first / h), F.floor(last / h)
    return runs.filter(F.col("length") > 0).groupBy(mask).agg(
        F.sum("length").alias("pixels"), F.min(F.when(c1 != c2, F.lit(0)).otherwise(first % h)).cast("long").alias("top"), F.max(F.when(c1 != c2, h - 1).otherwise(last % h)).cast("long").alias("bottom"),
        F.min(c1).cast("long").alias("left"), F.max(c2).cast("long").alias("right"),
    )
