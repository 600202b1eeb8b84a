"""Queries over series functions and geometry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sightline.functions import scalar as sc
from sightline.functions import series as se
from sightline.operators import depths as dp
from sightline.operators import geometry as ge
from sightline.operators import workflow as wf
from sightline.operators.shared import exact_quantiles
from sightline.operators.training import anchors
from sightline.operators.workflow import landmark_rays
from sightline.plans import inputs
from sightline.plans.registry import query, table
from sightline.plans.retrieval_queries import rounded

E, C, L = inputs.EARS_SQL, inputs.CONTOUR_SQL, inputs.LISTS_SQL


def long(df, key="ear", arr="v", name="v"):
    """One row for each element, rounded."""
    return df.select(key, F.posexplode(arr).alias("i", "x")).select(key, "i", F.round("x", 6).alias(name))


def between_sql(values: str, position: str, n: int) -> str:
    """n values of each list at fractional positions, without a join of the series with itself."""
    return f"""SELECT ear, i, round(w[floor(p)::INT + 1] + (w[least(floor(p)::INT + 1, 23) + 1] - w[floor(p)::INT + 1]) * (p - floor(p)), 6) AS v
FROM (SELECT ear, {values} AS w FROM lists), (SELECT i, {position} AS p FROM (SELECT unnest(range({n}))::INT AS i))"""


def at_sql(source: str, position: str, n: int, prefix: str = "") -> str:
    return f"""SELECT a.ear, s.i, a.d + (b.d - a.d) * (s.p - floor(s.p)) AS v FROM (SELECT i, {position} AS p FROM (SELECT unnest(range({n}))::INT AS i)) s
JOIN {source} a ON a.i = floor(s.p)::INT JOIN {source} b ON b.ear = a.ear AND b.i = least(floor(s.p)::INT + 1, 23)"""


@query(f"WITH {L} {between_sql('v', 'i * 23 / 39.0::DOUBLE', 40)}")
def a1_resample(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.resample(F.col("depths"), 40).alias("v")))


@query(f"WITH {L} {between_sql('v', 'i * 23 / 16.0::DOUBLE', 16)}")
def a2_resample_span(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.resample_span(F.col("depths"), 16).alias("v")))


@query(f"WITH {L} {between_sql('list_transform(v, lambda d: sqrt(greatest(d - 5, 0)))', 'i * 23 / 39.0::DOUBLE', 40)}")
def a3_depth_channel(spark, sf):
    d = F.transform("depths", lambda x: x - 5)
    return long(inputs.ears(spark, sf).select("ear", se.depth_channel(d, 40).alias("v")))


@query(
    f"""WITH {E}, g AS (SELECT ear, i, CASE WHEN i = 1 THEN lead(d) OVER w - d WHEN i = 22 THEN d - lag(d) OVER w WHEN i BETWEEN 2 AND 21 THEN (lead(d) OVER w - lag(d) OVER w) / 2 ELSE 0.0 END AS g FROM depths WINDOW w AS (PARTITION BY ear ORDER BY i))
SELECT ear, i, round(sign(g) * sqrt(abs(g)), 6) AS v FROM g"""
)
def a4_gradient_channel(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.gradient_channel(F.col("depths"), F.lit(0.0), F.lit(180.0), 24).alias("v")))


@query(
    f"""WITH {E}, s AS (SELECT i, (i / 23.0::DOUBLE - 0.5) / 0.8 * 23 + 11.5 AS p FROM (SELECT unnest(range(24))::INT AS i))
SELECT k.ear, s.i, round(coalesce(a.d + (b.d - a.d) * (p - floor(p)), 0.0), 6) AS v FROM keys k CROSS JOIN s
LEFT JOIN depths a ON a.ear = k.ear AND a.i = floor(p)::INT AND p BETWEEN 0 AND 23 LEFT JOIN depths b ON b.ear = k.ear AND b.i = least(floor(p)::INT + 1, 23)"""
)
def a5_stretch(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.stretch(F.col("depths"), 0.8).alias("v")))


@query(f"WITH {L} SELECT ear, i, round(coalesce(v[i + 4], 0.0), 6) AS v FROM lists, (SELECT unnest(range(24))::INT AS i)")
def a6_shift(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.shift(F.col("depths"), -3).alias("v")))


@query(
    f"""WITH {E}, wt AS (SELECT i, exp(-0.5 * pow((i * 180.0::DOUBLE / 23 - 120) / 35, 2)) AS w FROM (SELECT unnest(range(24))::INT AS i)),
s AS (SELECT a.ear, b.ear AS other, sum(w * a.d) + sum(w * b.d) AS total, sum(w * abs(a.d - b.d)) AS apart FROM depths a JOIN depths b ON a.user_id = b.user_id AND a.side = b.side AND a.week < b.week AND a.i = b.i JOIN wt ON wt.i = a.i GROUP BY 1, 2)
SELECT ear, other, round(CASE WHEN total + apart > 0 THEN (total - apart) / (total + apart) ELSE 0 END, 6) + 0.0 AS similarity FROM s"""
)
def a7_weighted_jaccard(spark, sf):
    e = inputs.ears(spark, sf)
    o = e.select("user_id", "side", F.col("week").alias("later"), F.col("ear").alias("other"), F.col("depths").alias("b"))
    both = e.join(o, ["user_id", "side"]).filter("week < later")
    return rounded(both.select("ear", "other", se.weighted_jaccard(F.col("depths"), F.col("b"), se.angle_weights(24)).alias("similarity")))


@query(
    f"""WITH {E}, k AS (SELECT o, exp(-0.5 * pow(o / 1.0::DOUBLE, 2)) AS w FROM (SELECT unnest(range(-4, 5))::INT AS o)), n AS (SELECT o, w / (SELECT sum(w) FROM k) AS w FROM k),
t AS (SELECT i, w, CASE WHEN i + o < 0 THEN -1 - (i + o) WHEN i + o > 23 THEN 47 - (i + o) ELSE i + o END AS j FROM (SELECT unnest(range(24))::INT AS i) CROSS JOIN n)
SELECT ear, t.i, round(sum(w * d), 6) AS v FROM t JOIN depths d ON d.i = j GROUP BY 1, 2"""
)
def a12_smooth(spark, sf):
    return long(inputs.ears(spark, sf).select("ear", se.smooth(F.col("depths"), 1.0).alias("v")))


@query(
    f"""WITH {E}, n AS (SELECT ear, i, d, d > greatest(lag(d, 1) OVER w, lag(d, 2) OVER w, lag(d, 3) OVER w) AND d > greatest(lead(d, 1) OVER w, lead(d, 2) OVER w, lead(d, 3) OVER w) AND i BETWEEN 3 AND 20 AS hi FROM depths WINDOW w AS (PARTITION BY ear ORDER BY i))
SELECT ear, i FROM n WHERE hi"""
)
def a13_local_maxima(spark, sf):
    from sightline.operators.descriptors import extrema

    e = inputs.ears(spark, sf).select("ear", F.posexplode("depths").alias("i", "v"))
    return extrema(e, "ear", 3).filter("kind = 'max'").select("ear", "i")


@query(
    f"""WITH {E} SELECT ear, round(max(d), 6) AS top, (min(i) FILTER (WHERE d = m)) * 180.0::DOUBLE / 23 AS angle, round(sum(greatest(d, 0)), 6) AS mass,
  CASE WHEN sqrt(sum(d * d) FILTER (WHERE i BETWEEN 2 AND 21) / 20) >= 3 THEN round(sqrt(sum(d * d) FILTER (WHERE i BETWEEN 2 AND 21) / 20), 6) END AS rms
FROM (SELECT *, max(d) OVER (PARTITION BY ear) AS m FROM depths) GROUP BY 1"""
)
def a23_profile_summary(spark, sf):
    d = F.col("depths")
    _, top, angle = se.peak(d)
    out = inputs.ears(spark, sf).select("ear", top.alias("top"), angle.alias("angle"), se.mass(d).alias("mass"), se.trimmed_rms(d, 2, 3.0).alias("rms"))
    return out.select("ear", F.round("top", 6).alias("top"), "angle", F.round("mass", 6).alias("mass"), F.round("rms", 6).alias("rms"))


@query(
    f"""WITH {E}, p AS (SELECT a.ear, b.ear AS other, a.i, least(a.d, b.d) AS m FROM depths a JOIN depths b ON a.user_id = b.user_id AND a.side = b.side AND a.week + 1 = b.week AND a.i = b.i)
SELECT ear, other, round(sum(m), 6) AS shared FROM p GROUP BY 1, 2"""
)
def a21_overlap(spark, sf):
    e = inputs.ears(spark, sf)
    o = e.select("user_id", "side", (F.col("week") - 1).alias("week"), F.col("ear").alias("other"), F.col("depths").alias("b"))
    m = F.aggregate(se.overlap(F.col("depths"), F.col("b")), F.lit(0.0), lambda s, x: s + x)
    return rounded(e.join(o, ["user_id", "side", "week"]).select("ear", "other", m.alias("shared")))


@query("SELECT vec_id, round_even(unnest(list_filter(embedding::DOUBLE[], lambda x, i: (i - 1) % 4 = 0)), 4) + 0.0 AS v FROM embeddings")
def a22_stride(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.explode(se.stride(F.col("embedding").cast("array<double>"), 16)).alias("v")).withColumn("v", F.col("v") + 0.0)


@query(
    f"""WITH {E}, l AS (SELECT unnest(range(-3, 4))::INT AS lag), p AS (
  SELECT a.ear, b.ear AS other, lag, round(corr(a.d, b.d), 9) AS c FROM depths a JOIN l ON true JOIN depths b ON a.user_id = b.user_id AND a.side = b.side AND a.week < b.week AND b.i = (a.i + lag + 24) % 24 WHERE a.i BETWEEN 2 AND 21 GROUP BY 1, 2, 3)
SELECT ear, other, round(max(c), 6) AS corr, arg_max(lag, (c, -lag)) AS lag FROM p WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1, 2"""
)
def a25_best_lag_correlation(spark, sf):
    from sightline.operators.descriptors import best_lag

    e = inputs.ears(spark, sf)
    o = e.select("user_id", "side", F.col("week").alias("later"), F.col("ear").alias("other"), F.col("depths").alias("b"))
    both = e.join(o, ["user_id", "side"]).filter("week < later").select("ear", "other", F.col("depths").alias("a"), "b")
    return best_lag(both, ["ear", "other"], 3, 2).select("ear", "other", F.round("corr", 6).alias("corr"), "lag")


@query("SELECT event_type, round(1.4826 * median(abs(value - m)), 6) AS band FROM (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def a27_robust_band(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    off = e.join(exact_quantiles(e, ["event_type"], "value", {"m": 0.5}), "event_type").select("event_type", F.abs(F.col("value") - F.col("m")).alias("off"))
    return rounded(exact_quantiles(off, ["event_type"], "off", {"m": 0.5}).select("event_type", (1.4826 * F.col("m")).alias("band")))


_NEXT = "nx AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM contour WINDOW w AS (PARTITION BY ear ORDER BY i))"


@query(f"WITH {C}, {_NEXT} SELECT ear, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 6) AS perimeter FROM nx GROUP BY 1")
def a18_polygon_areas(spark, sf):
    return rounded(ge.polygon_areas(inputs.contour(spark, sf)))


@query(f"WITH {C}, s AS (SELECT ear, i, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0.0) AS d FROM contour WINDOW w AS (PARTITION BY ear ORDER BY i)) SELECT ear, i::INT AS i, round(sum(d) OVER (PARTITION BY ear ORDER BY i), 6) AS s FROM s")
def w6_arc_lengths(spark, sf):
    return rounded(ge.arc_lengths(inputs.contour(spark, sf)).select("ear", "i", "s"))


@query(
    f"""WITH {C}, d AS (SELECT ear, i, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0.0) AS d FROM contour WINDOW w AS (PARTITION BY ear ORDER BY i)),
s AS (SELECT ear, i, x, y, sum(d) OVER (PARTITION BY ear ORDER BY i) AS s FROM d), t AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, max(s) OVER (PARTITION BY ear) AS total FROM s WINDOW w AS (PARTITION BY ear ORDER BY i)),
k AS (SELECT unnest(range(21))::INT AS k)
SELECT ear, k, round(x + (x2 - x) * (k * total / 20 - s) / (s2 - s), 5) AS x, round(y + (y2 - y) * (k * total / 20 - s) / (s2 - s), 5) AS y FROM t JOIN k ON CASE WHEN k = 20 THEN s2 >= total - 1e-12 ELSE k * total / 20 >= s - 1e-9 * total / 20 AND k * total / 20 < s2 - 1e-9 * total / 20 END WHERE s2 > s"""
)
def a10_resample_polyline(spark, sf):
    return rounded(ge.resample_polyline(inputs.contour(spark, sf), 21), 5)


@query(
    f"""WITH {C}, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM contour WINDOW w AS (PARTITION BY ear ORDER BY i)),
n AS (SELECT *, coalesce(greatest(1, ceil(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) / 0.06)::INT), 1) AS parts FROM s)
SELECT ear, i::INT AS i, part, round(coalesce(x + (x2 - x) * part / parts, x), 6) + 0.0 AS x, round(coalesce(y + (y2 - y) * part / parts, y), 6) + 0.0 AS y FROM n JOIN (SELECT unnest(range(40))::INT AS part) p ON part < parts"""
)
def a11_densify(spark, sf):
    return rounded(ge.densify(inputs.contour(spark, sf), 0.06))


@query(
    f"""WITH {C}, p AS (SELECT b.ear, b.i, b.x - a.x AS ux, b.y - a.y AS uy, c.x - b.x AS vx, c.y - b.y AS vy FROM contour b JOIN contour a ON a.ear = b.ear AND a.i = (b.i + 61) % 64 JOIN contour c ON c.ear = b.ear AND c.i = (b.i + 3) % 64)
SELECT ear, i::INT AS i, round(acos(greatest(-1.0, least(1.0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))))), 5) AS angle FROM p"""
)
def a29_turning_angles(spark, sf):
    return rounded(ge.turning_angles(inputs.contour(spark, sf), 3, 64), 5)


@query(
    f"""WITH {C}, k AS (SELECT k, cos(k * 2 * pi() / 32) AS c, sin(k * 2 * pi() / 32) AS s FROM (SELECT unnest(range(32)) AS k)), h AS (SELECT ear, k, c, s, max(x * c + y * s) AS h FROM contour, k GROUP BY 1, 2, 3, 4)
SELECT p.ear, p.i::INT AS i, round(min(h - (x * c + y * s)), 6) AS depth FROM contour p JOIN h ON h.ear = p.ear GROUP BY 1, 2"""
)
def a28_hull_depths(spark, sf):
    return rounded(ge.hull_depths(inputs.contour(spark, sf)))


_RAYS = "rays AS (SELECT DISTINCT ear, r AS ray, 0.05 AS ox, 0.02 AS oy, cos(r * 0.7) AS dx, sin(r * 0.7) AS dy FROM contour, (SELECT unnest(range(8))::INT AS r))"
_HIT = f"""{_NEXT}, hit AS (SELECT r.ear, ray, ((x - ox) * (ny - y) - (y - oy) * (nx - x)) / den AS t, ((x - ox) * dy - (y - oy) * dx) / den AS u FROM (
  SELECT r.*, n.x, n.y, n.nx, n.ny, dx * (n.ny - n.y) - dy * (n.nx - n.x) AS den FROM rays r JOIN nx n ON n.ear = r.ear) r WHERE abs(den) > 1e-12)"""


def rays(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    r = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ear"), k.alias("ray"))
    return r.withColumns({"ox": F.lit(0.05), "oy": F.lit(0.02), "dx": F.cos(F.col("ray") * 0.7), "dy": F.sin(F.col("ray") * 0.7)})


@query(f"WITH {C}, {_RAYS}, {_HIT}, f AS (SELECT ear, ray, max(t) AS t FROM hit WHERE t >= 0 AND u BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY 1, 2) SELECT r.ear, r.ray, round(t, 6) AS t FROM rays r LEFT JOIN f ON f.ear = r.ear AND f.ray = r.ray")
def j11_furthest_crossing(spark, sf):
    return rounded(ge.furthest_crossing(rays(spark, sf), inputs.contour(spark, sf)))


@query(f"WITH {C}, {_RAYS}, {_HIT}, f AS (SELECT ear, ray, arg_min(t, (abs(t), t)) AS t FROM hit WHERE u BETWEEN 0 AND 1 GROUP BY 1, 2) SELECT r.ear, r.ray, round(coalesce(t, 0.0), 6) AS t FROM rays r LEFT JOIN f ON f.ear = r.ear AND f.ray = r.ray")
def j12_nearest_crossing(spark, sf):
    return rounded(ge.nearest_crossing(rays(spark, sf), inputs.contour(spark, sf)))


#: A reference polygon of every fourth point, a little larger and shifted; half of them turn the other way.
_POLYGON = """poly AS (SELECT ear, CASE WHEN ear % 2 = 0 THEN i // 4 ELSE 15 - i // 4 END AS i, 1.2 * x + 0.01 AS x, 1.2 * y AS y FROM contour WHERE i % 4 = 0),
pn AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) - x AS ex, coalesce(lead(y) OVER w, first(y) OVER w) - y AS ey FROM poly WINDOW w AS (PARTITION BY ear ORDER BY i)),
turn AS (SELECT ear, CASE WHEN sum(x * (y + ey) - (x + ex) * y) < 0 THEN -1.0 ELSE 1.0 END AS winding FROM pn GROUP BY 1),
met AS (SELECT r.*, i, ex, ey, ((x - ox) * ey - (y - oy) * ex) / (dx * ey - dy * ex) AS t, ((x - ox) * dy - (y - oy) * dx) / (dx * ey - dy * ex) AS u
  FROM rays r JOIN pn USING (ear) WHERE abs(dx * ey - dy * ex) > 1e-12),
best AS (SELECT ear, ray, arg_max((t, ex, ey), (t, -i)) AS h FROM met WHERE t >= 0 AND u BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY 1, 2),
hits AS (SELECT r.ear, r.ray, h[1] AS t, ox + h[1] * dx AS cx, oy + h[1] * dy AS cy, -winding * h[3] / sqrt(h[2] * h[2] + h[3] * h[3]) AS nx, winding * h[2] / sqrt(h[2] * h[2] + h[3] * h[3]) AS ny
  FROM rays r LEFT JOIN best b ON b.ear = r.ear AND b.ray = r.ray JOIN turn ON turn.ear = r.ear)"""


def polygons(spark, sf):
    i = F.floor(F.col("i") / 4).cast("int")
    return inputs.contour(spark, sf).filter("i % 4 = 0").select("ear", F.when(F.col("ear") % 2 == 0, i).otherwise(15 - i).alias("i"), (F.col("x") * 1.2 + 0.01).alias("x"), (F.col("y") * 1.2).alias("y"))


@query(f"WITH {C}, {_RAYS}, {_POLYGON} SELECT ear, ray, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('t', 'cx', 'cy', 'nx', 'ny'))} FROM hits")
def j11_crossing_normals(spark, sf):
    hits = dp.ray_hits(rays(spark, sf), polygons(spark, sf), ["ear"])
    return hits.select("ear", "ray", *[(F.round(c, 6) + 0.0).alias(c) for c in ("t", "cx", "cy", "nx", "ny")])


#: Rays every five degrees from the middle of two points of the outline.
_LANDMARKS = """ends AS (SELECT ear, max(CASE WHEN i = 60 THEN x END) AS ux, max(CASE WHEN i = 60 THEN y END) AS uy, max(CASE WHEN i = 28 THEN x END) AS lx, max(CASE WHEN i = 28 THEN y END) AS ly FROM contour GROUP BY 1),
base AS (SELECT ear, CASE WHEN ear % 2 = 0 THEN 1.0 ELSE -1.0 END AS f, (ux + lx) / 2 AS ox, (uy + ly) / 2 AS oy, ux - (ux + lx) / 2 AS vx, uy - (uy + ly) / 2 AS vy FROM ends),
unit AS (SELECT ear, f, ox, oy, vx / sqrt(vx * vx + vy * vy) AS vx, vy / sqrt(vx * vx + vy * vy) AS vy FROM base),
rays AS (SELECT ear, r AS ray, ox, oy, cos(radians(5.0 * (r + 2))) * vx - f * sin(radians(5.0 * (r + 2))) * vy AS dx, cos(radians(5.0 * (r + 2))) * vy + f * sin(radians(5.0 * (r + 2))) * vx AS dy
  FROM unit, (SELECT unnest(range(33))::INT AS r))"""


@query(
    f"""WITH {C}, {_LANDMARKS}, {_POLYGON},
line AS (SELECT *, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey FROM contour WINDOW w AS (PARTITION BY ear ORDER BY i)),
cross_ AS (SELECT h.ear, h.ray, l.i, ((l.x - cx) * l.ey - (l.y - cy) * l.ex) / (h.nx * l.ey - h.ny * l.ex) AS t, ((l.x - cx) * h.ny - (l.y - cy) * h.nx) / (h.nx * l.ey - h.ny * l.ex) AS u
  FROM hits h JOIN line l ON l.ear = h.ear WHERE h.t IS NOT NULL AND l.ex IS NOT NULL AND abs(h.nx * l.ey - h.ny * l.ex) > 1e-12),
near AS (SELECT ear, ray, arg_min(t, (abs(t), i)) AS t FROM cross_ WHERE u BETWEEN 0 AND 1 GROUP BY 1, 2),
area AS (SELECT ear, sqrt(abs(sum(x * (y + ey) - (x + ex) * y)) / pi()) AS r FROM pn GROUP BY 1),
depth AS (SELECT h.ear, h.ray, h.t IS NOT NULL AS crossed, coalesce(n.t, 0.0) / r AS d FROM hits h JOIN area a ON a.ear = h.ear LEFT JOIN near n ON n.ear = h.ear AND n.ray = h.ray),
taps AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o)),
smooth AS (SELECT c.ear, c.ray, sum(w * d.d) AS v FROM depth c CROSS JOIN taps JOIN depth d ON d.ear = c.ear AND d.ray = CASE WHEN (c.ray + o + 66) % 66 < 33 THEN (c.ray + o + 66) % 66 ELSE 65 - (c.ray + o + 66) % 66 END GROUP BY 1, 2)
SELECT d.ear, d.ray + 2 AS bin, round(CASE WHEN crossed THEN v ELSE 0.0 END, 6) + 0.0 AS depth FROM depth d JOIN smooth s ON s.ear = d.ear AND s.ray = d.ray"""
)
def j13_depth_profiles(spark, sf):
    c = inputs.contour(spark, sf)
    at = lambda i, v: F.max(F.when(F.col("i") == i, F.col(v)))
    ends = c.groupBy("ear").agg(at(60, "x").alias("ux"), at(60, "y").alias("uy"), at(28, "x").alias("lx"), at(28, "y").alias("ly"))
    marks = ends.withColumn("side", F.when(F.col("ear") % 2 == 0, "left").otherwise("right"))
    p = polygons(spark, sf)
    radius = ge.polygon_areas(p).select("ear", F.sqrt(2 * F.col("area") / F.pi()).alias("r"))
    found = dp.line_distances(dp.ray_hits(landmark_rays(marks, [5.0 * (r + 2) for r in range(33)]), p, ["ear"]), c, ["ear"]).join(radius, "ear")
    whole = dp.profiles_of(found.withColumn("distance", F.col("distance") / F.col("r")), ["ear"], 37, 2, 1.0)
    return whole.select("ear", F.posexplode("depths").alias("bin", "d")).filter(F.col("bin").between(2, 34)).select("ear", "bin", (F.round("d", 6) + 0.0).alias("depth"))


@query(f"WITH {C}, q AS (SELECT DISTINCT ear, p AS point, p / 4.0::DOUBLE - 0.5 AS px, 0.3 AS py FROM contour, (SELECT unnest(range(4))::INT AS p)) SELECT q.ear, point, arg_min(i, (round(pow(px - x, 2) + pow(py - y, 2), 12), i))::INT AS i FROM q JOIN contour c ON c.ear = q.ear GROUP BY 1, 2")
def j14_snapped_points(spark, sf):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    q = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ear"), k.alias("point")).withColumns({"px": F.col("point") / 4.0 - 0.5, "py": F.lit(0.3)})
    return ge.snap(q, inputs.contour(spark, sf))


@query(
    f"""WITH {C}, f AS (SELECT ear, i - 10 AS k, x, y FROM contour WHERE i BETWEEN 10 AND 40), b AS (SELECT ear, CASE WHEN i = 10 THEN 64 ELSE (i + 54) % 64 END AS k, x, y FROM contour WHERE NOT i BETWEEN 11 AND 39),
fn AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM f WINDOW w AS (PARTITION BY ear ORDER BY k)),
bn AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM b WINDOW w AS (PARTITION BY ear ORDER BY k)),
fa AS (SELECT ear, abs(sum(x * ny - nx * y)) / 2 AS a FROM fn GROUP BY 1), ba AS (SELECT ear, abs(sum(x * ny - nx * y)) / 2 AS a FROM bn GROUP BY 1)
SELECT fa.ear, round(fa.a, 6) AS forward_area, round(ba.a, 6) AS backward_area, CASE WHEN round(ba.a, 12) > round(fa.a, 12) THEN 'backward' ELSE 'forward' END AS direction FROM fa JOIN ba ON fa.ear = ba.ear"""
)
def a19_flap_paths(spark, sf):
    return rounded(ge.flap_path(inputs.contour(spark, sf), 10, 40, 64))


@query(f"WITH {C} SELECT a.ear, a.i::INT AS i, count(*) AS near FROM contour a JOIN contour b ON a.ear = b.ear AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.09 GROUP BY 1, 2")
def j8_disk_neighbours(spark, sf):
    return ge.disk_pairs(inputs.contour(spark, sf), 0.3).groupBy("ear", "i").agg(F.count("*").alias("near"))


_RUNS = inputs.CROPS_SQL + ", runs AS (SELECT photo AS mask, sighting AS photo, (part * 7 % 900) AS start, qty::BIGINT AS length, 100 AS h FROM photos)"


def runs(spark, sf):
    p = inputs.photos(spark, sf)
    return p.select(F.col("photo").alias("mask"), F.col("sighting").alias("photo"), (F.col("part") * 7 % 900).alias("start"), F.col("qty").cast("long").alias("length"), F.lit(100).alias("h"))


@query(f"WITH {_RUNS} SELECT a.mask AS a, b.mask AS b, sum(least(a.start + a.length, b.start + b.length) - greatest(a.start, b.start))::BIGINT AS pixels FROM runs a JOIN runs b ON a.photo = b.photo AND a.mask < b.mask AND a.start < b.start + b.length AND b.start < a.start + a.length GROUP BY 1, 2")
def a31_mask_overlaps(spark, sf):
    return ge.run_overlaps(runs(spark, sf))


@query(
    f"""WITH {_RUNS}, f AS (SELECT * FROM runs WHERE mask NOT LIKE '%-1'), b AS (SELECT * FROM runs WHERE mask LIKE '%-1'),
o AS (SELECT f.mask, b.mask AS body, f.length, greatest(0, least(f.start + f.length, b.start + b.length) - greatest(f.start, b.start)) AS p FROM f JOIN b ON b.photo = f.photo)
SELECT mask, body, round(p / length::DOUBLE, 6) AS share FROM o WHERE p / length::DOUBLE > 0.25"""
)
def j15_runs_on_body(spark, sf):
    r = runs(spark, sf)
    return rounded(ge.shares_on(r.filter("mask NOT LIKE '%-1'"), r.filter("mask LIKE '%-1'"), 0.25))


@query(
    f"""WITH {_RUNS} SELECT mask, sum(length)::BIGINT AS pixels, min(CASE WHEN start // 100 <> (start + length - 1) // 100 THEN 0 ELSE start % 100 END)::BIGINT AS top, max(CASE WHEN start // 100 <> (start + length - 1) // 100 THEN 99 ELSE (start + length - 1) % 100 END)::BIGINT AS bottom,
  min(start // 100)::BIGINT AS "left", max((start + length - 1) // 100)::BIGINT AS "right" FROM runs WHERE length > 0 GROUP BY 1"""
)
def a31_mask_bounds(spark, sf):
    return ge.mask_bounds(runs(spark, sf))


_ANCHORS = """anch AS (SELECT ear, arg_min(i, (CASE WHEN ear % 2 = 1 THEN round(y - x, 9) ELSE round(x + y, 9) END, i))::INT AS upper, arg_min(i, (CASE WHEN ear % 2 = 1 THEN -round(x + y, 9) ELSE -round(y - x, 9) END, i))::INT AS lower FROM contour GROUP BY 1),
points AS (SELECT a.ear, CASE WHEN a.ear % 2 = 1 THEN 'right' ELSE 'left' END AS side, u.x AS ux, u.y AS uy, l.x AS lx, l.y AS ly FROM anch a JOIN contour u ON u.ear = a.ear AND u.i = a.upper JOIN contour l ON l.ear = a.ear AND l.i = a.lower)"""


def sided(spark, sf):
    """The outlines with a declared side."""
    return inputs.contour(spark, sf).withColumn("side", F.when(F.col("ear") % 2 == 1, "right").otherwise("left"))


def anchor_points(spark, sf):
    """ear, side, ux, uy, lx, ly."""
    c = sided(spark, sf)
    at = lambda name, x, y: c.select("ear", F.col("i").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    found = anchors(c).join(at("upper", "ux", "uy"), ["ear", "upper"]).join(at("lower", "lx", "ly"), ["ear", "lower"])
    return found.select("ear", F.when(F.col("ear") % 2 == 1, "right").otherwise("left").alias("side"), "ux", "uy", "lx", "ly")


@query(f"WITH {C}, {_ANCHORS} SELECT ear, upper, lower FROM anch")
def d3_contour_anchors(spark, sf):
    return anchors(sided(spark, sf))


@query(
    f"""WITH {C}, {_ANCHORS}, {_NEXT}, b AS (SELECT ear, abs(sum(x * ny - nx * y)) / 2 AS area, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM nx GROUP BY 1)
SELECT b.ear, round(area / ((x2 - x1) * (y2 - y1)), 6) AS fill, round(abs((ux + lx) / 2 - (x1 + x2) / 2) / (x2 - x1), 6) AS root FROM b JOIN points p ON p.ear = b.ear"""
)
def p15_geometry_measures(spark, sf):
    c = inputs.contour(spark, sf)
    box = c.groupBy("ear").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    m = ge.polygon_areas(c).join(box, "ear").join(anchor_points(spark, sf), "ear")
    corners = [F.col(x) for x in ("x1", "y1", "x2", "y2")]
    return rounded(m.select("ear", sc.mask_fill(F.col("area"), *corners).alias("fill"), sc.root_offset(F.col("ux"), F.col("lx"), *corners).alias("root")))


@query(
    f"""WITH {C}, {_ANCHORS}, v AS (SELECT ear, CASE WHEN side = 'left' THEN 1 ELSE -1 END AS f, (ux + lx) / 2 AS ox, (uy + ly) / 2 AS oy, (ux - lx) / 2 AS vx, (uy - ly) / 2 AS vy FROM points), k AS (SELECT unnest(range(13))::INT AS ray)
SELECT ear, ray, round(ox, 6) AS ox, round(oy, 6) AS oy, round((cos(radians(ray * 15)) * vx - f * sin(radians(ray * 15)) * vy) / sqrt(vx * vx + vy * vy), 6) + 0.0 AS dx, round((cos(radians(ray * 15)) * vy + f * sin(radians(ray * 15)) * vx) / sqrt(vx * vx + vy * vy), 6) + 0.0 AS dy FROM v, k WHERE vx <> 0 OR vy <> 0"""
)
def p33_landmark_rays(spark, sf):
    return rounded(wf.landmark_rays(anchor_points(spark, sf), [15.0 * i for i in range(13)]))


@query(
    f"""WITH {C} SELECT ear, i::INT AS i, round(((CASE WHEN ear % 2 = 1 THEN x0 + x1 - 1 - x ELSE x END) - x0 + 0.5) * 300 / (x1 - x0) - 0.5, 6) AS x, round((y - y0 + 0.5) * 300 / (x1 - x0) - 0.5, 6) AS y FROM contour, (SELECT -2.0::DOUBLE AS x0, -2.5::DOUBLE AS y0, 2.0::DOUBLE AS x1)"""
)
def a17_mirrored_outlines(spark, sf):
    crops = sided(spark, sf).select("ear", "side").distinct().withColumns({"x0": F.lit(-2.0), "y0": F.lit(-2.5), "x1": F.lit(2.0)})
    return rounded(wf.mirrored(inputs.contour(spark, sf), crops, 300))


@query()
def a26_gated_peaks(spark, sf):
    e = inputs.ears(spark, sf)
    peaks = wf.gated_peaks(F.col("depths"), 20.0)
    return rounded(e.select("ear", F.explode(peaks).alias("p")).select("ear", ((F.col("p.i") + 0.5) / 24).alias("x"), F.col("p.depth").alias("depth")))


@query(f"WITH {C}, {_NEXT}, a AS (SELECT ear, abs(sum(x * ny - nx * y)) / 2 AS area, max(x) - min(x) AS w, avg(x) AS mx, min(x) AS x0 FROM nx GROUP BY 1) SELECT ear, round(sqrt(2 * area / pi()), 6) AS radius, CASE WHEN mx < x0 + w / 2 THEN 'left' ELSE 'right' END AS side FROM a")
def p31_side_and_radius(spark, sf):
    c = inputs.contour(spark, sf)
    box = c.groupBy("ear").agg(F.avg("x").alias("mx"), F.min("x").alias("x0"), (F.max("x") - F.min("x")).alias("w"))
    out = ge.polygon_areas(c).join(box, "ear")
    return out.select("ear", F.round(F.sqrt(2 * F.col("area") / math.pi), 6).alias("radius"), F.when(F.col("mx") < F.col("x0") + F.col("w") / 2, "left").otherwise("right").alias("side"))
