"""Queries over scalar functions, filters and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import scalar as sc
from sightline.operators import checks
from sightline.plans import inputs
from sightline.plans.registry import query, table
from sightline.plans.retrieval_queries import rounded

B = inputs.BOXES_SQL


def sides():
    return [F.col(c) for c in ("x1", "y1", "x2", "y2")]


@query(f"WITH {B} SELECT photo, x1 - (x2 - x1) / 2 AS a, y1 - (y2 - y1) / 2 AS b, x1 + (x2 - x1) / 2 AS c, y1 + (y2 - y1) / 2 AS d FROM boxes")
def p1_centre_to_corners(spark, sf):
    b, corner = inputs.boxes(spark, sf), sides()
    c = sc.corners(corner[0], corner[1], corner[2] - corner[0], corner[3] - corner[1])
    return b.select("photo", *[x.alias(n) for x, n in zip(c, "abcd")])


@query(
    f"""WITH {B}, c AS (SELECT photo, x1 AS ox1, x2 AS ox2, y1 AS oy1, y2 AS oy2, floor(greatest(x1, 0.0))::INT AS x1, floor(greatest(y1, 0.0))::INT AS y1, ceil(least(x2, 100.0))::INT AS x2, ceil(least(y2, 80.0))::INT AS y2 FROM boxes)
SELECT photo, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1 AND ox2 > ox1 AND oy2 > oy1"""
)
def p2_clipped_boxes(spark, sf):
    return inputs.boxes(spark, sf).select("photo", sc.clip_box(*sides(), 100, 80).alias("box")).filter(F.col("box").isNotNull()).select("photo", "box.*")


@query(
    f"""WITH {B} SELECT photo, round(x1 - (x2 - x1) * 0.15, 6) AS px1, round(y2 + (y2 - y1) * 0.15, 6) AS py2, x1 - trunc((x2 - x1) * 0.1)::INT AS wx1, y2 + trunc((y2 - y1) * 0.1)::INT AS wy2 FROM boxes"""
)
def p3_padded_boxes(spark, sf):
    p, w = sc.pad_box(*sides(), 0.15), sc.pad_box_whole(*sides(), 0.1)
    return rounded(inputs.boxes(spark, sf).select("photo", p[0].alias("px1"), p[3].alias("py2"), w[0].alias("wx1"), w[3].alias("wy2")))


_IOU = """a AS (SELECT a.photo AS a, b.photo AS b, a.sighting, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
  greatest(0.0, a.x2 - a.x1) * greatest(0.0, a.y2 - a.y1) AS aa, greatest(0.0, b.x2 - b.x1) * greatest(0.0, b.y2 - b.y1) AS ab
  FROM boxes a JOIN boxes b ON a.sighting = b.sighting AND a.line < b.line)"""


@query(f"WITH {B}, {_IOU} SELECT a, b, round(aa, 6) AS area, round(inter, 6) AS inter, round(CASE WHEN aa + ab - inter > 0 THEN inter / (aa + ab - inter) ELSE 0 END, 9) AS iou FROM a")
def p4_box_overlaps(spark, sf):
    b, corner = inputs.boxes(spark, sf), sides()
    left = b.select("sighting", F.col("line").alias("la"), F.col("photo").alias("a"), *[x.alias(f"a{i}") for i, x in enumerate(corner)])
    right = b.select("sighting", F.col("line").alias("lb"), F.col("photo").alias("b"), *[x.alias(f"b{i}") for i, x in enumerate(corner)])
    p, q = [F.col(f"a{i}") for i in range(4)], [F.col(f"b{i}") for i in range(4)]
    both = left.join(right, "sighting").filter("la < lb")
    return rounded(both.select("a", "b", sc.area(*p).alias("area"), sc.intersection(p, q).alias("inter"), sc.iou(p, q).alias("iou")), 9)


@query(f"WITH {B} SELECT photo, x1 + score * 10 AS x1, y1 + line AS y1, x2 + score * 10 AS x2, y2 + line AS y2, [x1 + score * 10, x2 + score * 10] AS kx FROM boxes")
def p5_translated_boxes(spark, sf):
    dx, dy = F.col("score") * 10, F.col("line")
    b, corner = inputs.boxes(spark, sf), sides()
    return b.select("photo", (corner[0] + dx).alias("x1"), (corner[1] + dy).alias("y1"), (corner[2] + dx).alias("x2"), (corner[3] + dy).alias("y2"), F.transform(F.array(corner[0], corner[2]), lambda k: k + dx).alias("kx"))


_CODE = """codes AS (SELECT c_custkey AS id, concat(' ', c_custkey % 10, CASE WHEN c_custkey % 3 = 0 THEN 'B' WHEN c_custkey % 3 = 1 THEN 'C' ELSE '?' END,
  CASE WHEN c_custkey % 6 = 0 THEN '__' ELSE lpad((c_custkey * 7 % 100)::VARCHAR, 2, '0') END, CASE WHEN c_custkey % 9 = 0 THEN '_' ELSE 'T' END,
  substr('01?1101', (1 + c_custkey % 7)::INT, 1), substr('110?1', (1 + c_nationkey % 5)::INT, 1), 'E', c_nationkey,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat('X', c_nationkey % 3, substr('01_', (1 + c_custkey // 7 % 3)::INT, 1), 'S', lpad((c_custkey % 12)::VARCHAR, 3, '0'), '__ ') END) AS code FROM customer),
body AS (SELECT id, regexp_replace(trim(code), '^\\d', '') AS b FROM codes),
slots AS (SELECT *, regexp_extract(b, 'X(.)(.)S(...)(_*)$', 1) AS xl, regexp_extract(b, 'X(.)(.)S(...)(_*)$', 2) AS xr, regexp_extract(b, 'X(.)(.)S(...)(_*)$', 3) AS s3 FROM body),
parsed AS (SELECT id, CASE WHEN b[1] IN ('B', 'C') THEN b[1] END AS sex, CASE WHEN regexp_full_match(b[2:3], '[0-9]{2}') THEN b[2:3]::INT END AS decade,
  CASE WHEN b[4] = 'T' AND regexp_full_match(b[5:6], '[01]{2}') THEN b[5]::INT END AS left_tusk, CASE WHEN b[4] = 'T' AND regexp_full_match(b[5:6], '[01]{2}') THEN b[6]::INT END AS right_tusk,
  regexp_matches(b, 'X(.)(.)S(...)(_*)$') AS has_tail, CASE WHEN xl IN ('0', '1') THEN xl::INT END AS extreme_left, CASE WHEN xr IN ('0', '1') THEN xr::INT END AS extreme_right,
  CASE WHEN s3[1] IN ('0', '1') THEN s3[1]::INT END AS special_left, CASE WHEN s3[2] IN ('0', '1') THEN s3[2]::INT END AS special_mid, CASE WHEN s3[3] IN ('0', '1') THEN s3[3]::INT END AS special_right FROM slots)"""


def codes(spark, sf):
    """id and a packed code made of the customer's columns: unknown, missing and odd parts occur."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda letters, i: F.substring(F.lit(letters), (1 + i).cast("int"), F.lit(1))
    tail = F.concat(F.lit("X"), n % 3, pick("01_", F.expr("(c_custkey div 7) % 3")), F.lit("S"), F.lpad((k % 12).cast("string"), 3, "0"), F.lit("__ "))
    text = F.concat(
        F.lit(" "), k % 10, F.when(k % 3 == 0, "B").when(k % 3 == 1, "C").otherwise("?"), F.when(k % 6 == 0, "__").otherwise(F.lpad((k * 7 % 100).cast("string"), 2, "0")), F.when(k % 9 == 0, "_").otherwise("T"),
        pick("01?1101", k % 7), pick("110?1", n % 5), F.lit("E"), n, F.when(k % 13 == 0, "").otherwise(tail),
    )
    return table(spark, sf, "customer").select(k.alias("id"), text.alias("text"), sc.parse_code(text).alias("code"))


@query(f"WITH {_CODE} SELECT * FROM parsed")
def p6_parsed_codes(spark, sf):
    return codes(spark, sf).select("id", "code.*")


@query(f"WITH {_CODE} SELECT id, (length(b) >= 6 AND b[4] = 'T' AND (b[5] = '0' OR b[6] = '0')) OR xl = '1' OR xr = '1' OR contains(s3, '1') AS explicit FROM slots")
def p7_explicit_features(spark, sf):
    return codes(spark, sf).select("id", sc.explicit_feature(F.col("text")).alias("explicit"))


@query(
    f"""WITH {_CODE}, y AS (SELECT o_custkey AS id, min(date_part('year', o_orderdate))::INT AS year FROM orders GROUP BY 1)
SELECT p.id, year, CASE WHEN decade IS NOT NULL THEN greatest(0, year - (CASE WHEN 2000 + decade <= year THEN 2000 + decade ELSE 1900 + decade END + 5)) END AS age FROM parsed p JOIN y ON y.id = p.id"""
)
def p9_ages(spark, sf):
    years = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(sc.year_of(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))
    return codes(spark, sf).join(years, "id").select("id", "year", sc.age(F.col("code.decade"), F.col("year")).alias("age"))


@query(
    f"""WITH {_CODE}, y AS (SELECT o_custkey AS id, min(date_part('year', o_orderdate))::INT AS year FROM orders GROUP BY 1)
SELECT p.id FROM parsed p LEFT JOIN y ON y.id = p.id WHERE coalesce(sex = 'B', false) AND coalesce(year BETWEEN 1992 AND 1999, false) AND coalesce((left_tusk = 1 AND right_tusk = 1) OR (left_tusk = 0 AND right_tusk = 0), false)
  AND coalesce(special_left = 0 AND special_mid = 0, false)"""
)
def v21_facet_filter(spark, sf):
    from sightline.operators.curation import facet_filter

    years = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(sc.year_of(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))
    joined = codes(spark, sf).join(years, "id", "left").select("id", "code.*", "year")
    left, right = F.col("left_tusk"), F.col("right_tusk")
    tusks = ((left == 1) & (right == 1)) | ((left == 0) & (right == 0))
    keep = facet_filter({"sex": F.col("sex") == "B", "year": F.col("year").between(1992, 1999), "tusks": tusks, "special": (F.col("special_left") == 0) & (F.col("special_mid") == 0), "extreme": None})
    return joined.filter(keep).select("id")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS name, CASE WHEN doc_id % 3 = 0 THEN '2024-01-05' END AS date, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR END AS seq FROM documents"""
)
def p10_parsed_stems(spark, sf):
    d = table(spark, sf, "documents")
    stem = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "source", F.lit("2024-01-05"), "doc_id")).otherwise(F.concat("source", F.lit("-2024")))
    return d.select("doc_id", sc.parse_stem(stem, sc.NAME_DATE_SEQ, ["name", "date", "seq"]).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, concat(source, '-', sha1(coalesce(text, ''))) AS id FROM documents")
def p11_digest_identifiers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", F.sha1(F.coalesce("text", F.lit("")))).alias("id"))


_Q = (
    inputs.QUALITY_SQL
    + """,
parts AS (
  SELECT *, sqrt(least(greatest((fill - 0.52) / (0.66 - 0.52), 0), 1) * least(greatest((root - 0.28) / (0.43 - 0.28), 0), 1)) AS flatness,
    CASE WHEN aspect <= 1.0 OR aspect >= 1.85 THEN 0.0 WHEN aspect < 1.18 THEN (aspect - 1.0) / (1.18 - 1.0) WHEN aspect > 1.45 THEN (1.85 - aspect) / (1.85 - 1.45) ELSE 1.0 END AS shape,
    least(greatest((detail - 3.5) / (5.2 - 3.5), 0), 1) AS sharp, 1 - least(greatest((dark + bright - 0.08) / (0.35 - 0.08), 0), 1) AS exposure FROM measures),
quality AS (
  SELECT *, exp(0.35 * ln(greatest(flatness, 1e-6)) + 0.25 * ln(greatest(shape, 1e-6)) + 0.25 * ln(greatest(sharp, 1e-6)) + 0.15 * ln(greatest(exposure, 1e-6))) AS overall FROM parts)"""
)


def quality(spark, sf):
    from sightline.operators.curation import quality_scores

    return quality_scores(inputs.measures(spark, sf))


@query(f"WITH {_Q} SELECT doc_id, in_reference, round(flatness, 6) AS flatness, round(shape, 6) AS shape, round(sharp, 6) AS sharp, round(exposure, 6) AS exposure, round(overall, 6) AS overall FROM quality")
def c6_quality_scores(spark, sf):
    return rounded(quality(spark, sf).select("doc_id", "in_reference", "flatness", "shape", "sharp", "exposure", "overall"))


@query(
    f"""WITH {_Q}, cuts AS (SELECT unnest(range(12)) / 12.0::DOUBLE AS cut)
SELECT round(cut, 6) AS cut, count(*) FILTER (WHERE overall >= cut) AS passed, round(count(*) FILTER (WHERE overall >= cut) / count(*)::DOUBLE, 6) AS rate,
  round(count(*) FILTER (WHERE overall >= cut AND in_reference = 1) / sum(in_reference)::DOUBLE, 6) AS retained FROM quality, cuts GROUP BY 1"""
)
def g21_threshold_sweep(spark, sf):
    from sightline.operators.curation import threshold_sweep

    return rounded(threshold_sweep(quality(spark, sf), "overall", "in_reference", [i / 12 for i in range(12)]))


@query(
    f"""WITH {_Q} SELECT s AS score, round(quantile_cont(v, 0.05), 6) AS q05, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95
FROM (SELECT 'flatness' AS s, flatness AS v FROM quality UNION ALL SELECT 'sharp', sharp FROM quality UNION ALL SELECT 'overall', overall FROM quality) GROUP BY 1"""
)
def g22_score_quantiles(spark, sf):
    from sightline.operators.curation import score_quantiles

    return rounded(score_quantiles(quality(spark, sf), ["flatness", "sharp", "overall"]))


@query(
    f"""WITH {_Q}, l AS (SELECT 'sharp' AS score, doc_id, sharp AS v FROM quality UNION ALL SELECT 'overall', doc_id, overall FROM quality),
r AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY round(v, 9), doc_id) AS place FROM l) SELECT score, doc_id, place FROM r WHERE place <= 8"""
)
def l6_lowest_scores(spark, sf):
    from sightline.operators.curation import lowest

    return lowest(quality(spark, sf), ["sharp", "overall"], "doc_id", 8)


_IMAGE = "SELECT p_partkey AS id, p_size * 6000.0::DOUBLE AS area, 400 + p_partkey % 17 * 120.0::DOUBLE AS perimeter, p_partkey % 23 * 1.0::DOUBLE AS x1, 3 + p_partkey % 41 * 1.0::DOUBLE AS y1, 250 + p_size * 9.0::DOUBLE AS w, 300 + p_partkey % 300 * 1.0::DOUBLE AS h FROM part"


def shapes(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        k.alias("id"), (size * 6000.0).alias("area"), (400 + k % 17 * 120.0).alias("perimeter"), (k % 23 * 1.0).alias("x1"), (3 + k % 41 * 1.0).alias("y1"), (250 + size * 9.0).alias("w"), (300 + k % 300 * 1.0).alias("h")
    )


@query(
    f"""WITH s AS ({_IMAGE}) SELECT id, CASE WHEN perimeter = 0 THEN 'degenerate' WHEN abs(x1 + w - 1600) < 5 OR abs(y1 + h - 620) < 5 OR x1 < 5 OR y1 < 5 THEN 'edge' WHEN area / (1600 * 620.0::DOUBLE) < 0.025 OR area < 50000 THEN 'area'
  WHEN w / h < 0.5 OR w / h > 1.2 THEN 'aspect' WHEN 4 * pi() * area / (perimeter * perimeter) < 0.4 OR 4 * pi() * area / (perimeter * perimeter) > 0.9 THEN 'circularity' END AS reason FROM s"""
)
def p17_shape_reasons(spark, sf):
    c = [F.col(x) for x in ("x1", "y1")]
    reason = sc.shape_reason(F.col("area"), F.col("perimeter"), *c, c[0] + F.col("w"), c[1] + F.col("h"), F.lit(1600.0), F.lit(620.0))
    return shapes(spark, sf).select("id", reason.alias("reason"))


@query(
    f"""WITH s AS ({_IMAGE}) SELECT id, CASE WHEN area / 4e7::DOUBLE NOT BETWEEN 8e-5 AND 6e-3 THEN 'area' WHEN 1 + id % 19 / 6.0::DOUBLE > 3.2 THEN 'elongated' WHEN 0.7 + id % 13 / 40.0::DOUBLE < 0.8 THEN 'ragged'
  WHEN 0.3 + id % 11 / 20.0::DOUBLE < 0.35 THEN 'noncircular' WHEN NOT (id % 7 >= 6.0 OR id % 25 >= 22.0 OR id % 10 >= 9.0) THEN 'no_contrast' END AS reason FROM s"""
)
def p18_blob_reasons(spark, sf):
    k = F.col("id")
    reason = sc.blob_reason(F.col("area") / 4e7, 1 + k % 19 / 6.0, 0.7 + k % 13 / 40.0, 0.3 + k % 11 / 20.0, k % 7, k % 25, k % 10)
    return shapes(spark, sf).select("id", reason.alias("reason"))


_TIER = "CASE WHEN NOT isfinite(v) THEN 4 WHEN v >= 25 THEN 0 WHEN v >= 10 THEN 1 WHEN v >= 4 THEN 2 WHEN v >= 1 THEN 3 ELSE 4 END"


@query(
    f"""WITH m AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value / 3 END AS v FROM events),
t AS (SELECT event_id, user_id, {_TIER} AS tier FROM m), w AS (SELECT user_id, max(tier) AS worst FROM t GROUP BY 1)
SELECT event_id, ['excellent', 'great', 'good', 'acceptable', 'poor'][tier + 1] AS tier, ['excellent', 'great', 'good', 'acceptable', 'poor'][worst + 1] AS worst FROM t JOIN w ON w.user_id = t.user_id"""
)
def p28_tiers(spark, sf):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).when(F.col("event_id") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 3)
    t = table(spark, sf, "events").select("event_id", "user_id", sc.tier(v, [25, 10, 4, 1]).alias("n"))
    worst = t.groupBy("user_id").agg(F.max("n").alias("w"))
    return t.join(worst, "user_id").select("event_id", sc.tier_name(F.col("n")).alias("tier"), sc.tier_name(F.col("w")).alias("worst"))


_RECORD = """e AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'unresolved' WHEN max(turn) >= 5 THEN 'confirm' END AS decision, CASE WHEN conv_id % 5 = 0 THEN 'failed' WHEN conv_id % 5 = 1 THEN 'analyzing' ELSE 'ready' END AS status,
  count(*) FILTER (WHERE role = 'user') >= 2 AS approved, count(*) >= 4 AS matched FROM conversations GROUP BY 1)"""


@query(
    f"""WITH {_RECORD} SELECT conv_id, CASE WHEN decision = 'unresolved' THEN 'Unresolved' WHEN decision IS NOT NULL THEN 'Decided' WHEN status = 'failed' THEN 'Failed' WHEN status = 'analyzing' THEN 'Analyzing'
    WHEN NOT approved THEN 'Needs evidence review' WHEN NOT matched THEN 'Ready to match' ELSE 'Needs decision' END AS status,
  CASE WHEN decision = 'unresolved' THEN 'Review saved' WHEN decision IS NOT NULL THEN 'View confirmation' WHEN status = 'failed' THEN 'Inspect error' WHEN status = 'analyzing' THEN 'Wait for analysis'
    WHEN NOT approved THEN 'Approve left and right ears' WHEN NOT matched THEN 'Rank known-elephant catalog' ELSE 'Confirm identity decision' END AS action FROM e"""
)
def p21_workflow_status(spark, sf):
    k = F.col("conv_id")
    e = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.when(k % 7 == 0, "unresolved").when(F.max("turn") >= 5, "confirm").alias("decision"), F.when(k % 5 == 0, "failed").when(k % 5 == 1, "analyzing").otherwise("ready").alias("status"),
        (F.count_if(F.col("role") == "user") >= 2).alias("approved"), (F.count("*") >= 4).alias("matched"),
    )
    status, action = sc.workflow_status(*[F.col(c) for c in ("decision", "status", "approved", "matched")])
    return e.select("conv_id", status.alias("status"), action.alias("action"))


@query(
    """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'confirm' WHEN turn % 3 = 0 THEN 'enroll' WHEN turn % 3 = 1 THEN 'unresolved' ELSE 'new_known_elephant' END AS a FROM conversations)
SELECT conv_id, turn, CASE a WHEN 'confirm' THEN 'existing_known_elephant' WHEN 'enroll' THEN 'new_known_elephant' ELSE a END AS action FROM t"""
)
def p22_action_aliases(spark, sf):
    turn = F.col("turn") % 3
    a = F.when(F.col("role") == "user", "confirm").when(turn == 0, "enroll").when(turn == 1, "unresolved").otherwise("new_known_elephant")
    return table(spark, sf, "conversations").select("conv_id", "turn", sc.normal_action(a).alias("action"))


@query(
    f"""WITH {B} SELECT photo, concat('profile:', line, ':', side, ':', photo) AS candidate, concat(photo, '__', side, '__', line) AS crop,
  concat(photo, '__crop_', x1::INT, '_', y1::INT, '_', x2::INT, '_', y2::INT) AS landmark_key,
  concat(photo, '__seg_sam__landmarks_pose__side_', side, '__crop_', x1::INT, '_', y1::INT, '_', x2::INT, '_', y2::INT) AS profile_key
FROM (SELECT photo, line, side, floor(x1) AS x1, floor(y1) AS y1, ceil(x2) AS x2, ceil(y2) AS y2 FROM boxes)"""
)
def p24_p26_identifiers(spark, sf):
    box = [F.floor("x1"), F.floor("y1"), F.ceil("x2"), F.ceil("y2")]
    photo, side = F.col("photo"), F.col("side")
    return inputs.boxes(spark, sf).select(
        "photo", sc.candidate_id(F.col("line"), side, photo).alias("candidate"), sc.crop_id(photo, side, F.col("line")).alias("crop"),
        sc.crop_key(photo, box).alias("landmark_key"), sc.profile_key(photo, F.lit("sam"), F.lit("pose"), side, box).alias("profile_key"),
    )


@query(
    """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(split_part(url, '//', 2)), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'identity') AS name FROM pages"""
)
def p25_safe_components(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.safe_component(F.get(F.split("url", "//"), F.lit(1))).alias("name"))


# ---- integrity checks ------------------------------------------------------------------------------------------------------

_UUID = """u AS (SELECT o_orderkey AS id, md5(o_orderkey::VARCHAR) AS m FROM orders), v AS (SELECT id, CASE WHEN id % 4 = 0 THEN m ELSE concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-4', substr(m, 14, 3), '-a', substr(m, 18, 3), '-', substr(m, 21, 12)) END AS uuid FROM u)"""


@query(f"WITH {_UUID} SELECT id FROM v WHERE NOT regexp_full_match(lower(replace(uuid, '-', '')), '[0-9a-f]{{12}}4[0-9a-f]{{3}}[89ab][0-9a-f]{{15}}')")
def v1_not_uuid4(spark, sf):
    m = F.md5(F.col("o_orderkey").cast("string"))
    part = lambda a, n: F.substring(m, a, n)
    dashed = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, m).otherwise(dashed).alias("uuid"))
    return u.filter(~checks.is_uuid4(F.col("uuid"))).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 14 = 0")
def v2_v4_bad_rows(spark, sf):
    k = F.col("o_orderkey")
    day = F.when(k % 9 == 0, "1996-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    name = F.when(k % 10 == 0, "").otherwise("Ada")
    path = F.when(k % 13 == 0, "/a/b").when(k % 14 == 0, "a/../b").otherwise("a/..b/c")
    good = checks.is_iso_date(day) & checks.is_named(name) & checks.is_inner_path(path)
    return table(spark, sf, "orders").filter(~good).select(k.alias("id"))


@query("SELECT l_orderkey AS sighting, l_linenumber AS line, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v5_duplicate_keys(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sighting"), F.col("l_linenumber").alias("line"), "l_partkey")
    return checks.duplicates(d, ["sighting", "line"], "l_partkey").groupBy("sighting", "line").agg(F.count("*").alias("extra"))


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n_values FROM lineitem GROUP BY 1 HAVING n_values > 1")
def v6_dependency_violations(spark, sf):
    return checks.dependency_violations(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(
    f"""WITH {inputs.PAIRS_SQL} SELECT sighting AS row_no, CASE WHEN sighting % 11 = 0 THEN 'unknown sighting' WHEN sighting % 7 = 0 THEN 'wrong name' WHEN sighting % 5 = 0 THEN 'unknown photo' ELSE 'photo of another sighting' END AS reason
FROM pairs WHERE sighting % 11 = 0 OR sighting % 7 = 0 OR sighting % 5 = 0 OR (sighting % 3 = 0 AND concat(sighting + 1, '-1') IN (SELECT photo FROM photos))
  OR (sighting % 3 = 0 AND concat(sighting + 1, '-1') NOT IN (SELECT photo FROM photos) AND false)"""
)
def v8_pair_violations(spark, sf):
    s = F.col("sighting")
    photos = inputs.photos(spark, sf).select("photo", "sighting", "name")
    other = photos.filter(F.col("photo").endswith("-1")).select((s - 1).alias("sighting"), F.col("photo").alias("next_photo"))
    p = inputs.pairs(spark, sf).join(other, "sighting", "left").select(
        s.alias("row_no"),
        F.when(s % 11 == 0, -s - 1).otherwise(s).alias("sighting"),
        F.when(s % 7 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"),
        F.when(s % 5 == 0, "none").when((s % 3 == 0) & F.col("next_photo").isNotNull(), F.col("next_photo")).otherwise(F.concat_ws("-", "sighting", "left_line")).alias("left_photo"),
        F.concat_ws("-", "sighting", "right_line").alias("right_photo"),
    )
    return checks.pair_violations(p, photos)


@query(f"WITH {inputs.CROPS_SQL} SELECT photo FROM photos WHERE score > 9 OR part % 10 = 0")
def v10_bad_candidates(spark, sf):
    p = inputs.photos(spark, sf)
    ok = checks.valid_candidate(F.col("side"), F.when(F.col("score") > 9, 11).otherwise(F.col("score")), F.lit(0), F.lit(0), F.col("part") % 10, F.lit(5))
    return p.filter(~ok).select("photo")


@query("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def v13_without_references(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return checks.without_references(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query(f"WITH {inputs.EARS_SQL} SELECT ear FROM keys WHERE week = 2 OR user_id % 6 = 0")
def v14_bad_series(spark, sf):
    e = inputs.ears(spark, sf)
    ok = checks.valid_series(F.when(F.col("week") == 2, F.concat("depths", F.array(F.lit(float("nan"))))).otherwise(F.col("depths")), F.lit(0), F.when(F.col("user_id") % 6 == 0, 181).otherwise(180))
    return e.filter(~ok).select("ear")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0 OR list_min(embedding) < -0.3")
def v25_bad_label_lines(spark, sf):
    line = F.concat_ws(" ", F.when(F.col("vec_id") % 4 == 0, -1).otherwise(F.col("label")).cast("string"), F.concat_ws(" ", F.transform("embedding", lambda x: (x.cast("double") + 0.3).cast("string"))))
    low = F.array_min("embedding") < F.lit(-0.3)
    return table(spark, sf, "embeddings").filter(~checks.valid_label_line(line) | low).select("vec_id")


@query(
    """SELECT 'o_custkey' AS key, count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"""
)
def v20_shared_keys(spark, sf):
    o = table(spark, sf, "orders")
    return checks.disjoint(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey", "o_orderkey"])
