"""Integrity checks: each yields the offending rows; fail_fast raises on the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A table breaks a rule; the message names the first offending row."""


def fail_fast(violations: DataFrame, order: str) -> None:
    first = violations.orderBy(order).limit(1).collect()
    if first:
        raise IntegrityError(f"row {first[0][order]}: {first[0].asDict()}")


def is_uuid4(column: Column) -> Column:
    """Canonical or undashed version-4 UUID."""
    return F.coalesce(F.regexp_like(F.lower(F.replace(column, F.lit("-"), F.lit(""))), F.lit("^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}$")), F.lit(False))


def is_iso_date(column: Column) -> Column:
    return F.regexp_like(F.coalesce(column, F.lit("")), F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_date(column, "yyyy-MM-dd").isNotNull()


def is_named(column: Column) -> Column:
    return F.length(F.coalesce(column, F.lit(""))) > 0


def is_inner_path(column: Column) -> Column:
    """Relative, and never above its root."""
    return ~column.startswith("/") & ~F.array_contains(F.split(column, "/"), "..")


def duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows but the first of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > 1).drop("_n")


def dependency_violations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Values of `left` with more than one value of `right`."""
    return df.groupBy(*left).agg(F.count_distinct(F.struct(*right)).alias("n_values")).filter(F.col("n_values") > 1)


def pair_violations(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """row_no, reason: the first rule that a pair (row_no, name, sighting, left_photo, right_photo) breaks."""
    owner = photos.groupBy("sighting").agg(F.min("name").alias("owner"))
    known = photos.select(F.col("photo"), F.col("sighting").alias("of"))
    joined = pairs.join(owner, "sighting", "left")
    for side in ("left", "right"):
        joined = joined.join(known.select(F.col("photo").alias(f"{side}_photo"), F.col("of").alias(f"{side}_of")), f"{side}_photo", "left")
    reason = (
        F.when(F.col("owner").isNull(), "unknown sighting")
        .when(F.col("owner") != F.col("name"), "wrong name")
        .when(F.col("left_of").isNull() | F.col("right_of").isNull(), "unknown photo")
        .when((F.col("left_of") != F.col("sighting")) | (F.col("right_of") != F.col("sighting")), "photo of another sighting")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("row_no", "reason")


def score_contract(scores: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """missing, unknown, not_finite: how far scores (query, candidate, score) are from one finite score for each query and candidate.

    Nothing is spread out: what is there is counted for each query, and compared with the number of queries and candidates."""
    known = scores.select("query", "candidate", "score").join(queries.select("query").distinct().withColumn("_q", F.lit(True)), "query", "left")
    known = known.join(candidates.select("candidate").distinct().withColumn("_c", F.lit(True)), "candidate", "left")
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    due = F.col("_q").isNotNull() & F.col("_c").isNotNull()
    there = known.groupBy("query", "candidate").agg(F.bool_or(due & F.col("score").isNotNull()).alias("there"), F.count_if(~due).alias("unknown"), F.count_if(~finite).alias("not_finite"))
    total = there.agg(F.count_if("there").alias("n"), F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"), F.coalesce(F.sum("not_finite"), F.lit(0)).alias("not_finite"))
    sizes = [d.select(c).distinct().agg(F.count("*").alias(name)) for d, c, name in ((queries, "query", "nq"), (candidates, "candidate", "nc"))]
    one = total.withColumn("_k", F.lit(1))
    for d in sizes:  # single rows
        one = one.join(d.withColumn("_k", F.lit(1)), "_k")
    return one.select((F.col("nq") * F.col("nc") - F.col("n")).alias("missing"), "unknown", "not_finite")


def without_references(candidates: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    return candidates.join(references, on, "left_anti")


def valid_series(depths: Column, start: Column, end: Column) -> Column:
    finite = F.forall(depths, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(depths) > 0) & finite & (start >= 0) & (start < end) & (end <= 180)


def valid_candidate(side: Column, score: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return side.isin("left", "right", "unresolved") & score.between(1, 10) & (x2 > x1) & (y2 > y1)


def valid_label_line(line: Column) -> Column:
    """A text line `class x y ...`: class at least 0, all coordinates from 0 to 1."""
    parts = F.split(line, " ")
    return (F.get(parts, F.lit(0)).try_cast("int") >= 0) & F.forall(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.try_cast("double").between(0, 1))


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each key column the number of values that both tables hold."""
    counts = [a.select(k).intersect(b.select(k)).agg(F.lit(k).alias("key"), F.count("*").alias("shared")) for k in keys]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def inconsistent_pairs(accepted: DataFrame, crops: DataFrame) -> DataFrame:
    """sighting, reason: the first rule that an accepted pair (sighting, name, left_crop, right_crop) breaks against the inventory crops (crop, sighting,
    side, name): known crops, their sides, one sighting, that of the pair, one name, that of the pair."""
    joined = accepted
    for side in ("left", "right"):
        joined = joined.join(crops.select(F.col("crop").alias(f"{side}_crop"), *[F.col(c).alias(f"_{side}_{c}") for c in ("sighting", "side", "name")]), f"{side}_crop", "left")
    col = F.col
    reason = (
        F.when(col("_left_side").isNull() | col("_right_side").isNull(), "unknown crop")
        .when((col("_left_side") != "left") | (col("_right_side") != "right"), "wrong side")
        .when(col("_left_sighting") != col("_right_sighting"), "crosses sightings")
        .when(col("sighting") != col("_left_sighting"), "other sighting")
        .when((col("name") != col("_left_name")) | (col("_left_name") != col("_right_name")), "other name")
    )
    return joined.select("sighting", reason.alias("reason")).filter(F.col("reason").isNotNull())


def inconsistent_drafts(drafts: DataFrame, crops: DataFrame) -> DataFrame:
    """Drafts (sighting, side, crop) whose crop is unknown, of another sighting or of another side."""
    known = crops.select("crop", F.col("sighting").alias("_sighting"), F.col("side").alias("_side"))
    bad = F.col("_side").isNull() | (F.col("_sighting") != F.col("sighting")) | (F.col("_side") != F.col("side")) | ~F.col("side").isin("left", "right")
    return drafts.join(known, "crop", "left").filter(bad).select("sighting", "side", "crop")


def assessment_mismatches(assessments: DataFrame, photos: DataFrame) -> DataFrame:
    """Assessed photos (photo, sighting, name) that the photo table knows with another sighting or name."""
    known = photos.select("photo", F.col("sighting").alias("_sighting"), F.col("name").alias("_name"))
    return assessments.join(known, "photo").filter((F.col("sighting") != F.col("_sighting")) | (F.col("name") != F.col("_name"))).select("photo")


def unequal_lengths(profiles: DataFrame, group: str) -> DataFrame:
    """group, n_scales, n_lengths: groups whose ears (group, ear, profiles ARRAY of ARRAYs, one for each scale) differ in the number of scales or in the length of
    profiles."""
    lengths = F.transform("profiles", lambda p: F.size(p))
    shape = profiles.select(group, F.size("profiles").alias("_scales"), F.array_min(lengths).alias("_low"), F.array_max(lengths).alias("_high"))
    out = shape.groupBy(group).agg(F.count_distinct("_scales").alias("n_scales"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return out.filter((F.col("n_scales") > 1) | (F.col("_low") != F.col("_high"))).select(group, "n_scales", (F.col("_high") - F.col("_low")).alias("spread"))


def valid_landmarks(points: Column, box: Column) -> Column:
    """Exactly two key points (ARRAY<STRUCT<x, y>>) and a box (ARRAY), all finite.  No points at all (null) is no landmark, which is allowed."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return points.isNull() | ((F.size(points) == 2) & F.forall(points, lambda p: finite(p["x"]) & finite(p["y"])) & F.forall(box, finite))


def bad_contours(contour: DataFrame, anchors: DataFrame, areas: DataFrame, key: str = "ear") -> DataFrame:
    """key, reason: outlines (key, i, x, y) with a coordinate that is not finite, fewer than two points, an area (key, area) that is not positive, or ends that
    are not the anchors (key, ux, uy, lx, ly)."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    each = contour.groupBy(key).agg(F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b"), F.count("*").alias("n"), F.bool_and(finite("x") & finite("y")).alias("ok"))
    both = each.join(anchors, key, "left").join(areas.select(key, "area"), key, "left")
    reason = (
        F.when(F.col("n") < 2, "points")
        .when(~F.col("ok"), "not finite")
        .when(F.coalesce(F.col("area"), F.lit(0.0)) <= 0, "area")
        .when(~((F.col("a.x") == F.col("ux")) & (F.col("a.y") == F.col("uy"))), "start")
        .when(~((F.col("b.x") == F.col("lx")) & (F.col("b.y") == F.col("ly"))), "end")
    )
    return both.select(key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def bad_runs(runs: DataFrame, masks: DataFrame) -> DataFrame:
    """mask, reason: masks (mask, height, width) of no size, and those with a run (mask, start, length) that is empty or leaves the mask."""
    joined = masks.join(runs, "mask", "left")
    reason = (
        F.when((F.col("height") <= 0) | (F.col("width") <= 0), "size")
        .when(F.col("length") <= 0, "empty run")
        .when((F.col("start") < 0) | (F.col("start") + F.col("length") > F.col("height") * F.col("width")), "outside")
    )
    return joined.groupBy("mask").agg(F.min(reason).alias("reason")).filter(F.col("reason").isNotNull())


def displayable(score: Column, side: Column, available: Column, least: int = 5) -> Column:
    """Candidates that a reviewer may see: a known side, the least score, and an image that is there."""
    return F.coalesce((score >= least) & side.isin("left", "right") & available, F.lit(False))


def of_class(detections: DataFrame, name: str = "ear") -> DataFrame:
    """The detections of one class."""
    return detections.filter(F.col("class_name") == name)
