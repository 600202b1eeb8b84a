"""Readers and writers of the domain's files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHOTO_FIELDS = ["photo_id", "sighting_id", "date", "name", "image_path"]
PAIR_FIELDS = ["known_name", "sighting_id", "left_photo_id", "right_photo_id"]
_TEXT = T.StringType()
_ASSESSMENT = "photos array<struct<photo_id string, sighting_id string, name string, ears array<struct<side string, assessment struct<ear:struct<reid_quality:string>>>>>>"
_PROFILES = "ear string, alpha_scales array<double>, profiles array<struct<start_degrees double, end_degrees double, depths array<double>>>"
_DETECTIONS = "photo_id string, detections array<struct<xyxy array<double>, class_name string, class_id int, confidence double, keypoints array<array<double>>>>"
_PREDICTIONS = "image struct<width int, height int>, predictions array<struct<x double, y double, width double, height double, class string, class_id int>>"


def _exact_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """All columns as text; every file's header must be exactly these names in this order."""
    schema = T.StructType([T.StructField(f, _TEXT) for f in fields])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    return _exact_csv(spark, path, PHOTO_FIELDS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _exact_csv(spark, path, PAIR_FIELDS)


def photo_bytes(photos: DataFrame, root: str) -> DataFrame:
    """photos with content and status: ok, unmapped (no path) or missing (no such file)."""
    files = photos.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    folder = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/")) + "/"  # paths of files have a scheme, whatever root has
    inner = F.substring(F.col("path"), F.locate(folder, F.col("path")) + len(folder), F.length("path"))
    found = photos.join(files.select(inner.alias("image_path"), "content"), "image_path", "left")
    status = F.when(F.col("image_path").isNull(), "unmapped").when(F.col("content").isNull(), "missing").otherwise("ok")
    return found.withColumn("status", status)


def read_assessments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """photo_id, sighting_id, name, side, score of nested JSON records with whole-number scores; other sides are `unresolved`."""
    rows = spark.read.schema(_ASSESSMENT).option("multiLine", multi_line).json(path)
    ears = rows.select(F.explode("photos").alias("p")).select("p.photo_id", "p.sighting_id", "p.name", F.explode("p.ears").alias("e"))
    score = F.when(F.regexp_like("e.assessment.ear.reid_quality", F.lit(r"^\d+$")), F.col("e.assessment.ear.reid_quality").cast("int"))
    side = F.when(F.col("e.side").isin("left", "right"), F.col("e.side")).otherwise("unresolved")
    return ears.select("photo_id", "sighting_id", "name", side.alias("side"), score.alias("score")).filter(F.col("score").isNotNull())


def read_gallery(profiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """profiles with the paths of the last manifest row of each (photo_id, side)."""
    rest = [c for c in manifest.columns if c not in ("photo_id", "side", "row_no")]
    last = manifest.groupBy("photo_id", "side").agg(F.max_by(F.struct(*rest), "row_no").alias("_m")).select("photo_id", "side", "_m.*")
    return profiles.join(last, ["photo_id", "side"], "left")


def read_profile_records(spark: SparkSession, path: str, scales: list[float]) -> DataFrame:
    """ear, scale_idx, start, end, depths, valid: one row for each scale; valid if the stored scales are the expected ones in order."""
    rows = spark.read.schema(_PROFILES).json(path)
    valid = F.col("alpha_scales").eqNullSafe(F.array(*[F.lit(float(s)) for s in scales])) & (F.size("profiles") == len(scales))
    one = rows.select("ear", valid.alias("valid"), F.posexplode("profiles").alias("scale_idx", "p"))
    return one.select("ear", "scale_idx", F.col("p.start_degrees").alias("start"), F.col("p.end_degrees").alias("end"), "p.depths", "valid")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """photo_id, class_name, class_id, confidence, xyxy, keypoints; a photo without detections has one row of nulls."""
    rows = spark.read.schema(_DETECTIONS).json(path)
    return rows.select("photo_id", F.explode_outer("detections").alias("d")).select("photo_id", "d.*")


def list_photos(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png"), limit: int | None = None) -> DataFrame:
    """path, length of image files in the order of their names; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder).select("path", "length").orderBy("path")
    return files if limit is None else files.limit(limit)


def read_batch_predictions(spark: SparkSession, path: str) -> DataFrame:
    """file_name, width, height and one row for each prediction of a table with a JSON column."""
    rows = spark.read.schema("image string, predictions string").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    parsed = rows.select(F.col("image").alias("file_name"), F.from_json("predictions", _PREDICTIONS).alias("j"))
    return parsed.select("file_name", F.col("j.image.width").alias("width"), F.col("j.image.height").alias("height"), F.explode_outer("j.predictions").alias("p"))


def write_manifest(pairs: DataFrame, path: str) -> None:
    """Approved pairs as one file, sorted by individual and sighting."""
    pairs.orderBy("name", "sighting").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def provenance(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, sighting and, as JSON, score and box of either side's crop."""
    crop = candidates.select("sighting", "line", F.to_json(F.struct("score", "box")).alias("crop"))
    left = crop.withColumnsRenamed({"line": "left_line", "crop": "left_crop"})
    right = crop.withColumnsRenamed({"line": "right_line", "crop": "right_crop"})
    return pairs.join(left, ["sighting", "left_line"]).join(right, ["sighting", "right_line"]).select("name", "sighting", "left_crop", "right_crop")


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """fingerprint, in one row: the same for the same rows in any order, repeats counted; SHA-256 of the sum of 60 bits of each row's MD5."""
    bits = F.conv(F.substring(F.md5(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sha2(F.coalesce(F.sum(bits), F.lit(0)).cast("string"), 256).alias("fingerprint"))


def review_export(pairs: DataFrame, candidates: DataFrame, photos: DataFrame, state: DataFrame, version: int = 1) -> DataFrame:
    """section, name, sighting, photo, record (JSON): a finished review as rows, so that no part of it is gathered.

    `review`: version, fingerprint and revision, as state (one row) has them; `pair`: crops of every approved pair; `selected`: each individual with a pair;
    `excluded`: every photo of a selected individual, which training must not use.  Pairs whose crops are unknown are left out, and select nobody."""
    empty = lambda of: F.lit(None).cast(of)
    approved = provenance(pairs, candidates)
    selected = approved.select("name").distinct()
    crops = F.concat(F.lit('{"left":'), "left_crop", F.lit(',"right":'), "right_crop", F.lit("}"))
    head = F.to_json(F.struct(F.lit(version).alias("schema_version"), "fingerprint", "revision"))
    columns = [F.col("name"), F.col("sighting"), empty("string").alias("photo")]
    none = [empty("string").alias("name"), empty(dict(photos.dtypes)["sighting"]).alias("sighting"), empty("string").alias("photo")]
    out = approved.select(F.lit("pair").alias("section"), *columns, crops.alias("record"))
    out = out.union(selected.select(F.lit("selected"), "name", none[1], none[2], empty("string")))
    out = out.union(photos.join(selected, "name", "left_semi").select(F.lit("excluded"), "name", "sighting", F.col("photo").cast("string"), empty("string")))
    return out.union(state.select(F.lit("review"), *none, head))


def write_quality(scores: DataFrame, path: str) -> None:
    """Scores as CSV, fractions with six decimals."""
    text = [F.format_string("%.6f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes]
    scores.select(*text).write.mode("overwrite").option("header", True).csv(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One row, column json: a map from the names of the columns to their values."""
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in metrics.columns]))
    return metrics.select(F.to_json(entries).alias("json"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").partitionBy("side").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Stored profiles; rows without geometry get an empty array."""
    rows = spark.read.parquet(path)
    if "geometry" not in rows.columns:
        rows = rows.withColumn("geometry", F.lit(None).cast("array<double>"))
    return rows.withColumn("geometry", F.coalesce("geometry", F.array().cast("array<double>")))


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """Three JSON tables below path."""
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def newest_first(records: DataFrame, by: str, group: str) -> DataFrame:
    return records.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(by).desc())).cast("long"))
