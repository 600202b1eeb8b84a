"""Queries that write derived tables as files in the shared folder and read them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline.operators.shared import dense_ids, shared_folder
from sightline.plans import inputs
from sightline.plans.registry import query, table
from sightline.sources import tables as src


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {inputs.CROPS_SQL} SELECT photo AS photo_id, sighting::VARCHAR AS sighting_id, date, name, concat('images/', photo, '.jpg') AS image_path FROM photos")
def s1_photo_metadata(spark, sf):
    path = scratch(spark, "photos")
    p = inputs.photos(spark, sf)
    p.select(F.col("photo").alias("photo_id"), F.col("sighting").alias("sighting_id"), "date", "name", F.concat(F.lit("images/"), "photo", F.lit(".jpg")).alias("image_path")).write.option("header", True).csv(path)
    return src.read_photos(spark, path)


@query(f"WITH {inputs.PAIRS_SQL} SELECT name AS known_name, sighting::VARCHAR AS sighting_id, concat(sighting, '-', left_line) AS left_photo_id, concat(sighting, '-', right_line) AS right_photo_id FROM pairs")
def s2_pair_manifest(spark, sf):
    path = scratch(spark, "pairs")
    line = lambda side: F.concat_ws("-", "sighting", f"{side}_line").alias(f"{side}_photo_id")
    inputs.pairs(spark, sf).select(F.col("name").alias("known_name"), F.col("sighting").alias("sighting_id"), line("left"), line("right")).write.option("header", True).csv(path)
    return src.read_pairs(spark, path)


@query(
    f"""WITH {inputs.CROPS_SQL} SELECT photo AS photo_id, sighting::VARCHAR AS sighting_id, name, CASE WHEN line % 5 = 0 THEN 'unresolved' ELSE side END AS side, score FROM photos WHERE line % 4 <> 0"""
)
def s4_assessments(spark, sf):
    path = scratch(spark, "assessments")
    side = F.when(F.col("line") % 5 == 0, "back").otherwise(F.col("side"))
    quality = F.when(F.col("line") % 4 == 0, "high").otherwise(F.col("score").cast("string"))
    ear = F.struct(side.alias("side"), F.struct(F.struct(quality.alias("reid_quality")).alias("ear")).alias("assessment"))
    photo = F.struct(F.col("photo").alias("photo_id"), F.col("sighting").cast("string").alias("sighting_id"), "name", F.array(ear).alias("ears"))
    inputs.photos(spark, sf).groupBy("sighting").agg(F.collect_list(photo).alias("photos")).select("photos").write.json(path)
    return src.read_assessments(spark, path, multi_line=False)  # Spark writes a record a line


@query(
    f"""WITH {inputs.CROPS_SQL}, m AS (SELECT photo, side, concat('crop/', photo, '/', n) AS crop_path, n AS row_no FROM photos, (SELECT unnest(range(3))::INT AS n) WHERE sighting % 2 = 0)
SELECT p.photo AS photo_id, p.side, m.crop_path FROM photos p LEFT JOIN m ON m.photo = p.photo AND m.side = p.side AND row_no = 2"""
)
def s5_gallery(spark, sf):
    p = inputs.photos(spark, sf).select(F.col("photo").alias("photo_id"), "side", "sighting")
    n = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row_no")
    manifest = p.filter("sighting % 2 = 0").select("photo_id", "side", n).withColumn("crop_path", F.concat(F.lit("crop/"), "photo_id", F.lit("/"), "row_no"))
    return src.read_gallery(p.select("photo_id", "side"), manifest)


@query(f"WITH {inputs.EARS_SQL} SELECT ear, s AS scale_idx, user_id % 3 <> 0 AS valid FROM keys, (SELECT unnest(range(2))::INT AS s)")
def s6_profile_records(spark, sf):
    path = scratch(spark, "profiles")
    profile = F.struct(F.lit(5.0).alias("start_degrees"), F.lit(175.0).alias("end_degrees"), "depths")
    scales = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(0.2), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.2)))
    inputs.ears(spark, sf).select("ear", scales.alias("alpha_scales"), F.array(profile, profile).alias("profiles")).write.json(path)
    return src.read_profile_records(spark, path, [0.1, 0.2]).select("ear", "scale_idx", "valid")


@query(
    f"""WITH {inputs.BOXES_SQL} SELECT sighting::VARCHAR AS photo_id, 'ear' AS class_name, score / 10.0::DOUBLE AS confidence FROM boxes WHERE sighting % 7 <> 0
UNION ALL SELECT DISTINCT sighting::VARCHAR, NULL, NULL::DOUBLE FROM boxes WHERE sighting % 7 = 0"""
)
def s7_detections(spark, sf):
    path = scratch(spark, "detections")
    one = F.struct(F.array("x1", "y1", "x2", "y2").alias("xyxy"), F.lit("ear").alias("class_name"), F.lit(0).alias("class_id"), (F.col("score") / 10.0).alias("confidence"))
    rows = inputs.boxes(spark, sf).groupBy("sighting").agg(F.collect_list(one).alias("d"))
    rows.select(F.col("sighting").cast("string").alias("photo_id"), F.when(F.col("sighting") % 7 != 0, F.col("d")).alias("detections")).write.json(path)
    return src.read_detections(spark, path).select("photo_id", "class_name", "confidence")


@query(f"WITH {inputs.BOXES_SQL} SELECT concat(sighting, '.jpg') AS file_name, 640 AS width, line % 3 AS class_id, round(x1, 6) AS x FROM boxes")
def s9_batch_predictions(spark, sf):
    path = scratch(spark, "predictions")
    one = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1.0).alias("width"), F.lit(2.0).alias("height"), F.lit("ear").alias("class"), (F.col("line") % 3).alias("class_id"))
    rows = inputs.boxes(spark, sf).groupBy("sighting").agg(F.collect_list(one).alias("predictions"))
    image = F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("image")
    text = rows.select(F.concat("sighting", F.lit(".jpg")).alias("image"), F.to_json(F.struct(image, "predictions")).alias("predictions"))
    text.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return src.read_batch_predictions(spark, path).select("file_name", "width", "p.class_id", F.round("p.x", 6).alias("x"))


@query(
    f"""WITH {inputs.PAIRS_SQL} SELECT p.name, p.sighting, concat('{{"score":', l.score, ',"box":[', l.part % 90, ']}}') AS left_crop, concat('{{"score":', r.score, ',"box":[', r.part % 90, ']}}') AS right_crop
FROM pairs p JOIN crops l ON l.sighting = p.sighting AND l.line = p.left_line JOIN crops r ON r.sighting = p.sighting AND r.line = p.right_line"""
)
def s11_provenance(spark, sf):
    candidates = inputs.crops(spark, sf).withColumn("box", F.array(F.col("part") % 90))
    return src.provenance(inputs.pairs(spark, sf), candidates)


@query(
    f"""WITH {inputs.PAIRS_SQL}, a AS (SELECT p.name, p.sighting, concat('{{"left":{{"score":', l.score, ',"box":[', l.part % 90, ']}},"right":{{"score":', r.score, ',"box":[', r.part % 90, ']}}}}') AS record
FROM pairs p JOIN crops l ON l.sighting = p.sighting AND l.line = p.left_line JOIN crops r ON r.sighting = p.sighting AND r.line = p.right_line),
h AS (SELECT sha256(sum(('0x' || substr(md5(concat('{{"sighting":', sighting, ',"line":', line, ',"part":', part, ',"score":', score, '}}')), 1, 15))::HUGEINT)::HUGEINT::VARCHAR) AS hash FROM crops)
SELECT 'pair' AS section, name, sighting::VARCHAR AS sighting, NULL::VARCHAR AS photo, record FROM a UNION ALL SELECT DISTINCT 'selected', name, NULL, NULL, NULL FROM a UNION ALL SELECT 'excluded', name, sighting::VARCHAR, photo, NULL FROM photos WHERE name IN (SELECT name FROM a)
UNION ALL SELECT 'review', NULL, NULL, NULL, concat('{{"schema_version":1,"fingerprint":"', hash, '","revision":', (SELECT count(*) FROM orders), '}}') FROM h"""
)
def s11_review_export(spark, sf):
    crops = inputs.crops(spark, sf)
    parts = [src.table_fingerprint(crops.select("sighting", "line", "part", "score")), table(spark, sf, "orders").agg(F.count("*").alias("revision"))]
    state = parts[0].unionByName(parts[1], allowMissingColumns=True).agg(F.max("fingerprint").alias("fingerprint"), F.max("revision").alias("revision"))
    out = src.review_export(inputs.pairs(spark, sf), crops.withColumn("box", F.array(F.col("part") % 90)), inputs.photos(spark, sf), state)
    return out.withColumn("sighting", F.col("sighting").cast("string"))


@query("SELECT doc_id, printf('%.6f', n_chars / 7.0::DOUBLE) AS score FROM documents")
def s12_quality_file(spark, sf):
    path = scratch(spark, "quality")
    src.write_quality(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 7.0).alias("score")), path)
    return spark.read.schema("doc_id long, score string").option("header", True).csv(path)


@query(f"WITH {inputs.EARS_SQL} SELECT ear, side, 0 AS n_geometry FROM keys")
def s15_stored_profiles(spark, sf):
    path = scratch(spark, "stored")
    src.write_profiles(inputs.ears(spark, sf).select("ear", "side", "depths"), path)
    return src.read_profiles(spark, path).select("ear", "side", F.size("geometry").alias("n_geometry"))


@query(f"WITH {inputs.PAIRS_SQL} SELECT row_number() OVER (ORDER BY name, sighting) AS place, name, sighting, left_line FROM pairs")
def s10_approved_manifest(spark, sf):
    """The written file's own order: it is one file, read as one partition."""
    path = scratch(spark, "manifest")
    src.write_manifest(inputs.pairs(spark, sf).select("name", "sighting", "left_line"), path)
    rows = spark.read.schema("name string, sighting long, left_line int").option("header", True).csv(path).withColumn("_at", F.monotonically_increasing_id())
    return dense_ids(rows, ["_at"], "place").select("place", "name", "sighting", "left_line")


@query("SELECT unnest(['mean', 'most', 'n']) AS key, unnest([round(avg(value), 6), round(max(value), 6), count(*)::DOUBLE]) AS value FROM events")
def s14_metrics_json(spark, sf):
    e = table(spark, sf, "events").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return src.metrics_json(e).select(F.explode(F.from_json("json", "map<string,double>"))).select("key", F.round("value", 6).alias("value"))


@query(f"WITH {inputs.BOXES_SQL} SELECT 'images' AS part, count(DISTINCT sighting) AS n, max(sighting) AS top FROM boxes UNION ALL SELECT 'annotations', count(*), max(sighting * 10 + line) FROM boxes UNION ALL SELECT 'categories', count(DISTINCT line % 3), max(line % 3) FROM boxes")
def s17_coco_tables(spark, sf):
    path, b = scratch(spark, "coco"), inputs.boxes(spark, sf)
    ids = {"images": F.col("sighting"), "annotations": F.col("sighting") * 10 + F.col("line"), "categories": (F.col("line") % 3).cast("long")}
    src.write_coco(*[b.select(c.alias("id")).distinct() for c in ids.values()], path)
    parts = [spark.read.schema("id long").json(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.max("id").alias("top")) for name in ids]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations")
def l2_newest_first(spark, sf):
    return src.newest_first(table(spark, sf, "conversations").select("conv_id", "turn"), "turn", "conv_id")
