"""Queries over training tables, tables that grow and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import incremental as inc
from sightline.operators import training as tr
from sightline.plans import inputs
from sightline.plans.registry import query, table
from sightline.plans.retrieval_queries import rounded

B = inputs.BOXES_SQL
_PRED = B + ", pred AS (SELECT concat(sighting, '.jpg') AS file_name, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x2 - x1 AS width, y2 - y1 AS height, line % 3 AS class_id, concat('class', line % 3) AS class_name FROM boxes)"


def predictions(spark, sf):
    b = inputs.boxes(spark, sf)
    return b.select(
        F.concat(F.col("sighting"), F.lit(".jpg")).alias("file_name"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"),
        (F.col("line") % 3).alias("class_id"), F.concat(F.lit("class"), F.col("line") % 3).alias("class_name"),
    )


@query(f"WITH {_PRED} SELECT dense_rank() OVER (ORDER BY file_name) AS image_id, file_name FROM (SELECT DISTINCT file_name FROM pred)")
def d1_images(spark, sf):
    return tr.image_table(predictions(spark, sf)).select("image_id", "file_name")


@query(
    f"""WITH {_PRED}, r AS (SELECT *, row_number() OVER (ORDER BY file_name, class_id, x, y, width, height) AS annotation_id, dense_rank() OVER (ORDER BY file_name) AS image_id FROM pred)
SELECT annotation_id, image_id, class_id + 1 AS category_id, round(x - width / 2, 6) AS bx, round(height, 6) AS bh, round(width * height, 6) AS area FROM r"""
)
def d1_annotations(spark, sf):
    p = predictions(spark, sf)
    a = tr.annotation_table(p, tr.image_table(p))
    return rounded(a.select("annotation_id", "image_id", "category_id", F.get("bbox", F.lit(0)).alias("bx"), F.get("bbox", F.lit(3)).alias("bh"), "area"))


@query(f"WITH {_PRED} SELECT class_id + 1 AS id, min(class_name) AS name FROM pred GROUP BY 1")
def d1_categories(spark, sf):
    return tr.category_table(predictions(spark, sf))


@query(
    f"""WITH {B}, a AS (SELECT sighting * 10 + line AS id, x1 AS x, x2 - x1 AS w, [x1, y1, line % 2, x2, y2, 1.0] AS k FROM boxes)
SELECT id, x, w, k[1] AS k1, k[4] AS k4 FROM a UNION ALL SELECT id + (SELECT max(id) FROM a), greatest(0.0, 200 - 1 - x - w), w, CASE WHEN k[3] > 0 THEN 199 - k[1] ELSE k[1] END, 199 - k[4] FROM a"""
)
def d2_mirrored_annotations(spark, sf):
    b = inputs.boxes(spark, sf)
    k = F.array("x1", "y1", (F.col("line") % 2).cast("double"), "x2", "y2", F.lit(1.0))
    a = b.select((F.col("sighting") * 10 + F.col("line")).alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), k.alias("keypoints"))
    return tr.with_flips(a, F.lit(200)).select("id", "x", "w", F.get("keypoints", F.lit(0)).alias("k1"), F.get("keypoints", F.lit(3)).alias("k4"))


_FLIPS = (
    B
    + """, im AS (SELECT DISTINCT sighting AS image_id, concat(sighting, '.crop.jpg') AS file_name, 200 AS width, CASE sighting % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM boxes),
new AS (SELECT *, max(image_id) OVER (PARTITION BY split) + row_number() OVER (PARTITION BY split ORDER BY image_id) AS new_id FROM im WHERE split <> 'test')"""
)


def flip_tables(spark, sf):
    b = inputs.boxes(spark, sf)
    split = F.when(F.col("sighting") % 3 == 0, "train").when(F.col("sighting") % 3 == 1, "valid").otherwise("test")
    images = b.select(F.col("sighting").alias("image_id"), F.concat(F.col("sighting"), F.lit(".crop.jpg")).alias("file_name"), F.lit(200).alias("width"), split.alias("split")).distinct()
    k = F.array("x1", "y1", (F.col("line") % 2).cast("double"))
    notes = b.select((F.col("sighting") * 10 + F.col("line")).alias("id"), F.col("sighting").alias("image_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), k.alias("keypoints"))
    return tr.flip_images(images, notes, ["train", "valid"])


@query(f"WITH {_FLIPS} SELECT image_id, file_name, split FROM im UNION ALL SELECT new_id, replace(file_name, '.jpg', '_flip.jpg'), split FROM new")
def d2_flipped_images(spark, sf):
    return flip_tables(spark, sf)[0].select("image_id", "file_name", "split")


@query(
    f"""WITH {_FLIPS}, a AS (SELECT sighting * 10 + line AS id, sighting AS image_id, x1 AS x, x2 - x1 AS w, x1 AS k, line % 2 AS v FROM boxes)
SELECT id, image_id, x, k FROM a UNION ALL
SELECT max(id) OVER (PARTITION BY split) + row_number() OVER (PARTITION BY split ORDER BY id), new_id, greatest(0.0, 199 - x - w), CASE WHEN v > 0 THEN 199 - k ELSE k END FROM a JOIN new USING (image_id)"""
)
def d2_flipped_annotations(spark, sf):
    return flip_tables(spark, sf)[1].select("id", "image_id", "x", F.get("keypoints", F.lit(0)).alias("k"))


@query(f"WITH {inputs.PAIRS_SQL}, n AS (SELECT name, count(*) AS n FROM pairs GROUP BY 1) SELECT name, n, ((row_number() OVER (PARTITION BY n ORDER BY name) - 1) % 2)::INT AS part FROM n")
def d6_group_split(spark, sf):
    return tr.group_split(inputs.pairs(spark, sf), "name")


@query(
    f"""WITH RECURSIVE {B}, n AS (SELECT *, row_number() OVER (PARTITION BY sighting ORDER BY score DESC, line) AS r FROM boxes),
walk AS (
  SELECT sighting, r, [{{'id': line, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM n WHERE r = 1
  UNION ALL
  SELECT n.sighting, n.r, CASE WHEN len(kept) >= 5 OR len(list_filter(kept, lambda k:
      greatest(0.0, least(k.x2, n.x2) - greatest(k.x1, n.x1)) * greatest(0.0, least(k.y2, n.y2) - greatest(k.y1, n.y1)) > 0.3 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (n.x2 - n.x1) * (n.y2 - n.y1)
      - greatest(0.0, least(k.x2, n.x2) - greatest(k.x1, n.x1)) * greatest(0.0, least(k.y2, n.y2) - greatest(k.y1, n.y1))))) > 0 THEN kept
    ELSE list_append(kept, {{'id': n.line, 'x1': n.x1, 'y1': n.y1, 'x2': n.x2, 'y2': n.y2}}) END
  FROM walk JOIN n ON n.sighting = walk.sighting AND n.r = walk.r + 1)
SELECT sighting, arg_max(list_transform(kept, lambda k: k.id), r) AS kept FROM walk GROUP BY 1"""
)
def d7_suppressed_boxes(spark, sf):
    b = inputs.boxes(spark, sf).withColumn("id", F.col("line"))
    return tr.suppressed(b, "sighting", 0.3, 5)


@query(
    f"""WITH RECURSIVE {B}, s AS (SELECT sighting, line AS id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area FROM boxes),
n AS (SELECT *, row_number() OVER (PARTITION BY sighting ORDER BY area DESC, id) AS r FROM s WHERE area > 0),
walk AS (
  SELECT sighting, r, [{{'id': id, 'cx': cx, 'cy': cy}}] AS kept FROM n WHERE r = 1
  UNION ALL
  SELECT n.sighting, n.r, CASE WHEN len(list_filter(kept, lambda k: sqrt(pow(k.cx - n.cx, 2) + pow(k.cy - n.cy, 2)) < 25)) > 0 THEN kept ELSE list_append(kept, {{'id': n.id, 'cx': n.cx, 'cy': n.cy}}) END
  FROM walk JOIN n ON n.sighting = walk.sighting AND n.r = walk.r + 1)
SELECT sighting, unnest(list_transform(arg_max(kept, r), lambda k: k.id)) AS id FROM walk GROUP BY 1"""
)
def d7_shapes_apart(spark, sf):
    b = inputs.boxes(spark, sf)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    shapes = b.select("sighting", F.col("line").alias("id"), area.alias("area"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    return tr.apart(shapes, "sighting", 25.0).select("sighting", "id")


_LOG = "log AS (SELECT conv_id AS sighting, conv_id % 9 AS individual, turn AS seq, CASE role WHEN 'user' THEN 'accept' WHEN 'assistant' THEN 'reject' ELSE 'skip' END AS action FROM conversations)"


def decision_log(spark, sf):
    action = F.when(F.col("role") == "user", "accept").when(F.col("role") == "assistant", "reject").otherwise("skip")
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("sighting"), (F.col("conv_id") % 9).alias("individual"), F.col("turn").alias("seq"), action.alias("action"))


@query(f"WITH {_LOG}, n AS (SELECT sighting, arg_max(action, seq) AS action, max(seq) AS seq, count(*) FILTER (WHERE action = 'accept') AS a FROM log GROUP BY 1) SELECT sighting, action, seq, a - (action = 'accept')::BIGINT AS superseded FROM n")
def t2_decision_fold(spark, sf):
    return inc.fold_decisions(decision_log(spark, sf))


_CUST_LOG = "log AS (SELECT o_custkey AS individual, o_orderkey // 8 AS sighting, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 THEN 'reject' ELSE 'accept' END AS action FROM orders)"


@query(
    f"""WITH RECURSIVE {_CUST_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY seq, sighting) AS r FROM log),
walk AS (
  SELECT individual, r, CASE WHEN action = 'accept' THEN [sighting] ELSE []::BIGINT[] END AS kept FROM n WHERE r = 1
  UNION ALL
  SELECT n.individual, n.r, CASE WHEN action = 'reject' THEN list_filter(kept, lambda k: k <> n.sighting) WHEN NOT list_contains(kept, n.sighting) AND len(kept) < 5 THEN list_append(kept, n.sighting) ELSE kept END
  FROM walk JOIN n ON n.individual = walk.individual AND n.r = walk.r + 1)
SELECT individual, unnest(kept) AS sighting FROM (SELECT individual, arg_max(kept, r) AS kept FROM walk GROUP BY 1)"""
)
def t2_capped_fold(spark, sf):
    k = F.col("o_orderkey")
    action = F.when((F.col("o_orderstatus") == "P") | (k % 3 == 0), "reject").otherwise("accept")
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("individual"), F.expr("o_orderkey div 8").alias("sighting"), k.alias("seq"), action.alias("action"))
    return inc.fold_decisions_capped(log, 5)


@query(
    """WITH RECURSIVE n AS (SELECT conv_id AS key, turn, CASE WHEN turn % 5 = 3 THEN 'pick' WHEN turn % 7 = 5 THEN 'reject' ELSE 'flag' END AS action, concat('p', turn // 4) AS pair, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
walk AS (
  SELECT key, r, CASE WHEN action = 'flag' THEN pair END AS flagged, NULL::VARCHAR AS resolution FROM n WHERE r = 1
  UNION ALL
  SELECT n.key, n.r, CASE WHEN action <> 'flag' THEN flagged WHEN flagged = pair AND resolution IS NULL THEN NULL ELSE pair END,
    CASE WHEN action = 'flag' THEN NULL WHEN flagged IS NOT NULL AND resolution IS NULL THEN CASE action WHEN 'pick' THEN 'replaced' ELSE 'rejected' END ELSE resolution END
  FROM walk JOIN n ON n.key = walk.key AND n.r = walk.r + 1)
SELECT key, flagged, resolution FROM (SELECT key, arg_max({'f': flagged, 's': resolution}, r) AS x FROM walk GROUP BY 1), (SELECT 1) WHERE x.f IS NOT NULL""".replace("SELECT key, flagged, resolution FROM (", "SELECT key, x.f AS flagged, x.s AS resolution FROM (")
)
def t3_toggled_flags(spark, sf):
    c, turn = table(spark, sf, "conversations"), F.col("turn")
    action = F.when(turn % 5 == 3, "pick").when(turn % 7 == 5, "reject").otherwise("flag")
    return inc.toggled_flags(c.select(F.col("conv_id").alias("key"), turn.alias("seq"), action.alias("action"), F.concat(F.lit("p"), F.expr("turn div 4")).alias("pair")))


@query(
    """WITH log AS (SELECT conv_id AS key, turn AS seq, CASE (turn * 3 + conv_id) % 5 WHEN 0 THEN 'analyse' WHEN 1 THEN 'approve' WHEN 2 THEN 'match' ELSE 'decide' END AS action FROM conversations),
a AS (SELECT key, max(CASE WHEN action = 'analyse' THEN seq END) AS analysed FROM log GROUP BY 1),
b AS (SELECT l.key, analysed, max(CASE WHEN action = 'approve' AND seq > coalesce(analysed, -1) THEN seq END) AS approved FROM log l JOIN a ON a.key = l.key GROUP BY 1, 2)
SELECT l.key, analysed, approved, max(CASE WHEN action = 'match' AND seq > coalesce(greatest(analysed, approved), -1) THEN seq END) AS matched, min(CASE WHEN action = 'decide' AND seq > coalesce(greatest(analysed, approved), -1) THEN seq END) AS decided
FROM log l JOIN b ON b.key = l.key GROUP BY 1, 2, 3"""
)
def t4_lifecycle(spark, sf):
    step = (F.col("turn") * 3 + F.col("conv_id")) % 5
    action = F.when(step == 0, "analyse").when(step == 1, "approve").when(step == 2, "match").otherwise("decide")
    return inc.lifecycle(table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), action.alias("action")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 15 <> 0")
def s13_upserted_manifest(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    changes = o.filter("id % 5 = 0").select("id", (F.col("price") * 2).alias("price"), (F.col("id") % 3 == 0).alias("gone"))
    return inc.upsert(o, changes, ["id"], "gone")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size * 2 END AS value FROM part")
def t1_get_or_compute(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    stored = p.filter("id % 3 = 0 OR id % 7 = 0").select("id", F.when(F.col("id") % 3 == 0, F.col("size")).alias("value"))
    rows, _ = inc.get_or_compute(p, stored, ["id"], lambda d: d.select("id", (F.col("size") * 2).alias("value")), F.col("value").isNotNull())
    return rows


@query("SELECT s_suppkey AS key, (s_nationkey + 3)::BIGINT AS revision FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey >= 2")
def t6_restorable_snapshots(spark, sf):
    s = table(spark, sf, "supplier")
    current = s.select(F.col("s_suppkey").alias("key"), F.sha2(F.col("s_name"), 256).alias("fingerprint"), F.lit(5).alias("revision"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.lower("s_name"))
    shots = s.select(F.col("s_suppkey").alias("key"), F.sha2(name, 256).alias("fingerprint"), (F.col("s_nationkey") + 3).cast("long").alias("revision"))
    return inc.restorable(shots, current).select("key", "revision")


@query("SELECT o_custkey AS by, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def t5_replay_order(spark, sf):
    return inc.replay_order(table(spark, sf, "orders").select(F.col("o_custkey").alias("by"), F.col("o_orderkey").alias("seq")), "by")
