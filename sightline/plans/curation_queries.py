"""Queries over curation, joins, windows, sets and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.operators import curation as cu
from sightline.operators import evaluation as ev
from sightline.operators import training as tr
from sightline.operators.shared import exact_quantiles, materialise
from sightline.plans import inputs
from sightline.plans.registry import query, table
from sightline.plans.retrieval_queries import rounded

P, PAIRS = inputs.CROPS_SQL, inputs.PAIRS_SQL

_TIERS = """tiers0 AS (SELECT name, sighting, max(CASE WHEN side = 'left' THEN score END) AS l, max(CASE WHEN side = 'right' THEN score END) AS r FROM photos GROUP BY 1, 2),
tiers AS (SELECT name, sighting, least(l, r) AS tier FROM tiers0 WHERE l >= 8 AND r >= 8)"""
_STRENGTH = """each AS (SELECT name, sighting, side, CASE score WHEN 10 THEN 1.0 WHEN 9 THEN 0.5 WHEN 8 THEN 0.25 WHEN 7 THEN 0.125 ELSE 0 END::DOUBLE AS w FROM photos),
sums AS (SELECT name, sighting, sum(CASE WHEN side = 'left' THEN w ELSE 0 END) AS l, sum(CASE WHEN side = 'right' THEN w ELSE 0 END) AS r FROM each GROUP BY 1, 2),
strength AS (SELECT name, sighting, 0.9 * least(l, r) + 0.1 * greatest(l, r) AS strength FROM sums)"""


@query(f"WITH {P} SELECT photo, sighting, name, date, side FROM photos")
def j1_photo_lookup(spark, sf):
    return inputs.photos(spark, sf).select("photo", "sighting", "name", "date", "side")


@query(f"WITH {P} SELECT sighting, name, date, count(*) AS n_photos, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM photos GROUP BY 1, 2, 3")
def g1_sightings(spark, sf):
    p = inputs.photos(spark, sf).groupBy("sighting", "name", "date")
    return p.agg(F.count("*").alias("n_photos"), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("lines"))


@query(f"WITH {PAIRS} SELECT name, sighting FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM pairs) WHERE n > 1")
def g6_eligible_queries(spark, sf):
    return ev.eligible(inputs.pairs(spark, sf).select("name", "sighting"), "name")


@query(f"WITH {PAIRS} SELECT name, count(*) AS usable FROM pairs GROUP BY 1 HAVING usable >= 3")
def g38_split_precondition(spark, sf):
    return cu.usable_individuals(inputs.pairs(spark, sf), 3)


@query(f"WITH {PAIRS} SELECT sighting, 'left' AS side, left_line AS line FROM pairs UNION ALL SELECT sighting, 'right', right_line FROM pairs")
def u2_long_evidence(spark, sf):
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"{side}_line").alias("line")) for side in ("left", "right")])
    return inputs.pairs(spark, sf).select("sighting", F.explode(sides).alias("e")).select("sighting", "e.side", "e.line")


@query(f"WITH {PAIRS} SELECT q.sighting AS query, r.sighting AS other FROM pairs q JOIN pairs r ON q.name = r.name AND q.sighting <> r.sighting")
def j2_held_out_catalog(spark, sf):
    from sightline.operators.retrieval import candidate_pairs

    p = inputs.pairs(spark, sf)
    return candidate_pairs(p.select("name", F.col("sighting").alias("query")), p.select("name", F.col("sighting").alias("other")), ["name"], "query", "other").select("query", "other")


@query(f"WITH {P}, {_TIERS} SELECT name, sighting, tier FROM tiers")
def g16_sighting_tiers(spark, sf):
    return cu.sighting_tiers(inputs.photos(spark, sf))


@query(f"WITH {P}, {_STRENGTH} SELECT name, sighting, round(strength, 6) AS strength FROM strength")
def g17_sighting_strength(spark, sf):
    return rounded(cu.strength_of_sides(inputs.sighting_sides(spark, sf)))


@query(f"WITH {P}, r AS (SELECT name, score, row_number() OVER (PARTITION BY name ORDER BY score DESC) AS n FROM photos) SELECT name, coalesce(max(CASE WHEN n = 3 THEN score END), -1) AS best3 FROM r GROUP BY 1")
def w2_third_best(spark, sf):
    return cu.nth_best(inputs.photos(spark, sf), "name", "score", 3, -1)


_QUEUE = f"""{P}, {_TIERS}, {_STRENGTH}, dec AS (SELECT sighting, name, CASE sighting % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' END AS action FROM photos GROUP BY 1, 2),
t AS (SELECT t.*, s.strength, b.stronger FROM tiers t JOIN strength s ON s.name = t.name AND s.sighting = t.sighting JOIN (SELECT sighting, max(score) AS stronger FROM photos GROUP BY 1) b ON b.sighting = t.sighting),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier DESC, stronger DESC) AS n FROM t),
pr AS (SELECT name, coalesce(max(CASE WHEN n = 5 THEN tier END), -1) AS t5, coalesce(max(CASE WHEN n = 5 THEN stronger END), -1) AS s5, coalesce(max(CASE WHEN n = 3 THEN tier END), -1) AS t3, coalesce(max(CASE WHEN n = 3 THEN stronger END), -1) AS s3, count(*) AS usable FROM n GROUP BY 1 HAVING count(*) >= 3),
dn AS (SELECT name, count(*) FILTER (WHERE action = 'accept') AS accepted, count(*) FILTER (WHERE action = 'reject') AS rejected FROM dec GROUP BY 1),
pe AS (SELECT pr.*, accepted FROM pr JOIN dn ON dn.name = pr.name WHERE accepted < 10 AND usable - rejected >= 3),
q AS (SELECT t.tier, row_number() OVER (PARTITION BY t.tier ORDER BY t5 DESC, s5 DESC, t3 DESC, s3 DESC, here DESC, least(accepted, 3) DESC, t.name, strength DESC, t.sighting) AS place, t.name, t.sighting
  FROM t JOIN pe ON pe.name = t.name JOIN (SELECT name, tier, count(*) AS here FROM t GROUP BY 1, 2) h ON h.name = t.name AND h.tier = t.tier JOIN dec ON dec.sighting = t.sighting WHERE dec.action IS NULL)"""


def review(spark, sf):
    """What is eligible of all sightings, by a log with two decisions for each, of which the second one counts."""
    sides = materialise(inputs.sighting_sides(spark, sf))
    each = sides.select("sighting", "name").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    last = F.when(F.col("sighting") % 7 == 0, "accept").when(F.col("sighting") % 7 == 1, "reject").otherwise("skip")
    return cu.eligible_of_sides(sides, each.withColumn("action", F.when(F.col("seq") == 1, "accept").otherwise(last)))


@query(f"WITH {_QUEUE} SELECT tier, place, name, sighting FROM q")
def l5_review_queue(spark, sf):
    return cu.queue_of(review(spark, sf))


@query(f"WITH {_QUEUE}, cur AS (SELECT tier, max(name) AS active FROM q GROUP BY 1) SELECT q.tier, place, name, sighting FROM q JOIN cur ON cur.tier = q.tier ORDER BY q.tier DESC, (name = active) DESC, place LIMIT 1")
def l4_next_sighting(spark, sf):
    eligible = materialise(review(spark, sf))
    return cu.next_sighting(eligible, eligible.groupBy("tier").agg(F.max("name").alias("name")))


@query(f"WITH {P} SELECT photo, row_number() OVER (ORDER BY md5(concat(photo, '-7')), photo) AS shuffled FROM photos WHERE score >= 5")
def l7_seeded_shuffle(spark, sf):
    return cu.shown_order(inputs.photos(spark, sf).filter("score >= 5").select("photo"), "photo", ["photo"], seed=7).withColumnRenamed("place", "shuffled")


@query(
    f"""WITH {P}, b AS (SELECT name, sighting, date, max(CASE WHEN side = 'left' THEN score / 10.0 END) AS l, max(CASE WHEN side = 'right' THEN score / 10.0 END) AS r FROM photos GROUP BY 1, 2, 3), k AS (SELECT DISTINCT name, date FROM photos WHERE sighting % 3 = 0)
SELECT b.name, count(*) AS n FROM b LEFT JOIN k ON k.name = b.name AND k.date = b.date WHERE k.name IS NOT NULL OR (l > 0.5 AND r > 0.5) GROUP BY 1 HAVING n >= 5"""
)
def g32_qualifying_individuals(spark, sf):
    p = inputs.photos(spark, sf)
    return cu.qualifying_individuals(p, F.col("score") / 10, p.filter("sighting % 3 = 0").select("name", "date"))


@query(f"WITH {P}, e AS (SELECT name, date, count(DISTINCT side) AS sides FROM photos GROUP BY 1, 2) SELECT name, count(*) AS selected, count(*) FILTER (WHERE sides = 2) AS complete, complete BETWEEN 3 AND 5 AND complete = selected AS done FROM e GROUP BY 1")
def g31_pick_summary(spark, sf):
    return cu.pick_summary(inputs.photos(spark, sf))


@query(f"WITH {P} SELECT name, count(*) AS n, count(*) FILTER (WHERE side = 'left') AS n_left, count(*) FILTER (WHERE side = 'right') AS n_right, string_agg(DISTINCT date, ',' ORDER BY date) AS dates, arg_min(photo, (date, photo)) FILTER (WHERE score >= 4) AS thumbnail FROM photos GROUP BY 1")
def g20_catalog_summary(spark, sf):
    shown = F.when(F.col("score") >= 4, F.col("photo"))
    return cu.catalog_summary(inputs.photos(spark, sf), shown).withColumn("dates", F.array_join("dates", ","))


@query(f"WITH {P} SELECT count(*) AS photos, count(DISTINCT sighting) AS sightings, count(DISTINCT name) AS individuals FROM photos")
def g37_catalog_size(spark, sf):
    return inputs.photos(spark, sf).agg(F.count("*").alias("photos"), F.count_distinct("sighting").alias("sightings"), F.count_distinct("name").alias("individuals"))


@query(f"WITH {P} SELECT name FROM photos WHERE sighting % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT side) >= 2")
def u4_covered_individuals(spark, sf):
    p = inputs.photos(spark, sf)
    return cu.covered(p, p.filter("sighting % 3 = 0").select("sighting").distinct(), ["sighting"])


@query(f"WITH {P}, h AS (SELECT photo, side FROM photos WHERE line <= 2 AND sighting % 2 = 0) SELECT photo, date FROM photos p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.photo = p.photo)")
def s16_holdout_gallery(spark, sf):
    p = inputs.photos(spark, sf)
    return p.join(p.filter("line <= 2 AND sighting % 2 = 0").select("photo"), "photo", "left_anti").select("photo", "date")


@query(
    f"""WITH {P}, k AS (SELECT *, row_number() OVER (PARTITION BY sighting ORDER BY photo) AS n FROM photos),
h AS (SELECT * FROM k WHERE n = 1 + sighting % 3 OR n = 2 + sighting % 3), e AS (SELECT sighting FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE side = 'left') = 1 AND count(*) FILTER (WHERE side = 'right') = 1)
SELECT photo, side FROM h WHERE sighting IN (SELECT sighting FROM e)"""
)
def v23_approved_evidence(spark, sf):
    w = Window.partitionBy("sighting").orderBy("photo")
    p = inputs.photos(spark, sf).withColumn("row_index", F.row_number().over(w))
    a = p.filter("row_index = 1 + sighting % 3 OR row_index = 2 + sighting % 3").select("sighting", "row_index", "side")
    return cu.approved_rows(p.select("sighting", "row_index", "side", "photo"), a).select("photo", "side")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high, round(stddev_pop(value), 6) AS sd, round(1000.0::DOUBLE / avg(value), 6) AS per_second FROM events GROUP BY 1""")
def g35_sample_summary(spark, sf):
    return rounded(cu.sample_summary(table(spark, sf, "events"), "event_type", "value"))


@query("SELECT split_part(url, ':', 1) AS reason, count(*) AS n FROM pages GROUP BY 1")
def g23_reason_counts(spark, sf):
    return cu.reason_counts(table(spark, sf, "pages"), "url")


@query("SELECT o_orderkey AS id, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 4)::INT AS part FROM orders")
def w9_round_robin(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return cu.round_robin(o, "id", 4, ["o_orderstatus"]).select("id", "part")


@query(f"WITH {P}, n AS (SELECT photo, name, row_number() OVER (PARTITION BY name ORDER BY photo) AS n FROM photos) SELECT photo, name FROM n WHERE (n - 1) % 5 = 0 AND (n - 1) // 5 < 250")
def w5_systematic_sample(spark, sf):
    return cu.systematic_sample(inputs.photos(spark, sf).select("photo", "name"), "name", "photo", 5, 250)


@query(
    f"""WITH {inputs.EARS_SQL}, f AS (SELECT ear, i, d > 0 AS t FROM depths), k AS (SELECT ear, i, i - row_number() OVER (PARTITION BY ear ORDER BY i) AS g FROM f WHERE t)
SELECT ear, min(i) AS first, max(i) AS last, count(*) AS length FROM k GROUP BY ear, g"""
)
def w7_contiguous_runs(spark, sf):
    e = inputs.ears(spark, sf).select("ear", F.posexplode("depths").alias("i", "d"))
    return cu.runs(e, "ear", "i", F.col("d") > 0)


@query(
    f"""WITH {inputs.EARS_SQL}, f AS (SELECT ear, i, d, d > 0 AS t FROM depths), k AS (SELECT ear, i, d, i - row_number() OVER (PARTITION BY ear ORDER BY i) AS g FROM f WHERE t)
SELECT ear, min(i) AS first, round(max(d), 6) AS depth, max(i) - min(i) AS width, round(sum(d), 6) AS area FROM k GROUP BY ear, g"""
)
def a30_run_measures(spark, sf):
    e = inputs.ears(spark, sf).select("ear", F.posexplode("depths").alias("i", "d"))
    each = cu.runs(e, "ear", "i", F.col("d") > 0).select("ear", "first", "last")
    inside = e.join(each, "ear").filter(F.col("i").between(F.col("first"), F.col("last")))
    return rounded(inside.groupBy("ear", "first").agg(F.max("d").alias("depth"), (F.max("i") - F.min("i")).alias("width"), F.sum("d").alias("area")))


@query("SELECT vec_id, i, max(e) OVER (PARTITION BY vec_id ORDER BY i) AS high FROM (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)")
def w8_running_maximum(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", "i", F.max(F.col("e").cast("double")).over(Window.partitionBy("vec_id").orderBy("i")).alias("high"))


@query(
    """SELECT c_custkey AS id, 'stale' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT o_custkey + 1000000, 'missing' FROM orders WHERE o_orderkey % 1000 = 7"""
)
def u7_mirror_difference(spark, sf):
    existing = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    o = table(spark, sf, "orders")
    desired = o.select(F.col("o_custkey").alias("id")).distinct().unionByName(o.filter("o_orderkey % 1000 = 7").select((F.col("o_custkey") + 1000000).alias("id")))
    return cu.mirror_difference(existing, desired, "id")


@query("SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS date FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def l8_page(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return cu.page(o, ["date", "id"], 50, 2)


@query(f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY sighting, side ORDER BY (score BETWEEN 7 AND 9) DESC, price DESC, photo) AS place FROM photos) SELECT sighting, side, photo, place FROM r WHERE place <= 3")
def w3_top_three(spark, sf):
    w = Window.partitionBy("sighting", "side").orderBy(F.col("score").between(7, 9).desc(), F.col("price").desc(), "photo")
    r = inputs.photos(spark, sf).withColumn("place", F.row_number().over(w).cast("long"))
    return r.filter("place <= 3").select("sighting", "side", "photo", "place")


@query(f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY sighting ORDER BY price DESC, photo) AS place FROM photos) SELECT sighting, photo FROM r WHERE place = 1")
def g13_largest_per_group(spark, sf):
    return tr.largest(inputs.photos(spark, sf), ["sighting"], F.col("price"), "photo").select("sighting", "photo")


@query(f"WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY sighting ORDER BY price DESC, photo) AS place FROM photos) SELECT sighting, max(CASE WHEN place = 1 THEN photo END) AS id, coalesce(max(CASE WHEN place = 1 THEN price END) > 1.5 * max(CASE WHEN place = 2 THEN price END), true) AS clear FROM r WHERE place <= 2 GROUP BY 1")
def g14_dominant_body(spark, sf):
    return tr.dominant(inputs.photos(spark, sf), "sighting", "price", "photo", 1.5)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g24_class_counts(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS overlap FROM customer")
def j16_overlap_flag(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(seen, "id", "left").select("id", F.col("hit").isNotNull().alias("overlap"))


@query(
    """SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN 'analysed' WHEN l.doc_id IS NOT NULL THEN 'precomputed' ELSE 'skipped' END AS origin, coalesce(b.item_id, l.quality) AS value
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def j17_preferred_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("a"))
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("p"))  # noqa: E741
    j = d.join(b, "doc_id", "left").join(l, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("a").isNotNull(), "analysed").when(F.col("p").isNotNull(), "precomputed").otherwise("skipped").alias("origin"), F.coalesce("a", "p").alias("value"))


@query("SELECT source, arg_min(lang, doc_id) FILTER (WHERE lang IS NOT NULL AND lang <> 'en') AS first_lang, count(DISTINCT lang) AS n_langs FROM documents GROUP BY 1")
def g33_first_attributes(spark, sf):
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by(lang, F.when(lang.isNotNull(), F.col("doc_id"))).alias("first_lang"), F.count_distinct("lang").alias("n_langs"))


@query(
    """SELECT source, arg_min(lang, doc_id) FILTER (WHERE lang <> '') AS first, array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)), ',') AS langs,
  array_to_string(list_sort(list(DISTINCT n_chars // 1000)), ',') AS sizes FROM documents GROUP BY 1"""
)
def g33_attribute_lists(spark, sf):
    d = cu.attribute_summary(table(spark, sf, "documents"), "source", "doc_id", F.col("lang"), {"langs": F.col("lang"), "sizes": F.expr("n_chars div 1000")})
    return d.select("source", "first", F.array_join("langs", ",").alias("langs"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"))


@query(f"WITH {inputs.EARS_SQL}, p AS (SELECT side, ear, max(d) AS peak FROM depths GROUP BY 1, 2) SELECT side, round(greatest(0.08, 1.1 * quantile_cont(peak, 0.95)), 6) AS robust, round(1.08 * max(peak), 6) AS whole FROM p GROUP BY 1")
def g34_plot_limits(spark, sf):
    e = inputs.ears(spark, sf).select("side", F.array_max("depths").alias("peak"))
    high = exact_quantiles(e, ["side"], "peak", {"q": 0.95})
    whole = e.groupBy("side").agg((1.08 * F.max("peak")).alias("whole"))
    return rounded(high.join(whole, "side").select("side", F.greatest(F.lit(0.08), 1.1 * F.col("q")).alias("robust"), "whole"))
