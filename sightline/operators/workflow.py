"""Composite jobs: calibration, ranking with evidence, holdouts, packages for review, preparation of ears."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import series as se
from sightline.operators.cohorts import best_of_candidates
from sightline.operators.retrieval import logistic, strength, symmetrised_z, top_n
from sightline.operators.shared import dense_ids, exact_quantiles
from sightline.operators.vectors import best_correlations


def calibration_sample(pairs: DataFrame, query: str, label: str, key: list[str], per_positive: int = 5, seed: int = 42) -> DataFrame:
    """All positives and, for each query, at most per_positive * max(positives, 1) negatives, chosen by a hash."""
    draw = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    positives = F.sum(F.col(label).cast("int")).over(Window.partitionBy(query))
    w = Window.partitionBy(query, label).orderBy(draw)
    marked = pairs.withColumn("_p", positives).withColumn("_r", F.row_number().over(w))
    return marked.filter(F.col(label) | (F.col("_r") <= per_positive * F.greatest(F.col("_p"), F.lit(1)))).drop("_p", "_r")


def fit_calibrator(sample: DataFrame, features: list[str], label: str):
    """A logistic regression of the label on the features; its `transform` adds probability columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = sample.withColumn("_label", F.col(label).cast("double"))
    steps = [VectorAssembler(inputCols=features, outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=50, regParam=1e-3)]
    return Pipeline(stages=steps).fit(data)


def impostor_cuts(pairs: DataFrame, label: str, score: str) -> DataFrame:
    """strong, moderate: the 99th and 90th percentile of the scores of different individuals."""
    return exact_quantiles(pairs.filter(~F.col(label)), [], score, {"strong": 0.99, "moderate": 0.90})


def rank_with_evidence(pairs: DataFrame, owners: DataFrame, n: int = 12) -> DataFrame:
    """query, candidate, score, place, best_pair, strength, confidence.

    pairs: i, j, score in both directions; owners: i, individual.  Scores are standardised in the cohort, the best pair with each other individual is its evidence."""
    z = symmetrised_z(pairs)
    own = owners.select("i", F.col("individual").alias("truth"))
    other = owners.select(F.col("i").alias("j"), F.col("individual").alias("candidate"))
    both = z.join(own, "i").join(other, "j")
    cuts = impostor_cuts(both.withColumn("_same", F.col("truth") == F.col("candidate")), "_same", "z")
    best = both.groupBy(F.col("i").alias("query"), "candidate").agg(F.max(F.round("z", 9)).alias("score"), F.max_by("j", F.struct(F.round("z", 9), -F.col("j"))).alias("best_pair"))
    top = top_n(best, "query", "candidate", n).join(F.broadcast(cuts))
    return top.select("query", "candidate", "score", "place", "best_pair", strength(F.col("score"), F.col("strong"), F.col("moderate")).alias("strength"), logistic(F.col("score")).alias("confidence"))


def ranked_candidates(rows: DataFrame, on: list[str], n: int = 12) -> DataFrame:
    """query, candidate, score, place, best_pair: the candidates of `rank_with_evidence`, from vectors (see `cohorts`) and without a table of pairs."""
    best = best_of_candidates(rows, on).select(F.col("i").alias("query"), "candidate", "score", F.col("j").alias("best_pair"))
    return top_n(best, "query", "candidate", n)


def nearest_identification(pairs: DataFrame) -> DataFrame:
    """Share of series whose most similar other series has the same individual, over individuals with more than one: n, hits, rate.

    pairs: i, j, same, s."""
    w = F.max_by("same", F.struct("s", -F.col("j")))
    return identification(pairs.groupBy("i").agg(w.alias("hit"), F.bool_or("same").alias("possible")))


def identification(each: DataFrame) -> DataFrame:
    """n, hits, rate of the rows (i, hit, possible) that are possible."""
    return each.filter("possible").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("rate"))


def correlation_identification(series: DataFrame, window: int, trim: int, floor: float) -> DataFrame:
    """n, hits, rate, n_above, hits_above, rate_above: how often the series most correlated with one is of the same individual, over individuals with several series, and over those of their
    series alone whose root mean square without the trimmed ends is at least floor.

    series: id, individual, e."""
    owners = series.select("id", "individual", (se.trimmed_rms(F.col("e"), trim, floor).isNotNull()).alias("above"), (F.count("*").over(Window.partitionBy("individual")) > 1).alias("several"))
    best = best_correlations(series, window, trim)
    named = owners.filter("several").join(best, "id", "left").join(owners.select(F.col("id").alias("other"), F.col("individual").alias("found")), "other", "left")
    hit = F.coalesce(F.col("found") == F.col("individual"), F.lit(False))
    both = named.select(hit.alias("hit"), "above").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("rate"),
        F.count_if("above").alias("n_above"), F.count_if(F.col("hit") & F.col("above")).alias("hits_above"), F.avg(F.when(F.col("above"), F.col("hit").cast("double"))).alias("rate_above"),
    )
    return both


def select_holdouts(evidence: DataFrame, ranks: DataFrame, most_rank: int = 2) -> DataFrame:
    """individual, sighting: the first sighting of each individual with both sides, at least two other sightings that cover both sides, and a truth rank of
    at most most_rank.  evidence: individual, sighting, side; ranks: sighting, rank."""
    sides = evidence.groupBy("individual", "sighting").agg(F.size(F.collect_set("side")).alias("sides"))
    whole = F.count_if(F.col("sides") == 2).over(Window.partitionBy("individual"))
    others = sides.withColumn("_n", whole).filter((F.col("sides") == 2) & (F.col("_n") >= 3))
    good = others.join(ranks.filter(F.col("rank") <= most_rank), "sighting", "left_semi")
    return good.groupBy("individual").agg(F.min("sighting").alias("sighting"))


def analysis_package(candidates: DataFrame) -> DataFrame:
    """sighting, left, right (the best three candidates of each side, in order), approvable: both sides have an in-band candidate.

    candidates: sighting, side, id, in_band, size."""
    w = Window.partitionBy("sighting", "side").orderBy(F.col("in_band").desc(), F.col("size").desc(), "id")
    top = candidates.withColumn("place", F.row_number().over(w)).filter("place <= 3")
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("place", "id")))), lambda x: x["id"])
    in_band = lambda side: F.coalesce(F.bool_or(F.when(F.col("side") == side, F.col("in_band"))), F.lit(False))
    return top.groupBy("sighting").agg(listed("left").alias("left"), listed("right").alias("right"), (in_band("left") & in_band("right")).alias("approvable"))


def prepare_ears(photos: DataFrame, detections: DataFrame, landmarks: DataFrame) -> DataFrame:
    """photo, side, detection, stage, message: for each declared side of a photo the largest of its detections whose landmarks show that side; else the
    stage that failed.

    photos: photo, side, readable; detections: photo, id, size, valid (its box lies in the image); landmarks: id, side.  Each photo's detections are looked at once,
    whichever sides are declared; those without landmarks are passed over."""
    marks = landmarks.select("id", F.col("side").alias("seen"))
    found = detections.join(marks, "id", "left")
    broken = detections.groupBy("photo").agg(F.bool_or(~F.col("valid")).alias("broken"))
    best = found.filter(F.col("seen").isNotNull()).groupBy("photo", F.col("seen").alias("side")).agg(F.min_by("id", F.struct(-F.col("size"), "id")).alias("detection"))
    joined = photos.join(broken, "photo", "left").join(best, ["photo", "side"], "left")
    stage = (
        F.when(~F.col("readable"), "photo_retrieval").when(F.col("broken"), "ear_segmentation").when(F.col("detection").isNull(), "declared_ear_resolution")
    )
    message = (
        F.when(stage == "photo_retrieval", "photo cannot be read").when(stage == "ear_segmentation", "a detection's box is not in the image")
        .when(stage == "declared_ear_resolution", F.concat(F.lit("no prepared ear matches inferred side "), "side"))
    )
    return joined.select("photo", "side", F.when(stage.isNull(), F.col("detection")).alias("detection"), stage.alias("stage"), message.alias("message"))


def extend_pairs(pairs: DataFrame, old: DataFrame, new: DataFrame, compare) -> DataFrame:
    """pairs and the pairs of new rows: with old ones in both directions, and among themselves.  compare(a, b) gives i, j, score."""
    return pairs.unionByName(compare(new, old)).unionByName(compare(old, new)).unionByName(compare(new, new).filter(F.col("i") != F.col("j")))


def curvature(contour: DataFrame, radius: float, key: str = "ear") -> DataFrame:
    """key, i, c: the share of the disk's box (side radius) that lies on one side of the contour near each point, from the points within the radius turned
    so that the chord of the outermost ones is level; 0.5 where the point is alone."""
    from sightline.operators.geometry import disk_pairs

    near = disk_pairs(contour, radius, key).select(key, "i", "j")
    at = contour.select(key, F.col("i").alias("j"), "x", "y")
    pts = near.join(at, [key, "j"]).join(contour.select(key, "i", F.col("x").alias("px"), F.col("y").alias("py")), [key, "i"])
    ends = pts.groupBy(key, "i").agg(F.min_by(F.struct("x", "y"), "j").alias("a"), F.max_by(F.struct("x", "y"), "j").alias("b"), F.count("*").alias("n"))
    turned = pts.join(ends, [key, "i"]).withColumn("t", F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    turned = turned.select(key, "i", "j", "n", (dx * F.cos("t") + dy * F.sin("t")).alias("u"), (dy * F.cos("t") - dx * F.sin("t")).alias("v"))
    # the square around the point, clipped in x to the curve; the area under the curve is not clipped in y
    w = Window.partitionBy(key, "i").orderBy("j")
    step = turned.withColumn("du", F.lead("u").over(w) - F.col("u")).withColumn("h", (F.lead("v").over(w) + F.col("v")) / 2 + radius)
    out = step.groupBy(key, "i").agg(F.sum(F.col("du") * F.col("h")).alias("area"), F.greatest(F.min("u"), F.lit(-radius)).alias("lo"), F.least(F.max("u"), F.lit(radius)).alias("hi"), F.first("n").alias("n"))
    share = F.col("area") / ((F.col("hi") - F.col("lo")) * 2 * radius)
    return out.select(key, "i", F.when((F.col("n") > 1) & (F.col("hi") > F.col("lo")), share).otherwise(F.lit(0.5)).alias("c"))


def mirrored(contour: DataFrame, crops: DataFrame, width: float, key: str = "ear") -> DataFrame:
    """key, i, x, y: outlines (key, i, x, y) in their crops (key, x0, y0, x1, side), right ones mirrored inside the crop, scaled to a width."""
    c = contour.join(crops, key)
    x = F.when(F.col("side") == "right", F.col("x0") + F.col("x1") - 1 - F.col("x")).otherwise(F.col("x"))
    ratio = F.lit(float(width)) / (F.col("x1") - F.col("x0"))
    return c.select(key, "i", ((x - F.col("x0") + 0.5) * ratio - 0.5).alias("x"), ((F.col("y") - F.col("y0") + 0.5) * ratio - 0.5).alias("y"))


def gated_peaks(depths, gate: float):
    """ARRAY<STRUCT<i, depth>> of an ARRAY<DOUBLE>: local maxima of at least `gate`, where smaller depths count as 0, that rise at least half the gate above the
    higher of the lowest values between them and a higher value (or the end) on either side.  A flat top counts once, at its middle."""
    core = F.transform(depths, lambda d: F.when(d < gate, F.lit(0.0)).otherwise(d))

    def of(v):
        n = F.size(v)
        at = lambda i: F.get(v, i)
        # from each place, the lowest value before something higher on the left and on the right
        def low(i, ahead):
            side = F.slice(v, i + 2, F.greatest(n - i - 1, F.lit(0))) if ahead else F.reverse(F.slice(v, F.lit(1), i))
            step = lambda s, x: F.when(s["over"] | (x > at(i)), F.struct(F.lit(True).alias("over"), s["low"].alias("low"))).otherwise(F.struct(F.lit(False).alias("over"), F.least(s["low"], x).alias("low")))
            return F.aggregate(side, F.struct(F.lit(False).alias("over"), at(i).alias("low")), step, lambda s: s["low"])

        def top(i):
            left = F.coalesce(at(i - 1), F.lit(float("inf")))
            # the end of the flat part that begins here
            ahead = F.slice(v, i + 2, F.greatest(n - i - 1, F.lit(0)))
            flat = F.aggregate(ahead, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.when(s["on"] & (x == at(i)), F.struct(F.lit(True).alias("on"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(False).alias("on"), s["n"].alias("n"))), lambda s: s["n"])
            right = F.coalesce(at(i + flat + 1), F.lit(float("inf")))
            return F.when((i > 0) & (left < at(i)) & (right < at(i)), F.struct(F.floor(i + flat / 2).cast("int").alias("i"), at(i).alias("depth"), (at(i) - F.greatest(low(i, False), low(i, True))).alias("prominence")))

        tops = F.transform(F.sequence(F.lit(0), n - 1), top)
        return F.filter(tops, lambda t: t.isNotNull() & (t["depth"] >= gate) & (t["prominence"] >= gate / 2))

    return F.transform(of(core), lambda t: F.struct(t["i"], t["depth"]))


def landmark_rays(ears: DataFrame, angles: list[float]) -> DataFrame:
    """ear, ray, ox, oy, dx, dy: rays from the middle of two landmarks (ear, side, ux, uy, lx, ly): 0 degrees towards the upper one, 180 towards the lower one,
    90 towards the flap, which is on the other side for a right ear.  Ears whose landmarks are one point have none."""
    ox, oy = (F.col("ux") + F.col("lx")) / 2, (F.col("uy") + F.col("ly")) / 2
    base = ears.select("ear", "side", ox.alias("ox"), oy.alias("oy"), (F.col("ux") - ox).alias("vx"), (F.col("uy") - oy).alias("vy"))
    base = base.withColumn("d", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).filter("d > 0")
    flip = F.when(F.col("side") == "left", 1.0).otherwise(-1.0)
    base = base.select("ear", "ox", "oy", (F.col("vx") / F.col("d")).alias("vx"), (F.col("vy") / F.col("d")).alias("vy"), flip.alias("f"))
    rays = base.select("*", F.posexplode(F.array(*[F.lit(float(a)) for a in angles])).alias("ray", "a"))
    c, s = F.cos(F.radians("a")), F.sin(F.radians("a")) * F.col("f")
    return rays.select("ear", "ray", "ox", "oy", (c * F.col("vx") - s * F.col("vy")).alias("dx"), (c * F.col("vy") + s * F.col("vx")).alias("dy"))


def crop_annotations(boxes: DataFrame, width: float, height: float, share: float = 0.15) -> DataFrame:
    """id, cw, ch, category, bbox, area, keypoints: annotation rows relative to the padded crop of each box in an image of this size.

    boxes: id, side, x1, y1, x2, y2 and the anchors lx, ly (lower), ux, uy (upper).  Crops are rounded to whole pixels (half to even); the box leaves one
    pixel on each side of the crop; anchors are cut to whole pixels and visible."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    edge = lambda v: F.bround(v, 0).cast("int")
    c = boxes.withColumns(
        {
            "cx1": edge(F.greatest(F.lit(0.0), F.col("x1") - w * share)), "cy1": edge(F.greatest(F.lit(0.0), F.col("y1") - h * share)),
            "cx2": edge(F.least(F.lit(float(width)), F.col("x2") + w * share)), "cy2": edge(F.least(F.lit(float(height)), F.col("y2") + h * share)),
        }
    )
    point = lambda x, y: [F.col(x).cast("int") - F.col("cx1"), F.col(y).cast("int") - F.col("cy1"), F.lit(2)]
    cw, ch = F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1")
    return c.select(
        "id", cw.alias("cw"), ch.alias("ch"), F.when(F.col("side") == "left", 1).otherwise(2).alias("category"), F.array(F.lit(1), F.lit(1), cw - 2, ch - 2).alias("bbox"), (w * h).alias("area"),
        F.array(*point("lx", "ly"), *point("ux", "uy")).alias("keypoints"),
    )


def pose_labels(annotations: DataFrame) -> DataFrame:
    """id, label, valid of annotation rows: class, centre box and key points as shares of the crop with six decimals, and whether class and box pass the check."""
    part = lambda v: F.format_string("%.6f", v)
    b, k, w, h = F.col("bbox"), F.col("keypoints"), F.col("cw"), F.col("ch")
    box = [(b[0] + b[2] / 2) / w, (b[1] + b[3] / 2) / h, b[2] / w, b[3] / h]
    points = [p for i in (0, 3) for p in (part(k[i] / w), part(k[i + 1] / h), k[i + 2].cast("string"))]
    ok = (F.col("category") - 1 >= 0) & F.forall(F.array(*box), lambda v: v.between(0, 1))
    return annotations.select("id", F.concat_ws(" ", (F.col("category") - 1).cast("string"), *map(part, box), *points).alias("label"), F.coalesce(ok, F.lit(False)).alias("valid"))


def run_totals(photos: DataFrame, results: DataFrame, presets: int) -> DataFrame:
    """run, photos, completed, runs, succeeded, failed, interrupted: a row for each run of a batch job over (run, photo) with so many presets.

    results: run, photo, preset, message (null: it succeeded).  A photo is complete when each preset has a result, whatever it says; a run with
    incomplete photos was interrupted.  Repeated results all count; results of photos that the run does not list do not."""
    done = results.groupBy("run", "photo").agg(
        F.count_distinct("preset").alias("presets"), F.count_if(F.col("message").isNull()).alias("good"), F.count_if(F.col("message").isNotNull()).alias("bad")
    )
    got = photos.select("run", "photo").distinct().join(done, ["run", "photo"], "left").groupBy("run")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = got.agg(F.count("*").alias("photos"), F.count_if(F.col("presets") == presets).alias("completed"), total("good").alias("succeeded"), total("bad").alias("failed"))
    return out.withColumns({"runs": F.col("photos") * presets, "interrupted": F.col("completed") < F.col("photos")})


def run_failures(results: DataFrame) -> DataFrame:
    """run, place (from 1), photo, preset, message: the failed results of each run in the order of photo, preset and message.

    Failures are numbered in range partitions, and a run's numbers start after those of the runs before it, so that a run of very many failures is no task of its own."""
    columns = ["run", "photo", "preset", "message"]
    n = dense_ids(results.filter("message IS NOT NULL").select(*columns), columns, "_at")
    first = n.groupBy("run").agg(F.min("_at").alias("_first")).withColumnRenamed("run", "_run")
    return n.join(first, F.col("run").eqNullSafe(F.col("_run"))).select("run", (F.col("_at") - F.col("_first") + 1).alias("place"), "photo", "preset", "message")
