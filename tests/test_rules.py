"""Rules of queues, runs, boxes, comparisons and augmentation against plain definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import scalar as sc
from sightline.operators import curation, geometry, retrieval, training, workflow
from sightline.operators.shared import exact_quantiles


def review_tables(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{s % 7}", s, side, f"{s}-{side}-{k}", r.choice([7, 8, 8, 9, 10])) for s in range(70) for side in ("left", "right") for k in range(r.randrange(3))]
    log = [(s, f"n{s % 7}", r.choice(["accept", "reject", "skip"]), k) for k, s in enumerate(r.choices(range(70), k=50))]
    return spark.createDataFrame(rows, "name string, sighting long, side string, photo string, score int"), spark.createDataFrame(log, "sighting long, name string, action string, seq long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_next_sighting_is_the_head_of_the_queue(spark, seed):
    tables = review_tables(spark, seed)
    eligible = curation.eligible_sightings(*tables)
    queue = sorted((-r.tier, r.place, r.name, r.sighting) for r in curation.review_queue(*tables).collect())
    top = [r for r in queue if r[0] == queue[0][0]]
    current = lambda rows: spark.createDataFrame(rows, "tier int, name string")
    as_row = lambda r: (-r.tier, r.place, r.name, r.sighting)
    assert as_row(curation.next_sighting(eligible, current([])).first()) == top[0]
    assert as_row(curation.next_sighting(eligible, current([(-top[0][0], "nobody")])).first()) == top[0]
    for name in {r[2] for r in top}:
        assert as_row(curation.next_sighting(eligible, current([(-top[0][0], name), (3, "n1")])).first()) == next(r for r in top if r[2] == name)
    assert curation.next_sighting(eligible.limit(0), current([])).count() == 0


@pytest.mark.parametrize("cell", [1, 16, 256, 10_000])
def test_overlaps_of_runs_equal_pixels(spark, cell):
    r = random.Random(cell)
    rows, pixels = [], {}
    for photo in range(3):
        for mask in range(5):
            at = 0
            for _ in range(6):
                at += r.randrange(1, 60)
                n = r.choice([0, 1, 5, 40, 300])
                rows.append((f"m{photo}{mask}", photo, at, n))
                pixels.setdefault((photo, f"m{photo}{mask}"), set()).update(range(at, at + n))
                at += n
    runs = spark.createDataFrame(rows, "mask string, photo long, start long, length long")
    got = {(x.a, x.b): x.pixels for x in geometry.run_overlaps(runs, cell=cell).collect()}
    assert got == {(a, b): len(p & q) for (f, a), p in pixels.items() for (g, b), q in pixels.items() if f == g and a < b and p & q}
    body = F.substring("mask", 3, 1) == "0"
    found = {x.mask: (x.body, x.share) for x in geometry.shares_on(runs.filter(~body), runs.filter(body), 0.1, cell=cell).collect()}
    want = {a: (f"m{f}0", len(p & pixels[f, f"m{f}0"]) / len(p)) for (f, a), p in pixels.items() if not a.endswith("0") and p}
    assert found == {a: v for a, v in want.items() if v[1] > 0.1}


def test_boxes_with_coordinates_that_are_not_finite(spark):
    values = [(1.5, 1.0, 9.0, 4.0), (math.nan, 1.0, 9.0, 4.0), (1.0, 1.0, math.nan, 4.0), (1.0, 1.0, math.inf, 4.0), (-math.inf, 1.0, 9.0, 4.0), (None, 1.0, 9.0, 4.0), (9.0, 1.0, 1.0, 4.0), (1.0, 1.0, 1.0, 4.0)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double")
    got = df.select(sc.clip_box(*[F.col(c) for c in "abcd"], 10, 5).alias("box"), sc.box_fault(*[F.col(c) for c in "abcd"]).alias("fault")).collect()
    assert tuple(got[0].box) == (1, 1, 9, 4) and got[0].fault is None
    assert all(r.box is None for r in got[1:])
    assert all("finite" in r.fault for r in got[1:6]) and all("positive" in r.fault for r in got[6:])


def test_comparison_refuses_ears_that_differ_in_scales_or_lengths(spark):
    ddl = "ear string, sighting string, side string, profiles array<struct<depths array<double>, start double, end double>>"
    ear = lambda name, *lengths: spark.createDataFrame([(name, name, "left", [([0.1] * n, 5.0, 175.0) for n in lengths])], ddl)
    settings = retrieval.Comparison(bins=20, stretch_steps=0, shift_fraction=0.0)
    assert retrieval.block_similarities(ear("a", 30), ear("b", 30), settings).count() == 1
    for left, right in ((ear("a", 30), ear("b", 30, 30)), (ear("a", 30), ear("b", 31)), (ear("a"), ear("b")), (ear("a", 1), ear("b", 1))):
        with pytest.raises(ValueError, match="scales"):
            retrieval.block_similarities(left, right, settings)


def test_flips_of_chosen_splits_get_ids_and_names_of_their_own(spark):
    images = spark.createDataFrame([(1, "a.b.jpg", 100, "train"), (4, "c", 50, "train"), (9, "d.png", 60, "test")], "image_id long, file_name string, width int, split string")
    notes = spark.createDataFrame([(7, 4, 10.0, 1.0, 5.0, 2.0, [10.0, 1.0, 2.0, 30.0, 1.0, 0.0]), (3, 1, 99.0, 1.0, 5.0, 2.0, []), (8, 9, 1.0, 1.0, 1.0, 1.0, [])], "id long, image_id long, x double, y double, w double, h double, keypoints array<double>")
    im, an = training.flip_images(images, notes, ["train"])
    assert sorted((r.image_id, r.file_name) for r in im.collect()) == [(1, "a.b.jpg"), (4, "c"), (5, "a.b_flip.jpg"), (6, "c_flip"), (9, "d.png")]
    new = {r.id: r for r in an.collect() if r.id not in (3, 7, 8) or r.image_id not in (1, 4, 9)}
    assert {(i, r.image_id, r.x, tuple(r.keypoints)) for i, r in new.items()} == {(8, 5, 0.0, ()), (9, 6, 34.0, (39.0, 1.0, 2.0, 30.0, 1.0, 0.0))}
    every, _ = training.flip_images(images, notes)
    assert every.count() == 6 and every.filter("split = 'test'").agg(F.max("image_id")).first()[0] == 10


def test_samples_in_turn_and_capped(spark):
    items = spark.createDataFrame([("ab"[k % 2], k) for k in range(100)], "g string, k long")
    got = sorted((r.g, r.k) for r in curation.systematic_sample(items, "g", "k", 5, 3).collect())
    assert got == [("a", 0), ("a", 10), ("a", 20), ("b", 1), ("b", 11), ("b", 21)]
    assert {(r.k, r.part) for r in curation.round_robin(items, "k", 4, ["g"]).collect()} == {(k, k // 2 % 4) for k in range(100)}
    q = exact_quantiles(items, ["g"], "k", {"lo": 0.0, "mid": 0.5, "hi": 0.95, "top": 1.0}, nearest_rank=True).collect()
    assert {(r.g, r.lo, r.mid, r.hi, r.top) for r in q} == {("a", 0, 48, 94, 98), ("b", 1, 49, 95, 99)}


@pytest.mark.parametrize("seed", [1, 2])
def test_shapes_apart_equal_the_greedy_choice(spark, seed):
    r = random.Random(seed)
    rows = [(g, k, float(r.choice([0, 5, 5, 7, r.randrange(1, 50)])), r.uniform(-30, 30), r.uniform(-30, 30)) for g in range(3) for k in range(60)] + [(9, 1, 5.0, None, 1.0)]
    rows += [(7, k, 100.0 - k, 7.0 * k, 0.0) for k in range(12)]  # a chain, where each is near the one before
    kept = {}
    for g, k, area, x, y in sorted(rows, key=lambda t: (-t[2], t[1])):
        if area > 0 and x is not None and all(math.hypot(x - a, y - b) >= 8.0 for _, a, b in kept.setdefault(g, [])):
            kept[g].append((k, x, y))
    got = training.apart(spark.createDataFrame(rows, "photo long, id long, area double, cx double, cy double"), "photo", 8.0).collect()
    assert sorted((x.photo, x.id) for x in got) == sorted((g, k) for g, v in kept.items() for k, _, _ in v)


def test_best_correlations_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    from sightline.operators import vectors, workflow

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    r = np.random.default_rng(1)
    e = r.normal(size=(11, 20))
    e[3] = np.roll(e[8], 2)
    e[5] = 1.0
    e[9] = e[8]
    df = spark.createDataFrame([(i, f"n{i % 4}", [float(x) for x in v]) for i, v in enumerate(e)], "id long, individual string, e array<double>")
    got = {x.id: (x.other, x.corr, x.lag) for x in vectors.best_correlations(df, 3, 2).collect()}
    hits = {}
    for i in range(11):
        found = [(-round(float(np.corrcoef(e[i][2:-2], np.roll(e[j], -s)[2:-2])[0, 1]), 9), j, s) for j in range(11) for s in range(-3, 4) if i != j and 5 not in (i, j)]
        if found:
            c, j, s = min(found)
            assert got[i] == (j, pytest.approx(-c, abs=1e-9), s)
        hits[i] = bool(found) and min(found)[1] % 4 == i % 4
    assert 5 not in got
    rms = [math.sqrt(float((v[2:-2] ** 2).mean())) for v in e]
    x = workflow.correlation_identification(df, 3, 2, 1.0).first()
    above = [i for i in range(11) if rms[i] >= 1.0]
    assert (x.n, x.hits, x.n_above, x.hits_above) == (11, sum(hits.values()), len(above), sum(hits[i] for i in above))


def test_bootstrap_in_blocks_draws_the_same(spark, monkeypatch):
    from sightline.operators import evaluation

    ranks = spark.createDataFrame([(f"n{k % 13}", 1 + k * 7 % 5) for k in range(50)], "truth string, rank long")
    one = evaluation.bootstrap(ranks, "truth", samples=300).first()
    monkeypatch.setattr(evaluation, "BLOCK_GROUPS", 3)
    monkeypatch.setattr(evaluation, "SAMPLE_RANGES", 7)
    two = evaluation.bootstrap(ranks, "truth", samples=300).first()
    assert tuple(one) == pytest.approx(tuple(two)) and one.micro_low < one.micro_high


def test_uploads_that_share_no_side_are_a_fault(spark):
    from sightline.functions import series as se

    rows = [(1, "left", 2, [9.0] * 4), (1, "left", 1, [1.0, 0.0, 2.0, 0.0]), (2, "left", 5, [1.0, 0.0, 2.0, 0.0]), (2, "right", 1, [0.0] * 4), (3, "right", 1, [1.0] * 4)]
    uploads = spark.createDataFrame(rows, "upload long, side string, place int, depths array<double>")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    got = {(r.a, r.b): (r.side, r.similarity, r.fault) for r in retrieval.shared_sides(uploads, pairs, se.angle_weights(4)).collect()}
    assert got[1, 2] == ("left", pytest.approx(1.0), None) and got[2, 3] == ("right", 0.0, None)
    assert got[1, 3][:2] == (None, None) and "share no side" in got[1, 3][2]


def test_first_attribute_and_lists(spark):
    rows = spark.createDataFrame([("a", 1, "", 3), ("a", 2, None, 1), ("a", 3, "f", 3), ("b", 1, None, None)], "name string, k int, code string, year int")
    got = {r.name: (r.first, r.years) for r in curation.attribute_summary(rows, "name", "k", F.col("code"), {"years": F.col("year")}).collect()}
    assert got == {"a": ("f", [1, 3]), "b": (None, [])}


def test_grown_labels_have_areas_and_points_by_height(spark):
    rows = [(100.0, 50.0, 300.0, 250.0, (20.0, 10.0, 2), (260.0, 240.0, 1)), (10.0, 8.0, 110.0, 58.0, (5.0, 90.0, 2), (-3.0, 4.0, 0)), (0.0, 0.0, 4.0, 4.0, (1.0, 2.0, 2), (3.0, 2.0, 1))]
    point = "struct<x: double, y: double, seen: int>"
    df = spark.createDataFrame(rows, f"x1 double, y1 double, x2 double, y2 double, a {point}, b {point}").coalesce(1)
    label = sc.grown_label([F.col(c) for c in ("x1", "y1", "x2", "y2")], [(F.col(f"{p}.x"), F.col(f"{p}.y")) for p in "ab"])
    got = df.select(label.alias("g"), sc.by_height(F.col("a"), F.col("b")).alias("k")).collect()
    for (x1, y1, x2, y2, a, b), r in zip(rows, got):
        left, top = min(x1, (x2 - x1) * 0.15), min(y1, (y2 - y1) * 0.15)
        w = max(x2 - x1 + left, a[0], b[0]) - min(left, a[0], b[0])
        h = max(y2 - y1 + top, a[1], b[1]) - min(top, a[1], b[1])
        assert (r.g.w, r.g.h, r.g.area) == pytest.approx((w, h, w * h), abs=1e-3)
    assert [[tuple(p) for p in r.k] for r in got] == [[rows[0][5], rows[0][4]], [rows[1][4], rows[1][5]], [rows[2][5], rows[2][5]]]


def test_runs_are_summed_up_with_their_failures_in_order(spark):
    photos = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 4), ("c", 5)], "run string, photo long")
    log = [("a", 1, "x", None), ("a", 1, "y", "late"), ("a", 2, "x", "gone"), ("a", 2, "x", "gone"), ("b", 4, "x", None), ("b", 4, "y", None), ("a", 9, "x", "odd"), (None, 1, "x", "lost")]
    results = spark.createDataFrame(log, "run string, photo long, preset string, message string")
    columns = ("photos", "completed", "runs", "succeeded", "failed", "interrupted")
    totals = {r.run: tuple(r[c] for c in columns) for r in workflow.run_totals(photos, results, 2).collect()}
    assert totals == {"a": (3, 1, 6, 1, 3, True), "b": (1, 1, 2, 2, 0, False), "c": (1, 0, 2, 0, 0, True)}
    failures = sorted(map(tuple, workflow.run_failures(results).collect()), key=lambda r: (r[0] or "", r[1]))
    assert failures == [(None, 1, 1, "x", "lost"), ("a", 1, 1, "y", "late"), ("a", 2, 2, "x", "gone"), ("a", 3, 2, "x", "gone"), ("a", 4, 9, "x", "odd")]
    assert workflow.run_failures(results.limit(0)).count() == 0 and workflow.run_totals(photos.limit(0), results, 2).count() == 0


def test_rows_are_copied_for_few_blocks_however_many_rows(spark, monkeypatch):
    import pyarrow as pa

    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 1)
    monkeypatch.setattr(vectors, "GROUPS", 9)
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(60)], "id long, g int, e array<double>")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])

    def prepare(r):
        return lambda q: ([len(q["id"])], [len(r["id"])], [float((q["e"] @ r["e"].T).sum())])

    for on, total, most in (([], sum(i * j + 1.0 for i in range(60) for j in range(60)), 9), (["g"], sum(i * j + 1.0 for i in range(60) for j in range(60) if (i - j) % 2 == 0), 18)):
        got = vectors.block_join(df, df, on, prepare, schema, "a long, b long, s double", sent=1).collect()
        assert len(got) <= most and sum(x.a * x.b for x in got) == (3600 if not on else 1800) and sum(x.s for x in got) == pytest.approx(total)


def test_rows_for_each_pair_are_sent_as_they_come_and_leave_blocks_large(spark, monkeypatch):
    import pyarrow as pa

    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 1)
    monkeypatch.setattr(vectors, "GROUPS", 9)
    monkeypatch.setattr(vectors, "SENT_ROWS", 16)  # what a task may hold of its rows
    monkeypatch.setattr(vectors, "TILE_PAIRS", 12)
    monkeypatch.setattr(vectors, "BATCH_ROWS", 3)
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(60)], "id long, g int, e array<double>")
    schema = pa.schema([("task", pa.int64()), ("rows", pa.int64()), ("g", pa.int32())])

    def prepare(r):
        return lambda q: ([int(r["_b"][0]) * 100 + int(q["_a"][0])], [len(r["id"]) * len(q["id"])], [int(r["g"][0])])

    parts = vectors.block_join(df, df, ["g"], prepare, schema, "task long, rows long, g int").collect()
    assert sum(x.rows for x in parts) == 1800 and len({(x.g, x.task) for x in parts}) <= 18 < len(parts)
    for rows in (1, 7):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
        monkeypatch.setattr(vectors, "GROUPS", 9 if rows > 1 else 10_000)  # blocks of a row, and those that no row is in
        for on in ([], ["g"]):
            got = [tuple(x) for x in vectors.pair_scores(df, df.filter("id < 23"), on).collect()]
            assert sorted(got) == [(i, j, i * j + 1.0) for i in range(60) for j in range(23) if i != j and (not on or (i - j) % 2 == 0)]


def test_nearest_vectors_with_copies_and_small_tiles(spark, monkeypatch):
    import numpy as np

    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_PAIRS", 20)
    e = np.random.default_rng(5).integers(0, 3, (31, 3)).astype(float)
    got = {(x.query, x.nn): (x.other, x.distance) for x in vectors.nearest_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "id long, e array<double>"), 4).collect()}
    for i in range(31):
        near = sorted((round(float(np.sqrt(((e[i] - e[j]) ** 2).sum())), 9), j) for j in range(31) if j != i)[:4]
        assert [got[i, n + 1] for n in range(4)] == [(j, d) for d, j in near]


def test_equal_vectors_are_nothing_apart_and_no_pair_is_taken_for_nearer_by_rounding(spark, monkeypatch):
    import numpy as np

    from sightline.operators import vectors

    monkeypatch.setattr(vectors, "STRIPE", 8)
    monkeypatch.setattr(vectors, "EXACT_PAIRS", 5)
    r = np.random.default_rng(7)
    e = r.normal(size=(40, 64))
    e = np.concatenate([e, e, e[:10] + 1e-7 * r.normal(size=(10, 64)), 1e20 * e[:1]])
    for last in (90, 91):  # with a vector too long for single precision, and without
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e[:last])], "id long, e array<double>")
        got = {(x.query, x.nn): (x.other, x.distance) for x in vectors.nearest_vectors(df, 2).collect()}
        assert len(got) == 2 * last
        if last == 90:
            assert all(got[i, 1] == ((i + 40) % 80, 0.0) for i in range(80))
            assert all(got[i, 2][0] == 80 + i % 40 for i in range(80) if i % 40 < 10)
