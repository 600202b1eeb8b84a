"""Kernels and metrics on planted data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import scalar as sc
from sightline.functions import series as se
from sightline.operators import checks, curation, evaluation, incremental, matchers, retrieval, training, workflow
from sightline.operators import geometry as ge
from sightline.operators.shared import exact_quantiles


def triangle(bins, peaks, half=10):
    x = np.arange(bins)
    return [float(max(0.0, max(d * (1 - abs(i - p) / half) for p, d in peaks))) for i in x]


def ears(spark, series, start=5.0, end=175.0):
    rows = [(str(i), str(s), "left", [(d, start, end)]) for i, (s, d) in enumerate(series)]
    return spark.createDataFrame(rows, "ear string, sighting string, side string, profiles array<struct<depths array<double>, start double, end double>>")


def similarity(spark, a, b, settings=retrieval.Comparison()):
    q, r = ears(spark, [("q", a)]), ears(spark, [("r", b)])
    x = retrieval.block_similarities(q, r, settings).first()
    return x.similarity, x.stretch, x.shift


def test_closed_forms(spark):
    one = triangle(720, [(120, 0.05)])
    assert similarity(spark, one, one) == (pytest.approx(1.0), 1.0, 0)
    assert similarity(spark, one, triangle(720, [(600, 0.05)])) == (0.0, 1.0, 0)
    # a fourfold depth halves the similarity
    identity = retrieval.Comparison(shift_fraction=0.0, stretch_steps=0, gradient_weight=0.0)
    got, _, _ = similarity(spark, triangle(720, [(360, 0.02)]), triangle(720, [(360, 0.08)]), identity)
    assert got == pytest.approx(0.5)


def test_shift_is_found_and_scale_free(spark):
    a, b = triangle(720, [(300, 0.05), (400, 0.03)]), triangle(720, [(330, 0.05), (430, 0.03)])
    got, stretch, shift = similarity(spark, a, b)
    assert (stretch, shift) == (1.0, 10) and got > 0.9
    twice, *_ = similarity(spark, [2 * x for x in a], [2 * x for x in b])
    assert twice == pytest.approx(got)


@pytest.mark.parametrize("size", [1.0, 1e-60, 1e60])
def test_alignments_that_may_be_best_are_compared_exactly(spark, monkeypatch, size):
    for name, value in {"ALIGNED": 1 << 11, "CHUNK": 3, "LEAST_BLOCK": 4, "MOST_BLOCK": 7}.items():
        monkeypatch.setattr(retrieval, name, value)
    settings = retrieval.Comparison(bins=12, stretch_steps=3)
    r = np.random.default_rng(3)
    series = [[np.where(r.random(n) < 0.3, r.uniform(-1, 9, n), 0.0) * size for n in (12, 20)] for _ in range(20)]
    series[3] = series[5] = [np.zeros(12), np.zeros(20)]
    series[8] = series[9] = [np.ones(12) * size, np.ones(20) * size]
    spans = [(float(k % 3 * 20), 180.0 - k % 2 * 30) for k in range(20)]
    rows = [(str(k), str(k // 2), "left" if k % 5 else "right", [(d.tolist(), *spans[k]) for d in series[k]]) for k in range(20)]
    frame = spark.createDataFrame(rows, "ear string, sighting string, side string, profiles array<struct<depths array<double>, start double, end double>>")
    got = {(int(x.query_ear), int(x.ear)): (x.similarity, x.stretch, x.shift) for x in retrieval.block_similarities(frame, frame, settings).collect()}
    line, weight = np.arange(12) / 11, np.exp(-0.5 * ((np.arange(12) * 180 / 11 - 120) / 35) ** 2)

    def channels(d, start, end):
        d, angle, g = np.maximum(d, 0), np.arange(len(d)) * 180 / (len(d) - 1), np.zeros(len(d))
        inside = (angle > start) & (angle < end)
        g[inside] = np.gradient(d[inside])
        return [np.interp(line * (len(d) - 1), np.arange(len(d)), x) for x in (np.sqrt(d), np.sign(g) * np.sqrt(np.abs(g)))]

    def moved(x, t, b):
        p = ((line - 0.5) / t + 0.5) * 11
        x = np.where((p < 0) | (p > 11), 0.0, np.interp(p, np.arange(12), x))
        return np.array([x[i - b] if 0 <= i - b < 12 else 0.0 for i in range(12)])

    def alike(x, y):
        both, apart = weight @ (np.abs(x) + np.abs(y)), weight @ np.abs(x - y)
        return (both - apart) / (both + apart) if both + apart > 0 else 0.0

    c = [[channels(d, *spans[k]) for d in series[k]] for k in range(20)]
    want = {(i, j) for i in range(20) for j in range(20) if i // 2 != j // 2 and (i % 5 > 0) == (j % 5 > 0)}
    assert got.keys() == want
    for i, j in want:
        value = {
            (t, b): np.mean([(alike(moved(x[0], t, b), y[0]) + alike(moved(x[1], t, b) * t**-0.5, y[1])) / 2 for x, y in zip(c[i], c[j])]) * math.exp(-((abs(b) / 12 / 0.16) ** 4)) * math.exp(-((abs(math.log(t)) / 0.32) ** 4))
            for t, b in settings.alignments()
        }
        best = max(value.values())
        top, t, b = got[i, j]
        assert top == pytest.approx(best, abs=1e-12) and (value[t, b] == pytest.approx(best, abs=1e-12) if best > 1e-12 else (t, b) == (1.0, 0))


def test_kernel_equals_columns(spark):
    r = np.random.default_rng(42)
    a, b = r.uniform(-0.02, 0.1, 73).tolist(), r.uniform(-0.03, 0.1, 73).tolist()
    settings = retrieval.Comparison(bins=40, shift_fraction=0.05, stretch_steps=2)
    got, *_ = similarity(spark, a, b, settings)
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    channel = lambda c: (se.depth_channel(F.col(c), 40), se.gradient_channel(F.col(c), F.lit(5.0), F.lit(175.0), 40))
    (ad, ag), (bd, bg) = channel("a"), channel("b")
    rows = df.select(ad.alias("ad"), ag.alias("ag"), bd.alias("bd"), bg.alias("bg"))
    al = spark.createDataFrame(settings.alignments(), "t double, s int")
    moved = lambda c: se.shift(se.stretch(F.col(c), F.col("t")), F.col("s"))
    w = se.angle_weights(40)
    score = (0.5 * se.weighted_jaccard(moved("ad"), F.col("bd"), w) + 0.5 * se.weighted_jaccard(F.transform(moved("ag"), lambda x: x * F.pow("t", F.lit(-0.5))), F.col("bg"), w)) * F.exp(
        -F.pow(F.abs("s") / 40 / 0.16, F.lit(4.0))
    ) * F.exp(-F.pow(F.abs(F.log("t")) / 0.32, F.lit(4.0)))
    assert rows.crossJoin(al).agg(F.max(score)).first()[0] == pytest.approx(got, abs=1e-12)


def test_log_mean_exp_lies_between_mean_and_max(spark):
    df = spark.createDataFrame([("q", x) for x in (0.1, 0.5, 0.9, -700.0)], "k string, similarity double")
    got = retrieval.side_scores(df, ["k"]).first().score
    assert got == pytest.approx(0.9 + 0.05 * (math.log(1 + math.exp(-8) + math.exp(-16)) - math.log(4))) and got < 0.9


def test_planted_ranks(spark):
    scores = []
    for q, (truth, rank) in enumerate([("Ada", 1), ("Ada", 3), ("Bea", 2), ("Bea", 2)]):
        others = [n for n in ("Ada", "Bea", "Cia", "Dot") if n != truth]
        order = others[: rank - 1] + [truth] + others[rank - 1 :]
        scores += [(q, truth, c, float(-i)) for i, c in enumerate(order)]
    df = spark.createDataFrame(scores, "query int, truth string, candidate string, score double")
    ranks = evaluation.truth_ranks(df, "query", "candidate", "truth")
    m = evaluation.micro(ranks).first()
    assert (m.top1, m.top3, m.mrr) == (0.25, 1.0, pytest.approx(7 / 12))
    b = evaluation.bootstrap(ranks, "truth", samples=2000).first()
    assert (b.micro_low, b.micro_high) == (pytest.approx(0.5), pytest.approx(2 / 3))


def test_a_missing_or_endless_truth_fails(spark):
    schema = "query int, truth string, candidate string, score double"
    for rows in ([(1, "a", "b", 0.5)], [(1, "a", "a", float("nan")), (1, "a", "b", 0.5)], [(1, "a", "a", 0.1), (1, "a", "b", float("inf"))], [(1, "a", "a", None)]):
        with pytest.raises(Exception, match="no finite score"):
            evaluation.truth_ranks(spark.createDataFrame(rows, schema), "query", "candidate", "truth").collect()


def planted_benchmark(spark):
    """Five sightings of Ada, two of Bea, and one each of two others, who are candidates only."""
    vectors = {"Ada": [1.0, 0.0, 0.0], "Bea": [0.0, 1.0, 0.0], "Cia": [0.0, 0.0, 1.0], "Dot": [0.6, 0.8, 0.0]}
    rows = [(name, 10 * i + j, [x + 0.001 * j for x in vectors[name]]) for i, (name, n) in enumerate((("Ada", 5), ("Bea", 2), ("Cia", 1), ("Dot", 1))) for j in range(n)]
    return spark.createDataFrame(rows, "name string, sighting long, e array<double>")


def test_evaluation_of_registered_matchers(spark):
    seen = []

    def spy(queries, catalog):
        seen.append((queries.columns, {r.candidate for r in catalog.collect()}))
        return evaluation.MATCHERS["vectors"](queries, catalog)

    got = evaluation.evaluate(planted_benchmark(spark), spy, samples=500)
    assert got.ranks.count() == 7 and got.micro.first().top1 == 1.0 and got.macro.first().n_groups == 2
    assert got.scores.count() == 28 and got.intervals.first().micro_low == 1.0
    assert "name" not in seen[0][0] and len(seen[0][1]) == 4 and not seen[0][1] & {"Ada", "Bea", "Cia", "Dot"}
    assert {"vectors", "votes", "aligned"} <= set(evaluation.MATCHERS)
    assert evaluation.evaluate(planted_benchmark(spark), "votes", samples=10).micro.first().top1 == 1.0
    with pytest.raises(checks.IntegrityError):
        evaluation.evaluate(planted_benchmark(spark), lambda q, c: spy(q, c).limit(27))
    with pytest.raises(ValueError, match="no eligible query"):
        evaluation.evaluate(planted_benchmark(spark).filter("name in ('Cia', 'Dot')"), "vectors")


def test_evaluation_by_alignment(spark):
    shapes = {"Ada": [(120, 0.05)], "Bea": [(300, 0.05)], "Cia": [(500, 0.04)]}
    rows = [(n, f"{n}{j}", [(side, [(triangle(720, [(p + 4 * j, d) for p, d in peaks]), 5.0, 175.0)]) for side in ("left", "right")]) for n, peaks in shapes.items() for j in range(2)]
    df = spark.createDataFrame(rows, "name string, sighting string, ears array<struct<side string, profiles array<struct<depths array<double>, start double, end double>>>>")
    small = matchers.aligned_with(retrieval.Comparison(bins=48, stretch_steps=1))
    assert evaluation.evaluate(df, small, samples=10).micro.first().mrr == 1.0


def test_producers_store_only_what_they_settled_on(spark):
    ears = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "ear long, raw array<double>")
    settings = matchers.Extraction(scales=(1.0, 0.5))
    compute = F.array(F.col("raw"), F.transform("raw", lambda x: x / 2))
    stored = spark.createDataFrame([(1, "a", [1.0, 0.5], [[9.0], [9.0]]), (2, "a", [0.5, 1.0], [[9.0], [9.0]])], "ear long, slug string, scales array<double>, profiles array<array<double>>")
    rows, new = matchers.Producer("a", settings, compute).profiles(ears, stored)
    assert {r.ear: r.profiles[0] for r in rows.collect()} == {1: [9.0], 2: [3.0, 4.0]} and [r.ear for r in new.collect()] == [2]
    rows, new = matchers.Producer(None, settings, compute).profiles(ears, stored)
    assert {r.ear: r.profiles[0] for r in rows.collect()} == {1: [1.0, 2.0], 2: [3.0, 4.0]} and new.count() == 0
    with pytest.raises(ValueError):
        matchers.Extraction(trim_degrees=95.0)


def test_exact_quantiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    values = [("a", float(x)) for x in r.normal(size=301)] + [("b", float(x)) for x in r.integers(0, 4, 40)] + [("c", 2.5), ("c", None)]
    got = {x.g: x for x in exact_quantiles(spark.createDataFrame(values, "g string, v double"), ["g"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95}).collect()}
    for g in "abc":
        own = [v for k, v in values if k == g and v is not None]
        assert (got[g].low, got[g].mid, got[g].high) == pytest.approx(tuple(np.quantile(own, [0.05, 0.5, 0.95])))


def test_straight_and_bent_curvature(spark):
    line = [(1, i, i * 0.6, i * 0.8) for i in range(11)]
    roof = [(2, i, float(i), float(-abs(i - 5))) for i in range(11)]
    got = {(r.ear, r.i): r.c for r in workflow.curvature(spark.createDataFrame(line + roof + [(3, 0, 0.0, 0.0)], "ear int, i int, x double, y double"), 3.0).collect()}
    assert got[1, 5] == pytest.approx(0.5) and got[3, 0] == 0.5
    # a right angle at the middle point: the points within the radius are two on each side, level ends two below the tip
    assert got[2, 5] == pytest.approx(((-2 - 1) / 2 + (-1 - 0) / 2) * 2 / (4 * 6) + 0.5)


def peaks_by_definition(v, gate):
    core = [0.0 if x < gate else x for x in v]
    out, i = [], 1
    while i < len(core) - 1:
        j = i
        while j + 1 < len(core) and core[j + 1] == core[i]:
            j += 1
        if core[i - 1] < core[i] and j + 1 < len(core) and core[j + 1] < core[i]:
            lows = []
            for side in (range(i - 1, -1, -1), range(j + 1, len(core))):
                low = core[i]
                for k in side:
                    if core[k] > core[i]:
                        break
                    low = min(low, core[k])
                lows.append(low)
            if core[i] >= gate and core[i] - max(lows) >= gate / 2:
                out.append(((i + j) // 2, core[i]))
        i = j + 1
    return out


def test_gated_peaks(spark):
    r = np.random.default_rng(12)
    rows = [(k, [float(x) for x in r.integers(0, 9, 40)]) for k in range(40)] + [(90, [0.0, 5.0, 5.0, 0.0]), (91, [5.0, 0.0]), (92, [1.0])]
    df = spark.createDataFrame(rows, "ear int, d array<double>")
    got = {x.ear: [(p.i, p.depth) for p in x.p] for x in df.select("ear", workflow.gated_peaks(F.col("d"), 3.0).alias("p")).collect()}
    assert got == {k: peaks_by_definition(v, 3.0) for k, v in rows} and got[90] == [(1, 5.0)]


def test_codes_ages_and_tiers(spark):
    rows = [("3C80T10ExxX1_S0_1__", 2015), (" B__T0?E X0", 2003), ("", 2000), ("C05_11", 2004), (None, None)]
    df = spark.createDataFrame(rows, "code string, year int")
    got = df.select(sc.parse_code(F.col("code")).alias("c"), sc.explicit_feature(F.col("code")).alias("e"), "year").withColumn("age", sc.age(F.col("c.decade"), F.col("year"))).collect()
    one = got[0].c
    assert (one.sex, one.decade, one.left_tusk, one.right_tusk, one.has_tail) == ("C", 80, 1, 0, True)
    assert (one.extreme_left, one.extreme_right, one.special_left, one.special_mid, one.special_right) == (1, None, 0, None, 1)
    assert [g.e for g in got] == [True, True, False, False, False]
    assert got[1].c.left_tusk is None and got[3].c.left_tusk is None and got[0].age == 30 and got[3].age == 94 and got[4].age is None
    values = spark.createDataFrame([(25.0,), (9.9,), (0.5,), (float("nan"),), (None,), (float("inf"),)], "v double")
    assert [r[0] for r in values.select(sc.tier_name(sc.tier(F.col("v"), [25, 10, 4, 1]))).collect()] == ["excellent", "good", "poor", "poor", "poor", "poor"]
    with pytest.raises(ValueError):
        sc.ramp(F.col("v"), 1.0, 1.0)


def test_quality_of_planted_measures(spark):
    m = spark.createDataFrame([(0.66, 0.43, 1.3, 5.2, 0.02, 0.02), (0.59, 0.355, 1.09, 4.35, 0.1, 0.115), (0.5, 0.4, 1.3, 5.2, 0.0, 0.0)], "fill double, root double, aspect double, detail double, dark double, bright double")
    got = curation.quality_scores(m).collect()
    assert got[0].overall == pytest.approx(1.0) and (got[1].flatness, got[1].shape, got[1].sharp, got[1].exposure) == pytest.approx((0.5, 0.5, 0.5, 0.5))
    assert got[2].overall == pytest.approx(math.exp(0.35 * math.log(1e-6)))


def test_flags_and_lifecycle(spark):
    events = [(1, 0, "flag", "p"), (1, 1, "flag", "p"), (2, 0, "flag", "p"), (2, 1, "pick", None), (2, 2, "flag", "p"), (3, 0, "flag", "p"), (3, 1, "reject", None), (4, 0, "pick", "x"), (5, 0, "flag", "p"), (5, 1, "flag", "q")]
    got = {r.key: (r.flagged, r.resolution) for r in incremental.toggled_flags(spark.createDataFrame(events, "key long, seq int, action string, pair string")).collect()}
    assert got == {2: ("p", None), 3: ("p", "rejected"), 5: ("q", None)}
    log = [(1, i, a) for i, a in enumerate(["analyse", "approve", "match", "decide", "analyse"])] + [(2, i, a) for i, a in enumerate(["analyse", "approve", "match", "decide", "decide", "match"])]
    got = {r.key: (r.analysed, r.approved, r.matched, r.decided) for r in incremental.lifecycle(spark.createDataFrame(log, "key long, seq int, action string")).collect()}
    assert got == {1: (4, None, None, None), 2: (0, 1, 5, 3)}


def test_macro_differs_from_micro(spark):
    ranks = spark.createDataFrame([("Ada", 1)] * 3 + [("Bea", 2)] * 2, "truth string, rank long")
    assert evaluation.micro(ranks).first().top1 == pytest.approx(0.6) and evaluation.macro(ranks, "truth").first().top1 == pytest.approx(0.5)
    assert evaluation.micro(ranks).first().mrr == pytest.approx(0.8) and evaluation.macro(ranks, "truth").first().mrr == pytest.approx(0.75)


def test_score_contract(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", float("nan")), (2, "a", float("inf")), (2, "z", 1.0)], "query int, candidate string, score double")
    got = checks.score_contract(scores, spark.createDataFrame([(1,), (2,)], "query int"), spark.createDataFrame([("a",), ("b",)], "candidate string")).first()
    assert (got.missing, got.unknown, got.not_finite) == (1, 1, 2)


def test_fail_fast(spark):
    df = spark.createDataFrame([(3, "x"), (2, "y")], "row_no int, reason string")
    with pytest.raises(checks.IntegrityError, match="row 2"):
        checks.fail_fast(df, "row_no")
    checks.fail_fast(df.limit(0), "row_no")


def test_suppression_and_caps(spark):
    boxes = spark.createDataFrame([("p", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("p", 2, 0.8, 1.0, 0.0, 11.0, 10.0), ("p", 3, 0.7, 20.0, 0.0, 30.0, 10.0)], "g string, id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert training.suppressed(boxes, "g", 0.5, 10).first().kept == [1, 3]
    log = spark.createDataFrame([("A", s, s, "accept") for s in range(5)] + [("A", 0, 9, "reject"), ("A", 4, 10, "accept")], "individual string, sighting long, seq long, action string")
    assert {r.sighting for r in incremental.fold_decisions_capped(log, 3).collect()} == {1, 2, 4}


def test_square(spark):
    square = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])], "ear int, i int, x double, y double")
    a = ge.polygon_areas(square).first()
    assert (a.area, a.perimeter) == (4.0, 8.0)
    rays = spark.createDataFrame([(1, 0, 1.0, 1.0, 1.0, 0.0), (1, 1, 5.0, 5.0, 1.0, 0.0)], "ear int, ray int, ox double, oy double, dx double, dy double")
    assert {r.ray: r.t for r in ge.furthest_crossing(rays, square).collect()} == {0: 1.0, 1: None}
    assert {r.ray: r.t for r in ge.nearest_crossing(rays, square).collect()}[1] == 0.0
