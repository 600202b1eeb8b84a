"""Scores of aligned series where pairs are compared, against the table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import retrieval as rt

SMALL = rt.Comparison(bins=12, stretch_steps=3)


def ears(spark, n=60, seed=8):
    """Sightings of up to two ears a side; the last individual is known from one side alone, and no ear of it is like another."""
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        who = k // 7
        side = "left" if k % 2 or who == n // 7 else "right"
        d = np.where(r.random(12) < 0.3, r.uniform(-1, 9, 12), 0.0) if k % 11 else np.zeros(12)
        rows.append((f"e{k}", f"s{who}-{k % 3}", side, who, [(d.tolist(), 0.0, 180.0)]))
    return spark.createDataFrame(rows, "ear string, sighting string, side string, who long, profiles array<struct<depths array<double>, start double, end double>>")


def pair_table(e, query):
    named = rt.block_similarities(e, e, SMALL).join(e.select(F.col("ear").alias("query_ear"), F.col(query).alias("query"), "side"), "query_ear")
    return named.join(e.select("ear", F.col("who").alias("candidate")), "ear")


def told(df):
    return {(x.query, x.candidate): x.score for x in df.collect()}


@pytest.mark.parametrize("most", [1024, 6, 3])
def test_scores_come_from_blocks_as_from_the_pairs(spark, monkeypatch, most):
    e = ears(spark).cache()
    pairs = pair_table(e, "sighting").cache()
    want = told(rt.candidate_scores(rt.side_scores(pairs, ["query", "side", "candidate"]), ["query", "candidate"]))
    best = told(rt.available_side_scores(pair_table(e, "who"), "query", "candidate", "side", "similarity"))
    monkeypatch.setattr(rt, "LEAST_BLOCK", 4)
    monkeypatch.setattr(rt, "MOST_BLOCK", most)  # some, or all, individuals have more rows than a block may
    known = e.withColumn("candidate", F.col("who"))
    got = told(rt.aligned_scores(known.withColumn("query", F.col("sighting")), known, SMALL))
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-12) and len({c for _, c in got}) < e.select("who").distinct().count()
    got = told(rt.aligned_best_scores(e.withColumn("query", F.col("who")), known, SMALL))
    assert got.keys() == best.keys() and got == pytest.approx(best, abs=1e-12)


def test_no_pair_is_shuffled_and_blocks_are_tasks_of_their_own(spark):
    e = ears(spark).withColumn("candidate", F.col("who")).withColumn("query", F.col("sighting"))
    for made in (rt.aligned_scores(e, e, SMALL), rt.aligned_best_scores(e, e, SMALL)):
        lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
        above = lines[: next(k for k, line in enumerate(lines) if "CoGroup" in line)]
        assert not any(x in line for line in above for x in ("Aggregate", "Window", "Join", "Repartition"))
    plan = rt.block_similarities(e, e, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2


@pytest.mark.parametrize("most", [1024, 2])
def test_sightings_rank_as_by_their_pairs(spark, monkeypatch, most):
    from sightline.operators import ranking as rk
    from sightline.operators import shared

    e = ears(spark, 90).filter("who < 12")
    rows = e.select(F.substring("ear", 2, 9).cast("long").alias("row"), "ear", F.col("who").alias("individual"), "sighting", "side", F.expr("concat('p', int(substring(ear, 2, 9)) % 31)").alias("photo"), F.lit("2024-01-01").alias("date"), F.col("profiles")[0]["depths"].alias("depths"))
    rows = shared.materialise(rows.withColumn("mass", F.aggregate("depths", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))) / 100))
    asked = rows.filter("sighting LIKE '%-2'").select("sighting").distinct()
    shaped = rows.select("ear", F.col("ear").alias("sighting"), "side", F.array(F.struct("depths", F.lit(0.0).alias("start"), F.lit(180.0).alias("end"))).alias("profiles"))
    number = lambda c: F.substring(c, 2, 9).cast("long")
    pairs = rt.block_similarities(shaped, shaped, SMALL).select(number("query_ear").alias("i"), number("ear").alias("j"), F.col("similarity").alias("score"), "stretch", (F.col("shift") / 12).alias("shift")).cache()
    gallery = rows.join(asked, "sighting", "left_anti")
    inside = pairs.join(gallery.select(F.col("row").alias("i")), "i", "left_semi").join(gallery.select(F.col("row").alias("j")), "j", "left_semi")
    told = lambda d: {(x.query, x.candidate): x for x in d.collect()}
    want = told(rk.rank_sightings(rk.query_z(pairs, rows, asked), rows, rk.fit(inside, gallery), 3, pairs))
    monkeypatch.setattr(rk, "ALIGNED_BLOCK", (3, 5))
    monkeypatch.setattr(rt, "LEAST_BLOCK", 2)
    monkeypatch.setattr(rt, "MOST_BLOCK", most)  # with 2, individuals have more rows than a block may
    got = told(rk.rank_aligned_sightings(rows, asked, SMALL, 3))
    assert got.keys() == want.keys() and len(want) == 3 * asked.count()
    for key, x in want.items():
        assert (got[key].place, got[key].score) == (x.place, pytest.approx(x.score, abs=1e-4))
        assert [(a.side, a.strength, a.i, a.j, a.query_photo, a.gallery_photo, a.stretch, a.shift) for a in got[key].evidence] == [(a.side, a.strength, a.i, a.j, a.query_photo, a.gallery_photo, a.stretch, a.shift) for a in x.evidence]


def test_the_evidence_needs_no_table_of_pairs(spark, monkeypatch):
    from sightline.operators import cohorts, ranking, shared
    from sightline.plans import ranking_queries

    made = []
    kept = lambda f: lambda df: made.append(f(df)) or made[-1]
    for module in (cohorts, ranking, ranking_queries):
        monkeypatch.setattr(module, "materialise", kept(shared.materialise))
    assert ranking_queries.c4_aligned_evidence(spark, "/root/testdata/sf0.001").count()
    ears_ = made[0].count()
    assert max(d.count() for d in made) < 30 * ears_  # five thousand and more pairs of some 130 ears
