"""Quantiles and strengths of the scores of all pairs from blocks, against the table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import cohorts as co
from sightline.operators import retrieval as rt
from sightline.operators import vectors as ve
from sightline.operators.shared import exact_quantiles

CUTS = {"strong": 0.99, "moderate": 0.90}


def vectors(spark, odd=None):
    r = np.random.default_rng(5)
    e = np.round(r.normal(0, 0.2, (90, 6)), 2)
    e[60:70] = e[60]
    if odd is not None:
        e[3, 1] = odd
    rows = [(k, k % 3, k % 5, e[k].tolist(), k % 7 * 0.01) for k in range(90)]
    return spark.createDataFrame(rows, "id long, label long, individual long, e array<double>, bias double")


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("odd", [None, float("inf")])
def test_quantiles_and_strengths_equal_those_of_the_pairs(spark, monkeypatch, others, odd):
    monkeypatch.setattr(ve, "BLOCK_ROWS", 11)
    monkeypatch.setattr(ve, "TILE_PAIRS", 40)
    monkeypatch.setattr(co, "STRETCHES", 64)
    sent, counted = [], co.quantiles_of_counts
    monkeypatch.setattr(co, "quantiles_of_counts", lambda counts, *rest: sent.append(counts) or counted(counts, *rest))
    v = vectors(spark, odd).cache()
    a, b = (v.select(F.col("id").alias(c), F.col("individual").alias(f"who_{c}"), F.col("bias").alias(f"bias_{c}")) for c in "ij")
    pairs = ve.pair_scores(v, v, ["label"]).join(a, "i").join(b, "j").select("i", "j", "who_i", "who_j", F.round(F.col("score") + F.col("bias_i"), 9).alias("score")).cache()
    want = exact_quantiles(pairs.filter("who_i <> who_j") if others else pairs, [], "score", CUTS).first()
    got = co.score_quantiles(v, ["label"], CUTS, others).first()
    assert tuple(got) == pytest.approx(tuple(want), abs=2e-9, nan_ok=True)
    if odd is None:
        assert sent[0].count() < pairs.count() / 4
        labelled = pairs.withColumn("strength", rt.strength(F.col("score"), F.lit(want.strong + 1e-10), F.lit(want.moderate + 1e-10)))
        want = {r.strength: (r.n, r.c) for r in labelled.groupBy("strength").agg(F.count("*").alias("n"), F.avg(rt.logistic(F.col("score"))).alias("c")).collect()}
        told = {r.strength: (r.n, r.confidence) for r in co.strength_counts(v, ["label"], got.strong + 1e-10, got.moderate + 1e-10).collect()}
        assert told.keys() == want.keys() and all(told[k] == pytest.approx(want[k]) for k in want)
