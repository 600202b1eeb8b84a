"""Descriptors of whole series as array expressions, against the operators on long tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import series as se
from sightline.operators import descriptors as de
from sightline.plans import workflow_queries


@pytest.mark.parametrize("most", [32, 4])
def test_descriptors_of_array_expressions_equal_those_of_long_tables(spark, tmp_path, monkeypatch, most):
    r = np.random.default_rng(6)
    values = [r.normal(0, 0.3, 64) for _ in range(20)] + [np.zeros(64), np.linspace(-0.4, 0.4, 64), np.where(np.arange(64) == 1, 0.4, 0.0), np.full(64, -0.5)]
    rows = [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    places = workflow_queries.key_places
    monkeypatch.setattr(workflow_queries, "key_places", lambda smooth, **more: places(smooth, most=most, **more))
    made = workflow_queries.c8_descriptors(spark, str(tmp_path))
    e = spark.createDataFrame(rows, "ear long, raw array<float>").select("ear", F.transform("raw", lambda x: x.cast("double") + 0.5).alias("v"))
    points = de.key_points(e.select("ear", F.posexplode(se.smooth(F.col("v"), 1.0)).alias("i", "v")), "ear", 64, most=most)
    told = lambda d: {(x.ear, x.i, x.j): x.vec for x in d.collect()}
    want, got = told(de.descriptors(points, e, "ear", 32)), told(made)
    assert got.keys() == want.keys() and len({k[0] for k in want}) >= 20 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
