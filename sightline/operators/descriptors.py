"""Key points and descriptors of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import series as se


def extrema(values: DataFrame, key: str, order: int = 3) -> DataFrame:
    """key, i, v, kind of strict extrema over `order` neighbours on either side (columns i, v); the ends never qualify."""
    w = Window.partitionBy(key).orderBy("i")
    near = [f("v", o).over(w) for o in range(1, order + 1) for f in (F.lag, F.lead)]
    above = reduce(lambda a, b: a & b, [F.col("v") > x for x in near])
    below = reduce(lambda a, b: a & b, [F.col("v") < x for x in near])
    marked = values.withColumn("kind", F.when(above, "max").when(below, "min"))
    return marked.filter(F.col("kind").isNotNull())


def key_points(values: DataFrame, key: str, n: int, order: int = 3, most: int = 32) -> DataFrame:
    """key, i: extrema and the two ends of a series of n values; the `most` farthest from 0.5 stay, the ends always.

    The first listed (the first maximum, or the first minimum without one) and the last listed count as ends too."""
    found = extrema(values, key, order)
    listed = F.row_number().over(Window.partitionBy(key).orderBy(F.when(F.col("kind") == "max", 0).otherwise(1), "i"))
    count = F.count("*").over(Window.partitionBy(key))
    found = found.withColumn("_l", listed).withColumn("_n", count)
    head = found.filter((F.col("_l") == 1) & (F.col("i") > 1)).select(key, F.lit(0).alias("i"), F.lit(float("inf")).alias("s"))
    tail = found.filter((F.col("_l") == F.col("_n")) & (F.col("i") < n - 2)).select(key, F.lit(n - 1).alias("i"), F.lit(float("inf")).alias("s"))
    heads, tails = head.select(key, F.lit(True).alias("_h")), tail.select(key, F.lit(True).alias("_t"))
    body = found.join(heads, key, "left").join(tails, key, "left")
    end = (F.col("_h").isNull() & (F.col("_l") == 1)) | (F.col("_t").isNull() & (F.col("_l") == F.col("_n")))
    body = body.select(key, "i", F.when(end, F.lit(float("inf"))).otherwise(F.abs(F.col("v") - 0.5)).alias("s"))
    everything = body.unionByName(head).unionByName(tail).groupBy(key, "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy(key).orderBy(F.col("s").desc(), "i")
    return everything.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= most).select(key, "i")


def descriptors(points: DataFrame, series: DataFrame, key: str, size: int = 32) -> DataFrame:
    """key, i, j, vec: for each two key points i < j the slice of the series (column v, an array) between them, resampled to `size` values and of unit length."""
    a, b = points.select(key, "i"), points.select(key, F.col("i").alias("j"))
    pairs = a.join(b, key).filter("i < j").join(series, key)
    raw = pairs.select(key, "i", "j", se.resample_span(F.slice("v", F.col("i") + 1, F.col("j") - F.col("i") + 1), size).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("_n", norm).filter(F.col("_n") > 0).select(key, "i", "j", F.transform("raw", lambda x: x / F.col("_n")).alias("vec"))


def best_lag(pairs: DataFrame, keys: list[str], window: int, trim: int) -> DataFrame:
    """keys, corr, lag: the largest Pearson correlation of a with b turned by -window..window places, without `trim` places at either end of a."""
    n = F.size("a")
    rows = pairs.withColumn("lag", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("i", F.explode(F.sequence(F.lit(trim), n - 1 - trim)))
    rows = rows.select(*keys, "lag", F.get("a", F.col("i")).alias("x"), F.get("b", F.pmod(F.col("i") + F.col("lag"), n)).alias("y"))
    each = rows.groupBy(*keys, "lag").agg(F.covar_pop("x", "y").alias("xy"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("sd"))
    each = each.filter(F.col("sd") > 1e-12).withColumn("c", F.round(F.col("xy") / F.col("sd"), 9))
    return each.groupBy(*keys).agg(F.max("c").alias("corr"), F.max_by("lag", F.struct("c", -F.col("lag"))).alias("lag"))
