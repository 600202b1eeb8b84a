"""What several operators need: cut lineage, numbers in order, exact quantiles, and joins of all pairs block by block."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of the right side of every_pair.
BLOCK_ROWS = 4096


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a folder here, and any other is refused."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df in range partitions by `order`, with the partition's number _p; fixed, because the ranges come from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))


def dense_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers from 1 in order: rows are ranged into partitions, numbered in each, and the partitions' sizes are added up.

    order: names or columns; rows that are equal in all of them are numbered in any order."""
    local = _ranged(df, order).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.max("_r").alias("_n"))  # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return local.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_p", "_r", "_before")


#: Accuracy of the sketch that finds where quantiles lie, and the share of the values kept on either side of each.
SKETCH, BESIDE = 20_000, 3 / 20_000


def _near_quantiles(rows: DataFrame, groups: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """groups, value, _c: the counts of equal values that may be at the quantiles, and of all values of each stretch between those under its last value, which no quantile can be.

    A mergeable sketch tells each quantile's neighbourhood, and a second pass counts: what is far from all quantiles is a few counts, however many rows there are."""
    shares = sorted({min(1.0, max(0.0, q + d)) for q in quantiles for d in (-BESIDE, BESIDE)})
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), F.lit(SKETCH)).alias("_cuts"))
    if not groups:
        told = rows.crossJoin(F.broadcast(cuts))  # one row
    else:
        same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
        told = rows.join(cuts, reduce(lambda a, b: a & b, same))
    at = {s: F.get("_cuts", F.lit(i)) for i, s in enumerate(shares)}
    inside = F.lit(False)
    for q in quantiles:
        low, high = (at[min(1.0, max(0.0, q + d))] for d in (-BESIDE, BESIDE))
        inside = inside | (F.lit(q <= BESIDE) | (F.col(value) >= low)) & (F.lit(q >= 1 - BESIDE) | (F.col(value) <= high))
    below = sum((F.col(value) > c).cast("int") for c in at.values())
    counted = told.groupBy(*groups, below.alias("_b"), F.when(inside, F.col(value)).alias("_v")).agg(F.count("*").alias("_c"), F.max(value).alias(value))
    return counted.select(*groups, value, "_c", F.col("_v").isNotNull().alias("_exact"))


def exact_quantiles(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], nearest_rank: bool = False) -> DataFrame:
    """groups, one column for each quantile: linear interpolation between the two nearest ranks of the values that are not null, or with nearest_rank the least value
    that at least this share of them does not exceed.

    Values far from the quantiles are counted, and only the others are ranged over all partitions and ranked by the partitions' sizes; where a quantile turns out to lie beyond what the
    sketch told, all values are ranged.  A few large groups are no few large tasks."""
    known = rows.filter(F.col(value).isNotNull()).select(*groups, value)
    found = materialise(_ranked_quantiles(_near_quantiles(known, groups, value, [float(q) for q in quantiles.values()]), groups, value, quantiles, nearest_rank))
    if found.filter(~F.col("_sure")).limit(1).count():
        found = _ranked_quantiles(known.withColumns({"_c": F.lit(1).cast("long"), "_exact": F.lit(True)}), groups, value, quantiles, nearest_rank)
    return found.drop("_sure")


def quantiles_of_counts(counts: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of the quantiles of values that occur _c times each; rows that are not _exact stand for values nearby and hold no quantile."""
    found = materialise(_ranked_quantiles(counts, [], value, quantiles, False))
    if found.filter(~F.col("_sure")).limit(1).count():
        raise ValueError("a quantile lies among values that were only counted")
    return found.drop("_sure")


def _ranked_quantiles(counts: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], nearest_rank: bool) -> DataFrame:
    """The quantiles of values that occur _c times each, and _sure: whether all of them are values of rows that are _exact."""
    order = [*groups, value]
    inner = Window.partitionBy("_p", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = _ranged(counts, order).withColumn("_r", F.sum("_c").over(inner))
    sizes = materialise(local.groupBy(*groups, "_p").agg(F.max("_r").alias("_n")))  # a row for each partition that a group reaches
    w = Window.partitionBy(*groups).orderBy("_p")
    places = sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*groups)))
    last = F.col("_before") + F.col("_r") - 1
    first = last - F.col("_c") + 1
    place = (lambda q: F.greatest(F.ceil(F.lit(float(q)) * F.col("_all")) - 1, F.lit(0)).cast("double")) if nearest_rank else (lambda q: F.lit(float(q)) * (F.col("_all") - 1))
    at = {name: place(q) for name, q in quantiles.items()}
    key = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    told = places.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_p").alias("_q"), "_before", "_all")
    ranked = local.join(told, reduce(lambda a, b: a & b, key, F.col("_p") == F.col("_q")))
    holds = lambda rank: (rank >= first) & (rank <= last)
    wanted = F.lit(False)
    for x in at.values():
        wanted = wanted | holds(F.floor(x)) | holds(F.ceil(x))
    pick = lambda rank: F.max(F.when(holds(rank), F.col(value)))
    found = ranked.filter(wanted).groupBy(*groups).agg(F.bool_and("_exact").alias("_sure"), *[c for name, x in at.items() for c in (pick(F.floor(x)).alias(f"{name}_a"), pick(F.ceil(x)).alias(f"{name}_b"), F.max(x - F.floor(x)).alias(f"{name}_f"))])
    return found.select(*groups, "_sure", *[(F.col(f"{n}_a") + (F.col(f"{n}_b") - F.col(f"{n}_a")) * F.col(f"{n}_f")).alias(n) for n in quantiles])


def every_pair(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """All pairs of two tables, where the result itself is asked for: an equi-join of bounded blocks, with no side broadcast."""
    n, m = (max(1, -(-d.count() // BLOCK_ROWS)) for d in (left, right))
    block = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    a = left.withColumn("_a", block(left_key, n)).withColumn("_b", spread(m))
    b = right.withColumn("_b", block(right_key, m)).withColumn("_a", spread(n))
    return a.join(b, ["_a", "_b"]).drop("_a", "_b")
