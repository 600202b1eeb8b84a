"""Retrieval quality: eligible queries, matchers, truth ranks, metrics, cluster bootstrap."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import checks
from sightline.operators.shared import dense_ids, materialise

TOP = (1, 3, 5, 10, 15)
#: Groups whose sums are looked up together by the bootstrap, and the ranges that its samples are dealt into.
BLOCK_GROUPS, SAMPLE_RANGES = 1 << 16, 256


def eligible(pairs: DataFrame, name: str) -> DataFrame:
    """Rows of names with more than one row."""
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(name))).filter(F.col("_n") > 1).drop("_n")


def truth_ranks(scores: DataFrame, query: str, candidate: str, truth: str, score: str = "score") -> DataFrame:
    """query, truth, rank: one more than the candidates with a strictly higher score; ties do not lower a rank.  A query whose truth has no score,
    or with a score that is null or not finite, fails the whole job.  Scores are evaluated once: the true one is read by a window, not by a join."""
    true = F.max(F.when(F.col(candidate) == F.col(truth), F.col(score))).over(Window.partitionBy(query))
    marked = scores.withColumn("_true", true)
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    ranks = marked.groupBy(query, truth).agg((F.count_if(F.col(score) > F.col("_true")) + 1).alias("rank"), F.count_if(~finite | F.col("_true").isNull()).alias("_bad"))
    failed = F.raise_error(F.concat(F.lit("no finite score for the truth and each candidate of query "), F.col(query).cast("string"))).cast("long")
    return ranks.select(query, truth, F.when(F.col("_bad") > 0, failed).otherwise(F.col("rank")).alias("rank"))


def metric_columns(rank: str = "rank", top: tuple[int, ...] = TOP) -> dict[str, Column]:
    """Registry: metric name to its value for one query."""
    return {f"top{k}": (F.col(rank) <= k).cast("double") for k in top} | {"mrr": 1.0 / F.col(rank)}


def micro(ranks: DataFrame, metrics: dict[str, Column] | None = None) -> DataFrame:
    metrics = metrics or metric_columns()
    return ranks.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(name) for name, c in metrics.items()])


def macro(ranks: DataFrame, group: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    metrics = metrics or metric_columns()
    each = ranks.groupBy(group).agg(*[F.avg(c).alias(name) for name, c in metrics.items()])
    return each.agg(F.count("*").alias("n_groups"), *[F.avg(name).alias(name) for name in metrics])


def draw(sample: Column, place: Column, seed: int, n: Column) -> Column:
    """A reproducible draw from 0 to n - 1, the same in any engine that has md5."""
    text = F.md5(F.concat_ws("-", sample.cast("string"), place.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % n


def bootstrap(ranks: DataFrame, group: str, samples: int = 100_000, seed: int = 42, value: Column | None = None) -> DataFrame:
    """micro_low, micro_high, macro_low, macro_high: 95 % intervals of the mean of `value` (by default 1 / rank) when whole groups
    are drawn with replacement.  Groups are summed up first; samples are generated and summed in parallel."""
    value = 1.0 / F.col("rank") if value is None else value
    sums = ranks.groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    numbered = materialise(dense_ids(sums, [group], "g").select((F.col("g") - 1).alias("g"), "s", "n"))
    total = numbered.count()
    if not total:
        raise ValueError("no group to draw from")
    # a task draws for a range of samples and looks up a block of groups, whose sums are arrays in the order of their numbers; it sends one row for each sample
    blocks, ranges = -(-total // BLOCK_GROUPS), max(1, min(samples, SAMPLE_RANGES))
    lists = numbered.withColumn("block", F.floor(F.col("g") / BLOCK_GROUPS)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("g", "s", "n"))).alias("_r"))
    lists = lists.select("block", F.transform("_r", lambda r: r["s"]).alias("s"), F.transform("_r", lambda r: r["n"]).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"))
    wanted = ranks.sparkSession.range(samples).select(F.col("id").alias("sample"), (F.col("id") % ranges).cast("int").alias("range"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def add(acc, place):
        at = (draw(F.col("sample"), place, seed, F.lit(total)) - F.col("block") * BLOCK_GROUPS).cast("int")

        def looked(i):
            s, n = F.get("s", i), F.get("n", i)
            outside = (i < 0) | (i >= F.size("s"))
            return F.when(outside, acc).otherwise(F.struct((acc["s"] + s).alias("s"), (acc["n"] + n).alias("n"), (acc["m"] + s / n).alias("m")))

        return F.get(F.transform(F.array(at), looked), F.lit(0))  # the draw is made once

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"))
    parts = wanted.join(lists, ["range", "block"]).select("sample", F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, add).alias("a"))
    drawn = parts.groupBy("sample").agg((F.sum("a.s") / F.sum("a.n")).alias("micro"), (F.sum("a.m") / total).alias("macro"))
    return drawn.agg(*[F.percentile(k, q).alias(f"{k}_{name}") for k in ("micro", "macro") for q, name in ((0.025, "low"), (0.975, "high"))])


# ---- one evaluation of one matcher ---------------------------------------------------------------------------------------------

#: A matcher scores queries (query and its evidence) against a catalog (candidate, sighting and its evidence): query, candidate, score.
Matcher = Callable[[DataFrame, DataFrame], DataFrame]
MATCHERS: dict[str, Matcher] = {}


def matcher(name: str) -> Callable[[Matcher], Matcher]:
    """Registers a matcher by name."""

    def register(f: Matcher) -> Matcher:
        MATCHERS[name] = f
        return f

    return register


def checked(match: Matcher, queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The scores of a matcher, written once; fails unless there is one finite score for each query and each candidate of the catalog."""
    scores = materialise(match(queries, catalog).select("query", "candidate", "score"))
    found = checks.score_contract(scores, queries.select("query"), catalog.select("candidate").distinct()).first()
    twice = scores.groupBy("query", "candidate").count().filter("count > 1").limit(1).count()
    if found["missing"] or found["unknown"] or found["not_finite"] or twice:
        raise checks.IntegrityError(f"a matcher must return one finite score for each query and candidate: {found.asDict()}, repeated {twice}")
    return scores


@dataclass(frozen=True)
class Evaluation:
    """Scores (query, truth, candidate, score with names), ranks, and one row each of micro and macro metrics and of intervals."""

    scores: DataFrame
    ranks: DataFrame
    micro: DataFrame
    macro: DataFrame
    intervals: DataFrame


def evaluate(benchmark: DataFrame, match: Matcher | str, samples: int = 100_000, seed: int = 42) -> Evaluation:
    """Leave-one-sighting-out retrieval of a benchmark (name, sighting, and evidence in any further columns) by a matcher or the name of one.

    Queries are the sightings of names with more than one; all names are candidates.  The matcher sees keys of this run in place of names, and must
    hold out the query's own sighting.  Fails without an eligible query."""
    run = uuid.uuid4().hex
    keyed = benchmark.withColumn("candidate", F.sha2(F.concat_ws("-", F.lit(run), F.col("name").cast("string")), 256))
    queries = eligible(benchmark, "name").withColumnRenamed("sighting", "query")
    if not queries.limit(1).count():
        raise ValueError("the benchmark has no eligible query")
    scores = checked(MATCHERS[match] if isinstance(match, str) else match, queries.drop("name"), keyed.drop("name"))
    names = keyed.select("candidate", "name").distinct()
    named = scores.join(names, "candidate").select("query", F.col("name").alias("candidate"), "score")
    named = named.join(queries.select("query", F.col("name").alias("truth")), "query").select("query", "truth", "candidate", "score")
    ranks = materialise(truth_ranks(named, "query", "candidate", "truth"))
    return Evaluation(named, ranks, micro(ranks), macro(ranks, "truth"), bootstrap(ranks, "truth", samples, seed))
