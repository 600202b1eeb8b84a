"""Curation: quality scores, filters, review queues, picks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import scalar as sc
from sightline.operators.shared import dense_ids, exact_quantiles


def facet_filter(facets: dict[str, Column | None]) -> Column:
    """All active facets hold; an unknown value never matches an active facet.  None: not active."""
    out = F.lit(True)
    for condition in facets.values():
        if condition is not None:
            out = out & F.coalesce(condition, F.lit(False))
    return out


def quality_scores(measures: DataFrame) -> DataFrame:
    """Adds flatness, shape, sharp, exposure and overall to measures: fill (share of the box), root (offset of the anchors in widths), aspect (height
    by width), detail (logarithm of one and the variance of the Laplacian), dark and bright (shares of the pixels)."""
    m = measures.withColumns(
        {
            "flatness": F.sqrt(sc.ramp(F.col("fill"), 0.52, 0.66) * sc.ramp(F.col("root"), 0.28, 0.43)),
            "shape": sc.band(F.col("aspect"), 1.0, 1.18, 1.45, 1.85),
            "sharp": sc.ramp(F.col("detail"), 3.5, 5.2),
            "exposure": 1 - sc.ramp(F.col("dark") + F.col("bright"), 0.08, 0.35),
        }
    )
    return m.withColumn("overall", sc.geometric_mean([(F.col("flatness"), 0.35), (F.col("shape"), 0.25), (F.col("sharp"), 0.25), (F.col("exposure"), 0.15)]))


def threshold_sweep(scores: DataFrame, score: str, reference: str, cuts: list[float]) -> DataFrame:
    """cut, passed, rate, retained (share of the reference rows that pass): one scan, one row for each cut."""
    sums = [F.count("*").alias("n"), F.sum(reference).alias("r")]
    for i, cut in enumerate(cuts):
        sums += [F.count_if(F.col(score) >= cut).alias(f"p{i}"), F.count_if((F.col(score) >= cut) & (F.col(reference) == 1)).alias(f"q{i}")]
    total = scores.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"p{i}").alias("passed"), F.col(f"q{i}").alias("kept")) for i, c in enumerate(cuts)]))
    out = total.select("n", "r", rows.alias("x"))
    return out.select("x.cut", "x.passed", (F.col("x.passed") / F.col("n")).alias("rate"), (F.col("x.kept") / F.col("r")).alias("retained"))


def score_quantiles(scores: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    rows = scores.select(F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*")
    return exact_quantiles(rows, ["score"], "v", {f"q{int(q * 100):02d}": q for q in quantiles})


def lowest(scores: DataFrame, columns: list[str], key: str, n: int) -> DataFrame:
    """The n lowest rows of each score."""
    rows = scores.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.round(c, 9).alias("v")) for c in columns])).alias("x")).select("x.*", key)
    w = Window.partitionBy("score").orderBy("v", key)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n).select("score", key, "place")


# ---- sightings and review ---------------------------------------------------------------------------------------------------


#: The least score of a usable photo.
USABLE = 8


def photo_weight(score: str = "score") -> Column:
    """10: 1, 9: 1/2, 8: 1/4, 7: 1/8, else 0."""
    s = F.col(score)
    return F.when(s == 10, 1.0).when(s == 9, 0.5).when(s == 8, 0.25).when(s == 7, 0.125).otherwise(0.0)


def combined_strength(left: str, right: str) -> Column:
    """Nine parts of the weaker side and one of the stronger."""
    return 0.9 * F.least(left, right) + 0.1 * F.greatest(left, right)


def sighting_tiers(candidates: DataFrame, usable: int = USABLE) -> DataFrame:
    """name, sighting, tier: the weaker of the best scores of the two sides; only sightings whose both sides are usable."""
    best = lambda side: F.max(F.when(F.col("side") == side, F.col("score")))
    both = candidates.groupBy("name", "sighting").agg(best("left").alias("l"), best("right").alias("r"))
    return both.filter((F.col("l") >= usable) & (F.col("r") >= usable)).select("name", "sighting", F.least("l", "r").alias("tier"))


def usable_individuals(tiers: DataFrame, least: int = 3) -> DataFrame:
    return tiers.groupBy("name").agg(F.count("*").alias("usable")).filter(F.col("usable") >= least)


def sighting_sides(photos: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left, right (the best score of each side; null without a photo), left_w, right_w (the sums of its photos' weights).  photos: keys, side, photo, score.

    Where the rows of a sighting are in one partition, as after a repartition by keys, nothing is shuffled again."""
    each = photos.groupBy(*keys, "side", "photo").agg(F.max("score").alias("score"))
    on = lambda side, v: F.when(F.col("side") == side, v)
    best = [F.max(on(side, F.col("score"))).alias(side) for side in ("left", "right")]
    weights = [F.sum(on(side, photo_weight()).otherwise(0.0)).alias(f"{side}_w") for side in ("left", "right")]
    return each.groupBy(*keys).agg(*best, *weights)


def sighting_strength(candidates: DataFrame) -> DataFrame:
    """name, sighting, strength: weights of the photos' scores (10: 1, 9: 1/2, 8: 1/4, 7: 1/8), summed for each side, then nine parts of the
    weaker side and one of the stronger."""
    return strength_of_sides(sighting_sides(candidates, ["name", "sighting"]))


def strength_of_sides(sides: DataFrame) -> DataFrame:
    """name, sighting, strength of what `sighting_sides` gives."""
    return sides.select("name", "sighting", combined_strength("left_w", "right_w").alias("strength"))


def nth_best(rows: DataFrame, group: str, value: str, n: int, missing) -> DataFrame:
    """group, value of the n-th best row, or `missing`."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc())
    return rows.withColumn("_n", F.row_number().over(w)).groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_n") == n, F.col(value))), F.lit(missing)).alias(f"best{n}"))


def review_state(decisions: DataFrame) -> DataFrame:
    """sighting, name, action: the newest decision (accept or reject) of each sighting; a skip takes a decision back."""
    newest = decisions.groupBy("sighting").agg(F.max_by(F.struct("name", "action"), "seq").alias("r"))
    return newest.select("sighting", "r.name", "r.action").filter(F.col("action").isin("accept", "reject"))


def eligible_sightings(candidates: DataFrame, decisions: DataFrame, cap: int = 10, least: int = 3) -> DataFrame:
    """name, sighting, tier, key: the sightings still to be reviewed; smaller keys come first.

    candidates: name, sighting, side, photo, score; decisions: sighting, name, action, seq.  Individuals need `least` usable sightings, fewer than `cap`
    accepted ones, and enough that are not rejected to reach the least.  Better tiers come first; in a tier, individuals by their fifth and then their third best
    sighting (tier, then the better side's best score), by their number of sightings of this tier, by up to three accepted ones, and by name; of an
    individual the stronger sighting first.

    Photos are read once: one aggregate gives a sighting its tier, strength and better side, and windows over its individual all the rest."""
    return eligible_of_sides(sighting_sides(candidates, ["name", "sighting"]), decisions, cap, least)


def eligible_of_sides(sides: DataFrame, decisions: DataFrame, cap: int = 10, least: int = 3) -> DataFrame:
    """`eligible_sightings` of what `sighting_sides` gives."""
    each = sides.filter((F.col("left") >= USABLE) & (F.col("right") >= USABLE))
    tiers = each.select("name", "sighting", F.least("left", "right").alias("tier"), F.greatest("left", "right").alias("stronger"), combined_strength("left_w", "right_w").alias("strength"))
    own = Window.partitionBy("name")
    ranked = tiers.withColumn("_n", F.row_number().over(own.orderBy(F.col("tier").desc(), F.col("stronger").desc())))
    nth = lambda n, c: F.coalesce(F.max(F.when(F.col("_n") == n, F.col(c))).over(own), F.lit(-1))
    told = ranked.withColumns({f"{c[0]}{n}": nth(n, c) for n in (5, 3) for c in ("tier", "stronger")} | {"usable": F.count("*").over(own), "here": F.count("*").over(Window.partitionBy("name", "tier"))})
    state = review_state(decisions)
    done = state.groupBy("name").agg(F.count_if(F.col("action") == "accept").alias("accepted"), F.count_if(F.col("action") == "reject").alias("rejected"))
    people = told.filter(F.col("usable") >= least).join(done, "name", "left").fillna(0, ["accepted", "rejected"])
    left = people.filter((F.col("accepted") < cap) & (F.col("usable") - F.col("rejected") >= least)).join(state.select("sighting"), "sighting", "left_anti")
    down = lambda *names: [(-F.col(n)).alias(n) for n in names]
    key = F.struct(*down("tier", "t5", "s5", "t3", "s3", "here"), (-F.least("accepted", F.lit(3))).alias("accepted"), "name", *down("strength"), "sighting")
    return left.select("name", "sighting", "tier", key.alias("key"))


def review_queue(candidates: DataFrame, decisions: DataFrame, cap: int = 10, least: int = 3) -> DataFrame:
    """tier, place, name, sighting: the whole queue of `eligible_sightings`."""
    return queue_of(eligible_sightings(candidates, decisions, cap, least))


def queue_of(eligible: DataFrame) -> DataFrame:
    """The queue of what `eligible_sightings` gives.  Rows are numbered in range partitions, and the few tiers' first numbers are taken off."""
    numbered = dense_ids(eligible, ["key"], "_at")
    first = numbered.groupBy("tier").agg(F.min("_at").alias("_first"))  # one row for each tier
    return numbered.join(F.broadcast(first), "tier").select("tier", (F.col("_at") - F.col("_first") + 1).alias("place"), "name", "sighting")


def next_sighting(eligible: DataFrame, current: DataFrame) -> DataFrame:
    """tier, place, name, sighting: the one row of `eligible_sightings` that is reviewed next: of the best tier that has any, of the individual under review there (current: tier, name)
    if it still has sightings, else of the first.  Every task keeps its best row alone, and the winner's place in the queue is a count: nothing is sorted or numbered."""
    marked = eligible.join(F.broadcast(current.select("tier", F.col("name").alias("_active"))), "tier", "left")  # one row for each tier
    won = marked.orderBy(F.col("tier").desc(), F.coalesce(F.col("name") == F.col("_active"), F.lit(False)).desc(), "key").limit(1)
    before = eligible.join(F.broadcast(won.select("tier", F.col("key").alias("_key"))), "tier").filter(F.col("key") <= F.col("_key"))
    return before.groupBy("tier").agg(F.count("*").alias("place"), F.max_by("name", "key").alias("name"), F.max_by("sighting", "key").alias("sighting"))


def shown_order(items: DataFrame, key: str, names: list[str], seed: int | None = None) -> DataFrame:
    """items with place, from 1: in the order of names, or shuffled by a hash of the key and a seed."""
    order = [*names, key] if seed is None else [F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    return dense_ids(items, order, "place")


def qualifying_individuals(candidates: DataFrame, quality: Column, picks: DataFrame, least: int = 5, cut: float = 0.5) -> DataFrame:
    """name, n: individuals with at least `least` sightings (name, sighting, date) whose best left and best right quality are both above the cut, or whose date is
    among their earlier picks (name, date)."""
    best = lambda side: F.max(F.when(F.col("side") == side, quality))
    both = candidates.groupBy("name", "sighting", "date").agg(best("left").alias("l"), best("right").alias("r"))
    earlier = picks.select("name", "date").distinct().withColumn("_kept", F.lit(True))
    good = both.join(earlier, ["name", "date"], "left").filter(F.col("_kept").isNotNull() | ((F.col("l") > cut) & (F.col("r") > cut)))
    return good.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def pick_summary(picks: DataFrame) -> DataFrame:
    """name, selected, complete, done: dates with picks, dates with both sides, and whether 3 to 5 are complete and none is partial."""
    each = picks.groupBy("name", "date").agg(F.size(F.collect_set("side")).alias("sides"))
    out = each.groupBy("name").agg(F.count("*").alias("selected"), F.count_if(F.col("sides") == 2).alias("complete"))
    return out.withColumn("done", F.col("complete").between(3, 5) & (F.col("complete") == F.col("selected")))


def catalog_summary(photos: DataFrame, thumbnail: Column | None = None) -> DataFrame:
    """name, n, n_left, n_right, dates (distinct, sorted), thumbnail (the first that is not null in the order of date and photo).

    photos: name, side, date, photo; thumbnail: by default the photo."""
    shown = F.col("photo") if thumbnail is None else thumbnail
    first = F.min_by(shown, F.when(shown.isNotNull(), F.struct("date", "photo")))
    return photos.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right"),
        F.sort_array(F.collect_set("date")).alias("dates"), first.alias("thumbnail"),
    )


def covered(evidence: DataFrame, held: DataFrame, key: list[str], sides: int = 2) -> DataFrame:
    """name: individuals whose evidence without the held-out rows still has both sides."""
    left = evidence.join(held, key, "left_anti")
    return left.groupBy("name").agg(F.size(F.collect_set("side")).alias("n")).filter(F.col("n") >= sides).select("name")


def approved_rows(profiles: DataFrame, approvals: DataFrame) -> DataFrame:
    """Profile rows that approvals (sighting, side, row_index) name, of sightings with exactly one valid row for each side."""
    hit = profiles.join(approvals, ["sighting", "row_index", "side"])
    each = hit.groupBy("sighting").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r")).filter("l = 1 AND r = 1")
    return hit.join(each.select("sighting"), "sighting", "left_semi")


def sample_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, nearest-rank median and 95th percentile, extremes, population deviation and rate of the finite samples.  Percentiles come from ranked ranges, however few groups there are."""
    finite = samples.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    stats = finite.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("sd"), (1000.0 / F.avg(value)).alias("per_second"))
    cuts = exact_quantiles(finite, [group], value, {"p50": 0.5, "p95": 0.95}, nearest_rank=True)
    return stats.join(cuts, group).select(group, "n", "mean", "p50", "p95", "low", "high", "sd", "per_second")


def attribute_summary(rows: DataFrame, name: str, order: str, attribute: Column, listed: dict[str, Column]) -> DataFrame:
    """name, first (the attribute of the first row, in order, that has one; an empty text is none) and for each of `listed` the sorted distinct values that are not null."""
    value = F.nullif(attribute, F.lit(""))
    first = F.min_by(value, F.when(value.isNotNull(), F.col(order)))
    return rows.groupBy(name).agg(first.alias("first"), *[F.sort_array(F.collect_set(c)).alias(n) for n, c in listed.items()])


def reason_counts(messages: DataFrame, column: str) -> DataFrame:
    """reason (the text before the first colon), n."""
    return messages.groupBy(F.get(F.split(column, ":"), F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))


def round_robin(items: DataFrame, key: str, n: int, within: list[str]) -> DataFrame:
    """items with part: in the order of key, those of each group `within` go in turn to parts 0 to n - 1.  Rows are numbered in range partitions, so that a few groups are no few tasks."""
    numbered = dense_ids(items, [*within, key], "_at")
    first = numbered.groupBy(*within).agg(F.min("_at").alias("_first"))
    return numbered.join(first, within).withColumn("part", ((F.col("_at") - F.col("_first")) % n).cast("int")).select(*items.columns, "part")


def systematic_sample(items: DataFrame, group: str, order: str, step: int = 5, most: int | None = None) -> DataFrame:
    """Every step-th row of each group, from the first, and of those the first `most`."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    wanted = F.col("_n") % step == 0
    return items.withColumn("_n", n).filter(wanted if most is None else wanted & (F.col("_n") < step * most)).drop("_n")


def runs(df: DataFrame, group: str, order: str, flag: Column) -> DataFrame:
    """group, first, last, length of each contiguous run of true flags (order: consecutive integers)."""
    w = Window.partitionBy(group).orderBy(order)
    true = df.withColumn("_f", flag).withColumn("_r", F.row_number().over(w)).filter("_f").withColumn("_island", F.col("_r") - F.row_number().over(w))
    return true.groupBy(group, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_island")


def mirror_difference(existing: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """key, state: stale rows exist and are not desired, missing ones the other way round."""
    stale = existing.join(desired, key, "left_anti").select(key, F.lit("stale").alias("state"))
    return stale.unionByName(desired.join(existing, key, "left_anti").select(key, F.lit("missing").alias("state")))


def page(items: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """One page of items in order; the number is clamped to the pages that there are."""
    n = items.count()
    last = max(0, -(-n // size) - 1)
    return items.orderBy(*order).offset(min(max(number, 0), last) * size).limit(size)
