"""Folds and matching over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.evaluation import checked


def running_decisions(log: DataFrame) -> DataFrame:
    """sighting, action, seq of the newest decision; the aggregate's state is one row for each sighting."""
    return log.groupBy("sighting").agg(F.max_by(F.struct("action", "seq"), "seq").alias("r")).select("sighting", "r.action", "r.seq")


def capped_decisions(log: DataFrame, cap: int = 10) -> DataFrame:
    """individual, accepted: acceptances in force, at most `cap` for each individual, in the order of seq within each batch.

    The state is an individual's list of at most `cap` sightings."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values("seq")
        for sighting, action in zip(rows["sighting"].tolist(), rows["action"].tolist()):
            if action == "reject" and sighting in kept:
                kept.remove(sighting)
            elif action == "accept" and sighting not in kept and len(kept) < cap:
                kept.append(sighting)
        state.update((kept,))
        yield pd.DataFrame({"individual": [key[0]], "accepted": [kept]})

    return log.groupBy("individual").applyInPandasWithState(step, "individual long, accepted array<long>", "kept array<long>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, lateness: str, width: str, *keys: str) -> DataFrame:
    """Events in tumbling windows; late ones are dropped behind the watermark."""
    w = events.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def match_arrivals(arrivals: DataFrame, catalog: DataFrame, match: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new sightings is matched with the catalog; its scores replace what an earlier try of the batch wrote.

    A batch with the columns of queries (query) and a catalog of candidates (candidate, sighting) are held to the score contract: a matcher that breaks it fails the
    query before anything of the batch is written."""
    contract = "query" in arrivals.columns and "candidate" in catalog.columns

    def write(batch: DataFrame, epoch: int) -> None:
        scores = checked(match, batch, catalog) if contract and batch.limit(1).count() else match(batch, catalog)
        scores.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
