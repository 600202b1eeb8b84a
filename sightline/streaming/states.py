"""Folds of decision logs as streams with typed state.

The session's state store must be the RocksDB one (spark.sql.streaming.stateStore.providerClass).  A stream may begin where a batch fold of older events ends: give
that log as `past`.  Its events change nothing when the stream delivers them again.

Order.  `lifecycle` gives what the batch fold of all events gives, in whatever order and batches they come.  Capping and toggling depend on the order: within a
batch events are applied in the order of seq; one that is not newer than the newest applied to its key comes too late, changes nothing but the count `late`,
and so does an event that is delivered again.  Events without a key, or without a seq, are left out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.incremental import fold_decisions_capped, toggled_flags


def _streamed(log: DataFrame, key: str, processor: StatefulProcessor, ddl: str, start: DataFrame | None) -> DataFrame:
    rows = log.filter(F.col(key).isNotNull() & F.col("seq").isNotNull()).groupBy(key)
    return rows.transformWithStateInPandas(processor, ddl, "update", "none", None if start is None else start.groupBy(key))


def _kind(log: DataFrame, column: str) -> str:
    return log.schema[column].dataType.simpleString()


def _newest(log: DataFrame, key: str) -> DataFrame:
    return log.filter(F.col(key).isNotNull() & F.col("seq").isNotNull()).groupBy(key).agg(F.max(F.col("seq").cast("long")).alias("last"))


def _newer(rows: Iterator[pd.DataFrame], last: int | None, order: list[str]) -> tuple[pd.DataFrame, int]:
    """The rows after `last` in order, and the number of the others."""
    found = pd.concat(rows)
    new = found if last is None else found[found["seq"] > last]
    return new.sort_values(order, kind="stable"), len(found) - len(new)


def _none(value):
    """Missing values of pandas as None."""
    return None if pd.isna(value) else value


class _Capped(StatefulProcessor):
    """State: a map of the sightings accepted, and (newest seq, sightings held, late events)."""

    def __init__(self, cap: int, individual: str, sighting: str):
        self.cap, self.sighting = cap, sighting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", f"sighting {self.sighting}", "held boolean")
        self.place = handle.getValueState("place", "last long, held int, late long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        last, held, late = self.place.get() if self.place.exists() else (None, 0, 0)
        for sighting, newest in zip(initialState["sighting"].tolist(), initialState["last"].tolist()):
            last = int(newest) if last is None else max(last, int(newest))
            if _none(sighting) is not None and not self.kept.containsKey((sighting,)):
                self.kept.updateValue((sighting,), (True,))
                held += 1
        self.place.update((last, held, late))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, held, late = self.place.get() if self.place.exists() else (None, 0, 0)
        new, old = _newer(rows, last, ["seq", "sighting"])
        for seq, sighting, action in zip(new["seq"].tolist(), new["sighting"].tolist(), new["action"].tolist()):
            last = int(seq)
            if action not in ("accept", "reject") or _none(sighting) is None:
                continue
            there = self.kept.containsKey((sighting,))
            if action == "reject" and there:
                self.kept.removeKey((sighting,))
                held -= 1
            elif action == "accept" and not there and held < self.cap:
                self.kept.updateValue((sighting,), (True,))
                held += 1
        self.place.update((last, held, late + old))
        accepted = sorted(k[0] for k in self.kept.keys()) if held else []
        yield pd.DataFrame({"individual": [key[0]], "accepted": [accepted], "seq": [last], "late": [late + old]})

    def close(self) -> None:
        pass


def capped(log: DataFrame, cap: int = 10, past: DataFrame | None = None) -> DataFrame:
    """individual, accepted (in ascending order), seq, late: acceptances in force of each individual that a batch holds, as in fold_decisions_capped.

    log, past: individual, sighting, seq, action.  The state of an individual is at most `cap` sightings.  Events without a sighting only move seq."""
    who, what = _kind(log, "individual"), _kind(log, "sighting")
    start = None if past is None else _newest(past, "individual").join(fold_decisions_capped(past, cap), "individual", "left").select("individual", "last", "sighting")
    return _streamed(log.select("individual", "sighting", "seq", "action"), "individual", _Capped(cap, who, what), f"individual {who}, accepted array<{what}>, seq long, late long", start)


class _Toggled(StatefulProcessor):
    """State: (flagged pair, its resolution, newest seq, late events)."""

    def __init__(self, pair: str):
        self.pair = pair

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("flag", f"pair {self.pair}, resolution string, last long, late long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for pair, resolution, last in zip(initialState["flagged"].tolist(), initialState["resolution"].tolist(), initialState["last"].tolist()):
            self.flag.update((_none(pair), _none(resolution), int(last), 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flagged, resolution, last, late = self.flag.get() if self.flag.exists() else (None, None, None, 0)
        new, old = _newer(rows, last, ["seq"])
        for seq, action, pair in zip(new["seq"].tolist(), new["action"].tolist(), new["pair"].tolist()):
            last = int(seq)
            if action == "flag":
                flagged, resolution = (None if flagged == pair and resolution is None else _none(pair)), None
            elif action in ("pick", "reject") and flagged is not None and resolution is None:
                resolution = {"pick": "replaced", "reject": "rejected"}[action]
        self.flag.update((flagged, resolution, last, late + old))
        yield pd.DataFrame({"key": [key[0]], "flagged": [flagged], "resolution": [resolution], "seq": [last], "late": [late + old]})

    def close(self) -> None:
        pass


def toggled(log: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """key, flagged, resolution, seq, late: the flag of each key that a batch holds (nulls: none), as in toggled_flags.

    log, past: key, seq, action, pair.  Flagging no pair (null) takes a flag away."""
    who, what = _kind(log, "key"), _kind(log, "pair")
    start = None if past is None else _newest(past, "key").join(toggled_flags(past), "key", "left").select("key", "last", "flagged", "resolution")
    return _streamed(log.select("key", "seq", "action", "pair"), "key", _Toggled(what), f"key {who}, flagged {what}, resolution string, seq long, late long", start)


class _Lifecycle(StatefulProcessor):
    """State: the newest analysis, approval and match, and the list of decisions after both of the first two.

    A step that is not in force is kept out by comparing, so that all three are plain maxima; decisions are needed one by one, because a later analysis or approval may still
    clear the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "analysed long, approved long, matched long")
        self.decisions = handle.getListState("decisions", "seq long")

    def _add(self, found: dict[str, list[int]]) -> tuple:
        before = self.newest.get() if self.newest.exists() else (None, None, None)
        now = tuple(max([*([] if b is None else [b]), *found[a]], default=None) for a, b in zip(("analyse", "approve", "match"), before))
        since = max((s for s in now[:2] if s is not None), default=-1)
        held = {s[0] for s in self.decisions.get()} if self.decisions.exists() else set()
        left = sorted(s for s in held | set(found["decide"]) if s > since)
        self.newest.update(now)
        if left:
            self.decisions.put([(s,) for s in left])
        elif held:
            self.decisions.clear()
        analysed, approved, matched = now
        in_force = lambda s, after: s if s is not None and s > (-1 if after is None else after) else None
        return in_force(analysed, None), in_force(approved, analysed), in_force(matched, since), left[0] if left else None

    def handleInitialState(self, key, initialState, timerValues) -> None:
        steps = {"analyse": "analysed", "approve": "approved", "match": "matched", "decide": "decision"}
        self._add({a: [int(s) for s in initialState[c].dropna()] for a, c in steps.items()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {"analyse": [], "approve": [], "match": [], "decide": []}
        for batch in rows:
            for action, seqs in batch.groupby("action")["seq"]:
                if action in found:
                    found[action] = sorted({*found[action], *seqs.tolist()}) if action == "decide" else [max([*found[action], int(seqs.max())])]
        out = self._add(found)
        yield pd.DataFrame({"key": [key[0]]} | {c: pd.array([v], "Int64") for c, v in zip(("analysed", "approved", "matched", "decided"), out)})

    def close(self) -> None:
        pass


def _steps(log: DataFrame) -> DataFrame:
    """key, analysed, approved, matched (newest of each), decision (one row for each decision after the first two, or null)."""
    at = lambda action: F.max(F.when(F.col("action") == action, F.col("seq").cast("long")))
    newest = log.filter(F.col("key").isNotNull() & F.col("seq").isNotNull()).groupBy("key").agg(at("analyse").alias("analysed"), at("approve").alias("approved"), at("match").alias("matched"))
    decisions = log.filter("action = 'decide'").select("key", F.col("seq").cast("long").alias("decision")).distinct()
    since = F.coalesce(F.greatest("analysed", "approved"), F.lit(-1))
    later = decisions.join(newest, "key").filter(F.col("decision") > since).select("key", "decision")
    return newest.join(later, "key", "left")


def lifecycle(log: DataFrame, past: DataFrame | None = None) -> DataFrame:
    """key, analysed, approved, matched, decided of each key that a batch holds: sequence numbers (from 0) of the steps in force, as in the batch fold, whatever the order of arrival.

    log, past: key, seq, action.  The state holds a key's decisions since its approval or analysis."""
    steps = ", ".join(f"{c} long" for c in ("analysed", "approved", "matched", "decided"))
    return _streamed(log.select("key", "seq", "action"), "key", _Lifecycle(), f"key {_kind(log, 'key')}, {steps}", None if past is None else _steps(past))
