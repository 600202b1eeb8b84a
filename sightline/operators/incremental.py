"""Tables that grow: producer tables, upserts, decision folds, catalog growth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get_or_compute(inputs: DataFrame, stored: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame], valid=None) -> tuple[DataFrame, DataFrame]:
    """(all rows for the inputs, the new ones to append): only keys that are not stored, or whose stored row is not valid, are computed."""
    good = stored if valid is None else stored.filter(valid)
    fresh = compute(inputs.join(good, key, "left_anti"))
    return good.join(inputs.select(*key), key, "left_semi").unionByName(fresh), fresh


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """target with the rows of changes in place of those with equal keys; rows of changes with a true `deleted` go."""
    new = changes if deleted is None else changes.filter(~F.col(deleted)).drop(deleted)
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(new)


def last_event(log: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, by one aggregate."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("_r")).select(key, "_r.*")


def fold_decisions(log: DataFrame) -> DataFrame:
    """sighting, action, seq, superseded: the newest decision of each sighting and how many acceptances it replaced."""
    newest = log.groupBy("sighting").agg(F.max_by(F.struct("seq", "action"), "seq").alias("r"), F.count_if(F.col("action") == "accept").alias("accepts"))
    return newest.select("sighting", "r.action", "r.seq", (F.col("accepts") - (F.col("r.action") == "accept").cast("long")).alias("superseded"))


def fold_events(log: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, step: Callable, rows: Callable, ddl: str) -> DataFrame:
    """What is left of each key's events: state = step(state, *values of columns) in order, from start(), and then rows(key, state), tuples for ddl.

    Events stream through a task in the order of key and `order`, and only one key's state is held, so that no key's events are gathered, however
    many they are.  Events without a key are left out."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        at, state, fresh = None, None, True

        for batch in batches:
            out: list[tuple] = []
            for who, *values in zip(*(batch.column(i).to_pylist() for i in range(len(columns) + 1))):
                if fresh or who != at:
                    out.extend([] if fresh else rows(at, state))
                    at, state, fresh = who, start(), False
                state = step(state, *values)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if not fresh and (out := rows(at, state)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = log.filter(F.col(key).isNotNull()).select(key, *columns, *[c for c in order if c not in columns and c != key])
    return needed.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, ddl)


def _ddl(log: DataFrame, **columns: str) -> str:
    """A schema of columns with the types that those of the log have."""
    return ", ".join(f"{name} {log.schema[source].dataType.simpleString()}" for name, source in columns.items())


def fold_decisions_capped(log: DataFrame, cap: int = 10) -> DataFrame:
    """individual, sighting: acceptances in force when, in the order of seq, an individual takes at most `cap` at a time.

    log: individual, sighting, seq, action."""

    def step(kept: list, sighting, action) -> list:
        if action == "reject":
            return [s for s in kept if s != sighting]
        return [*kept, sighting] if action == "accept" and sighting not in kept and len(kept) < cap else kept

    return fold_events(log, "individual", ["seq", "sighting"], ["sighting", "action"], list, step, lambda who, kept: [(who, s) for s in kept], _ddl(log, individual="individual", sighting="sighting"))


def toggled_flags(log: DataFrame) -> DataFrame:
    """key, flagged, resolution: the flag of each key, if there is one.

    log: key, seq, action, pair.  Flagging the flagged pair while its flag is pending takes the flag away; any other flagging sets a pending flag.  A pick or
    reject resolves a pending flag, which then stays with its resolution."""

    def step(flag, action, pair):
        if action == "flag":
            return None if flag == (pair, None) else (pair, None)
        return (flag[0], {"pick": "replaced", "reject": "rejected"}[action]) if flag and flag[1] is None and action in ("pick", "reject") else flag

    rows = lambda key, flag: [(key, *flag)] if flag else []
    return fold_events(log, "key", ["seq"], ["action", "pair"], lambda: None, step, rows, f"{_ddl(log, key='key', flagged='pair')}, resolution string")


def lifecycle(log: DataFrame) -> DataFrame:
    """key, analysed, approved, matched, decided: sequence numbers of the steps in force.

    An analysis clears the approval, the match and the decision before it; an approval clears the match and the decision.  Of matches the newest stands, of decisions
    the first one after the approval, which alone can be made."""
    at = lambda action, after: F.when((F.col("action") == action) & (F.col("seq") > after), F.col("seq"))
    none = F.lit(-1).cast("long")
    steps = log.groupBy("key").agg(F.max(at("analyse", none)).alias("analysed"))
    base = log.join(steps, "key")
    approved = base.groupBy("key", "analysed").agg(F.max(at("approve", F.coalesce("analysed", none))).alias("approved"))
    base = log.join(approved, "key")
    since = F.coalesce(F.greatest("analysed", "approved"), none)
    return base.groupBy("key", "analysed", "approved").agg(F.max(at("match", since)).alias("matched"), F.min(at("decide", since)).alias("decided"))


def restorable(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """Snapshots (key, fingerprint, revision) whose fingerprint is the current one and whose revision is not older."""
    now = current.select("key", F.col("fingerprint").alias("_f"), F.col("revision").alias("_r"))
    return snapshots.join(now, "key").filter((F.col("fingerprint") == F.col("_f")) & (F.col("revision") >= F.col("_r"))).drop("_f", "_r")


def replay_order(decisions: DataFrame, by: str) -> DataFrame:
    return decisions.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("seq")).cast("long"))
