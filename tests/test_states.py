"""Streams with typed state against the batch folds: several batches, restarts, a past that is folded in batch, late and repeated events."""

import random

import pytest

from sightline.operators import incremental as inc

pytest.importorskip("google.protobuf")  # the state's protocol

from sightline.streaming import states  # noqa: E402


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


DECISIONS = "individual long, sighting long, seq long, action string"
FLAGS = "key long, seq long, action string, pair string"
STEPS = "key string, seq long, action string"


class Stream:
    """A fold over a folder to which batches are written; every call of `run` starts the query anew from its checkpoint."""

    def __init__(self, spark, folder, ddl, fold):
        self.spark, self.folder, self.ddl, self.fold = spark, folder, ddl, fold

    def write(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def run(self):
        log = self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/log")
        out = []
        query = self.fold(log).writeStream.outputMode("update").foreachBatch(lambda batch, _: out.extend(batch.collect()))
        query = query.option("checkpointLocation", f"{self.folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return {r[0]: tuple(r[1:]) for r in out}


def batches_of(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def test_capped_decisions_after_restarts(spark, store, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(5), r.randrange(12), i, r.choice(("accept", "accept", "reject", "skip"))) for i in range(160)]
    rows = [(i, i * 100 + s, q, a) for i, s, q, a in rows]
    first, second, third, fourth = batches_of(rows, 4)
    past = spark.createDataFrame(first, DECISIONS)
    stream = Stream(spark, tmp_path, DECISIONS, lambda log: states.capped(log, 4, past))
    stream.write(second)
    stream.write(third)
    found = stream.run()
    # after a restart, late and redelivered events change nothing
    stream.write([*fourth, (0, 7777, 3, "accept"), *first[:10], (None, 1, 500, "accept"), (1, 1, None, "accept")])
    found |= stream.run()
    want = {i: [] for i in range(5)}
    for x in inc.fold_decisions_capped(spark.createDataFrame(rows, DECISIONS), 4).collect():
        want[x.individual].append(x.sighting)
    assert {i: v[0] for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert {i: v[1] for i, v in found.items()} == {i: max(q for k, _, q, _ in rows if k == i) for i in range(5)}
    assert sum(v[2] for v in found.values()) == 11


def test_toggled_flags_after_restarts(spark, store, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(6), i, r.choice(("flag", "flag", "pick", "reject")), r.choice("ab")) for i in range(140)]
    first, second, third = batches_of(rows, 3)
    for name, past, later in (("with", spark.createDataFrame(first, FLAGS), [second, third]), ("without", None, [first, second, third])):
        stream = Stream(spark, tmp_path / name, FLAGS, lambda log, past=past: states.toggled(log, past))
        found = {}
        for batch in later:
            stream.write(batch)
            found |= stream.run()
        stream.write([(0, 1, "flag", "a"), *second[:5]])  # late, and delivered again
        found |= stream.run()
        want = {x.key: (x.flagged, x.resolution) for x in inc.toggled_flags(spark.createDataFrame(rows, FLAGS)).collect()}
        assert {k: v[:2] for k, v in found.items() if v[0] is not None} == want
        assert sum(v[3] for v in found.values()) == 6


def test_lifecycle_in_any_order(spark, store, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("xyz"), i, r.choice(("analyse", "approve", "match", "match", "decide", "decide", "decide", "other"))) for i in range(120)]
    rows += [("late", 3, "decide"), ("late", 5, "decide"), ("late", 9, "decide"), ("late", 4, "approve"), ("none", 1, "other")]
    want = {x.key: tuple(x)[1:] for x in inc.lifecycle(spark.createDataFrame(rows, STEPS)).collect()}
    assert want["late"] == (None, 4, None, 5) and want["none"] == (None,) * 4
    for seed in range(2):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        first, second, third = batches_of(mixed, 3)
        stream = Stream(spark, tmp_path / str(seed), STEPS, lambda log, first=first: states.lifecycle(log, spark.createDataFrame(first, STEPS)))
        stream.write(second)
        found = stream.run()
        stream.write([*third, *second[:9]])
        # a key that only the past holds is given with its next event
        stream.write([(k, 0, "other") for k in want])
        found |= stream.run()
        assert found == want
