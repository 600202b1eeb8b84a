"""Readers, and folds over streams of files."""

import pytest
from pyspark.sql import functions as F

from sightline.sources import tables as src
from sightline.streaming import folds


def test_exact_header(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("photo_id,sighting_id,date,name,image_path\na,b,2024-01-01,Ada,x.jpg\n")
    bad.write_text("photo_id,date,sighting_id,name,image_path\na,b,c,d,e\n")
    assert src.read_photos(spark, str(good)).first().name == "Ada"
    with pytest.raises(Exception, match="(?i)header|column"):
        src.read_photos(spark, str(bad)).collect()


def test_photo_bytes(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"12")
    photos = spark.createDataFrame([("p", "a.jpg"), ("q", "none.jpg"), ("r", None)], "photo_id string, image_path string")
    got = {r.photo_id: (r.status, r.content) for r in src.photo_bytes(photos, str(tmp_path)).collect()}
    assert got["p"] == ("ok", bytearray(b"12")) and got["q"][0] == "missing" and got["r"][0] == "unmapped"
    assert [r.path.rsplit("/", 1)[1] for r in src.list_photos(spark, str(tmp_path)).collect()] == ["a.jpg"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "name string, sighting long")
    src.write_manifest(df, str(tmp_path / "m"))
    assert [r.name for r in spark.read.option("header", True).csv(str(tmp_path / "m")).collect()] == ["a", "b"]
    assert src.metrics_json(spark.createDataFrame([(0.5, 2)], "top1 double, n int")).first().json == '{"top1":0.5,"n":2.0}'
    src.write_coco(df, df, df, str(tmp_path / "coco"))
    assert spark.read.json(str(tmp_path / "coco/images")).count() == 2


LOG = "individual long, sighting long, seq long, action string"


def write_batches(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, LOG).coalesce(1).write.mode("append").parquet(path)


def run(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_running_and_capped_decisions(spark, tmp_path):
    path = str(tmp_path / "log")
    write_batches(spark, path, [(1, 10, 1, "accept"), (1, 11, 2, "accept"), (1, 12, 3, "accept")], [(1, 10, 4, "reject"), (2, 20, 5, "accept")])
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 10).parquet(path)
    run(folds.running_decisions(stream()), "running", "complete")
    assert {r.sighting: r.action for r in spark.table("running").collect()} == {10: "reject", 11: "accept", 12: "accept", 20: "accept"}
    run(folds.capped_decisions(stream(), 2), "capped", "update")
    got = {r.individual: r.accepted for r in spark.table("capped").collect()}
    assert got == {1: [11], 2: [20]}


def test_match_arrivals(spark, tmp_path):
    path = str(tmp_path / "log")
    write_batches(spark, path, [(1, 10, 1, "accept")], [(2, 20, 5, "accept")])
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    catalog = spark.createDataFrame([(1, 0.5), (2, 0.7)], "individual long, score double")
    q = folds.match_arrivals(stream, catalog, lambda b, c: b.join(c, "individual").select("sighting", "score"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.sighting, r.score) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(10, 0.5), (20, 0.7)}
    counted = folds.windowed_counts(spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:00:50", 1)], "ts string, k int").withColumn("ts", F.to_timestamp("ts")), "ts", "1 minute", "1 minute", "k")
    assert counted.first().n == 2


def test_arrivals_are_held_to_the_score_contract(spark, tmp_path):
    path = str(tmp_path / "log")
    write_batches(spark, path, [(1, 10, 1, "accept")], [(2, 20, 5, "accept")])
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path).withColumnRenamed("sighting", "query")
    catalog = spark.createDataFrame([("a", 5), ("b", 6)], "candidate string, sighting long")
    whole = lambda q, c: q.select("query").join(c.select("candidate").hint("broadcast")).withColumn("score", F.lit(0.5))
    folds.match_arrivals(stream, catalog, whole, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    partial = lambda q, c: whole(q, c).filter("candidate = 'a'")
    with pytest.raises(Exception, match="one finite score"):
        folds.match_arrivals(stream, catalog, partial, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination(120)


def test_photo_bytes_below_an_odd_folder(spark, tmp_path):
    folder = tmp_path / "a+b (1)"
    (folder / "x").mkdir(parents=True)
    (folder / "x" / "one.jpg").write_bytes(b"123")
    photos = spark.createDataFrame([(1, "x/one.jpg"), (2, "x/two.jpg"), (3, None)], "photo_id int, image_path string")
    assert {r.photo_id: r.status for r in src.photo_bytes(photos, str(folder)).collect()} == {1: "ok", 2: "missing", 3: "unmapped"}


def test_review_export_protects_photos_of_selected_individuals(spark):
    pairs = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 1, 2), ("c", 4, 1, 9)], "name string, sighting long, left_line int, right_line int")
    crops = spark.createDataFrame([(s, k, 0.5 * k, [s, k]) for s in (1, 2, 3, 4) for k in (1, 2)], "sighting long, line int, score double, box array<long>")
    photos = spark.createDataFrame([("a", 1, "p1"), ("a", 3, "p3"), ("b", 3, "p4"), ("c", 4, "p5"), (None, 5, "p6")], "name string, sighting long, photo string")
    print_of = lambda df: src.table_fingerprint(df).first()[0]
    state = src.table_fingerprint(crops).withColumn("revision", F.lit(7))
    got = sorted(map(tuple, src.review_export(pairs, crops, photos, state).collect()), key=str)
    pair = lambda s: '{"left":{"score":0.5,"box":[%d,1]},"right":{"score":1.0,"box":[%d,2]}}' % (s, s)
    head = '{"schema_version":1,"fingerprint":"%s","revision":7}' % print_of(crops)
    want = [("pair", "a", 1, None, pair(1)), ("pair", "a", 2, None, pair(2)), ("selected", "a", None, None, None), ("excluded", "a", 1, "p1", None), ("excluded", "a", 3, "p3", None), ("review", None, None, None, head)]
    assert got == sorted(want, key=str)
    assert print_of(crops) == print_of(crops.repartition(5).orderBy("score")) != print_of(crops.union(crops.limit(1)))
    assert print_of(crops.limit(0)) == print_of(crops.filter("line > 5")) and src.review_export(pairs.limit(0), crops, photos, state).count() == 1
