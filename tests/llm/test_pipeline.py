import random

import corpus_pipeline
from pyspark.sql import functions as F

from sightline.llm import near_texts
from sightline.llm.language_id import REJECT_RATE, held_out, labelled_samples
from tests.llm.helpers import sample_texts, table
from tests.llm.test_models import brute_language, invented


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    texts = sample_texts(80)
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    left = {r.doc_id: r.text for r in docs.collect()}
    # the first holder of a passage keeps it whole
    assert left[0] == texts[0]
    # exact copies are gone, and no 50 bytes stand in two documents
    assert 3 not in left or 2 not in left
    seen = {}
    for i, t in left.items():
        raw = t.encode()
        for p in range(len(raw) - 49):
            assert seen.setdefault(raw[p : p + 50], i) == i
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_language_stage_against_the_definition(spark, tmp_path):
    r = random.Random(5)
    texts = [invented(lang, 25, i) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    texts += ["".join(chr(r.randrange(0x4E00, 0x9000)) + " " for _ in range(40)) for _ in range(6)] + [None, "", "½ ² 77", "xqzj kvwp jjqx", "wh er", texts[0], texts[0]]
    docs = table(spark, texts, langs=["aa", "bb", "cc"] * 10 + [None] * 13)
    samples = labelled_samples(docs.filter(~held_out()))
    found = {i: brute_language(t, samples) for i, t in enumerate(texts)}
    want = [i for i, (lang, rate) in found.items() if lang != "und" and rate <= REJECT_RATE]
    got = dict(corpus_pipeline.STAGES)["language"](spark, docs, str(tmp_path))
    assert sorted(x.doc_id for x in got.collect()) == want and got.columns == docs.columns
    assert 30 <= len(want) < len(texts) - 6


def test_run_over_an_empty_table(spark, tmp_path):
    table(spark, []).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def five_words(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_stage_links_by_verified_similarity(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(30):  # copies with few or many changed words: similarities on both sides of 0.8, some only through others
        base = [word() for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            base = [word() if r.random() < r.choice((0.004, 0.015, 0.05)) else w for w in base]
            texts.append(" ".join(base))
    texts += ["", None, "two words", "TWO  words", "three small words"]
    sets = [five_words(t or "") for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    want = {i for i, v in enumerate(root) if v == i}
    assert 40 < len(want) < len(texts) - 40
    got = dict(corpus_pipeline.STAGES)["near"](spark, table(spark, texts), str(tmp_path)).collect()
    assert sorted(x.doc_id for x in got) == sorted(want)


def test_blocks_of_a_large_component_give_the_same_links(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(f"x{i}" if j == i else w for j, w in enumerate(base)) for i in range(90)] + ["quite another text of seven words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    monkeypatch.setattr(near_texts, "BLOCK", 7)
    found = near_texts.near_texts(rows).collect()
    assert {(x.node, x.root) for x in found} == {(i, 0) for i in range(90)}


def test_parts_of_a_candidate_component_meet_all_others(spark, monkeypatch):
    """One candidate component of chains of near copies: large parts, small ones and single texts, which drift apart and are found whatever block they are in."""
    monkeypatch.setattr(near_texts, "BLOCK", 5)
    for seed in range(3):
        r = random.Random(seed)
        word = lambda: f"w{r.randrange(10**7)}"  # noqa: E731, B023
        texts = []
        for size in (40, 23, 12, 6, 3, 1, 1, 1):
            base = [word() for _ in range(80)]
            for _ in range(size):
                base = [word() if r.random() < 0.012 else w for w in base]
                texts.append(" ".join(base))
        r.shuffle(texts)
        texts += ["", None]
        sets = [five_words(t or "") for t in texts]
        root = list(range(len(texts)))
        for b in range(len(texts)):
            for a in range(b):
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = root[a], root[b]
                    root = [min(x, y) if v in (x, y) else v for v in root]
        rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "coalesce(cast(text AS binary), X'') AS text")
        candidates = rows.selectExpr("0L AS root", "row")
        found = {x.node: x.root for x in near_texts.components(near_texts._verified(rows, candidates, 5)).collect()}
        assert [found.get(i, i) for i in range(len(texts))] == root and 8 <= len(set(root)) < 60


def test_connected_texts_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "BLOCK", 10)
    one = spark.range(1000).selectExpr("0L AS root", "id AS row", "0L AS part")
    assert near_texts._with_other_parts(one).count() == 0
    two = spark.range(1000).selectExpr("0L AS root", "id AS row", "CASE WHEN id % 100 = 7 THEN id ELSE 0L END AS part")
    met = near_texts._with_other_parts(two).selectExpr("sum(total - (until - since)) AS n", "max(total) AS total").first()
    assert met.total == 100 and met.n == 990 * 1 + 10 * 100


def test_null_and_repeated_rows_of_near_texts(spark):
    text = "a text of seven words or more than that"
    rows = spark.createDataFrame([(1, text), (2, text + " "), (2, text), (None, text), (None, text), (3, "quite another one of many more words")], "row long, text string")
    assert {(x.node, x.root) for x in near_texts.near_texts(rows).collect()} == {(1, 1), (2, 1)}


def brute_rows(rows):
    """What the stages before packing leave of (doc_id, text), one row for each that stays."""
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = {}
    for doc_id, text in rows:
        if any(c.isalpha() for c in text or ""):
            groups.setdefault("".join(text.split()), []).append((doc_id, text))
    kept = sorted((min(g, key=lambda r: (-len(r[1]), order(r))) for g in groups.values()), key=order)
    sets, root = [five_words(t) for _, t in kept], list(range(len(kept)))
    for b in range(len(kept)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
    return [r for i, r in enumerate(kept) if root[i] == i]


def awkward_rows():
    """Repeated rows, null doc_ids with copies of others and near copies among them, and one doc_id for several texts."""
    r = random.Random(11)
    sentence = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    base = [sentence(60) for _ in range(14)]
    near = " ".join(["changed", *base[5].split()[1:]])
    return (
        [(i, t) for i, t in enumerate(base[:8])]
        + [(3, base[3]), (3, base[3]), (4, base[8]), (4, base[9])]
        + [(None, t) for t in (base[0], base[10], base[10], base[11], near, None, "1 2 3")]
        + [(20, base[12]), (None, base[12])]
    )


def test_run_keeps_one_row_of_each_group_with_repeated_and_null_ids(spark, tmp_path):
    rows = awkward_rows()
    for name, langs in (("taught", ["en"] * len(rows)), ("untaught", [None] * len(rows))):
        sf = str(tmp_path / name)
        table(spark, [t for _, t in rows], [i for i, _ in rows], langs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
        want = brute_rows(rows)
        got = corpus_pipeline.run(spark, sf).filter("start = 0").select("doc_id").collect()
        assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in want)


def test_passages_of_rows_that_share_an_id_are_cut(spark, tmp_path):
    shared = "a passage of more than fifty bytes that stands in both of these rows"
    for ids in ([None, None], [7, 7]):
        docs = table(spark, [f"first text {shared} its end", f"another one {shared} and so on"], ids=ids)
        got = dict(corpus_pipeline.STAGES)["passages"](spark, docs, str(tmp_path)).collect()
        assert [x.doc_id for x in got] == ids and sum(shared in x.text for x in got) == 1


def test_columns_of_any_name_come_through(spark, tmp_path):
    extra = ["row", "row_", "id", "_row", "_id", "chunk", "rest", "found", "kept", "node", "ID_"]
    texts = [f"{w} text with words of its own, of which there are {i}" for i, w in enumerate(["an old", "a new", "one more"])]
    for ids in ([1, 2, 3], [4, 4, None]):
        rows = [(i, t, "en", "s", len(t), *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(zip(ids, texts))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == docs.columns
            assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, rows)), name


def test_components_of_edges_that_change_between_readings(spark):
    """Each reading of the edges is another tree of the same part."""
    from sightline.llm.simhash import components

    salt = F.rand()
    star = spark.range(1, 40).withColumn("_r", salt)
    edges = star.select(F.col("id").alias("a"), F.when(F.col("_r") < 0.5, F.lit(0)).otherwise(F.col("id") - 1).cast("long").alias("b"))
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == dict.fromkeys(range(40), 0)
