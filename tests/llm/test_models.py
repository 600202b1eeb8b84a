import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import katz
from sightline.llm.language_id import CrossParser, SuffixAutomaton, held_out, keep_identified, labelled_samples, language_id
from sightline.llm.sharding import deal, read_map, rebalance, shard, slot_totals, store_map, with_slots
from sightline.llm.topk_search import ImpactIndex, quantised, top_k, top_k_of_every
from tests.llm.helpers import sample_texts, table


def test_suffix_automaton_parses_longest_phrases():
    r = random.Random(8)
    for _ in range(60):
        model = "".join(r.choice("abc ") for _ in range(r.randrange(1, 60)))
        text = "".join(r.choice("abcd ") for _ in range(r.randrange(0, 50)))
        count, i = 0, 0
        while i < len(text):
            n = 0
            while i + n < len(text) and text[i : i + n + 1] in model:
                n += 1
            i += max(1, n)
            count += 1
        assert SuffixAutomaton(model).phrases(text) == count


def invented(lang, n, seed):
    r = random.Random(seed)
    parts = {"aa": ["tion", "the", "ing", "er", "wh"], "bb": ["ung", "sch", "ein", "ver", "ä"], "cc": ["ción", "que", "os", "ñ", "ez"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_documents(spark):
    langs = ["aa", "bb", "cc"] * 60
    texts = [invented(lang, 30, i) for i, lang in enumerate(langs)]
    extra = [None, "", "123 !!", "\t\n"]
    rows = {r.doc_id: r for r in language_id(table(spark, texts + extra, langs=langs + [None, "aa", None, "zz"])).collect()}
    out = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in rows if rows[i].held_out} >= set(out)
    assert sum(rows[i].lang_pred == langs[i] for i in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[len(texts) + k].lang_pred for k in range(4)] == ["und"] * 4
    kept = keep_identified(table(spark, texts + extra, langs=langs + [None, "aa", None, "zz"]))
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts)))


def brute_language(text, samples):
    """Language, and its phrases for each code point, by the definition: the longest substrings of the sample, word by word."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    if not words or not samples:
        return "und", 1.0
    best = []
    for lang, sample in samples:
        n = 0
        for word in words:
            rest = " " + word
            while rest:
                m = 1
                while m < len(rest) and rest[: m + 1] in sample:
                    m += 1
                rest, n = rest[m:], n + 1
        best.append((n, lang))
    return min(best)[1], min(best)[0] / sum(len(w) + 1 for w in words)


def test_language_id_query_against_the_definition(spark):
    langs = ["aa", "bb", "cc"] * 12
    texts = [invented(lang, 20, i) for i, lang in enumerate(langs)] + ["½ ²", "Ⅷ ①", "x½y ver", "ver² sch", None, "", "12 _ !", "漢字 ñ", "ein " * 30_000]
    docs = table(spark, texts, langs=langs + [None] * 9)
    samples = labelled_samples(docs.filter(~held_out()))
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: brute_language(t, samples)[0] for i, t in enumerate(texts)}
    assert [got[36 + k].lang_pred for k in (0, 1, 4, 5, 6)] == ["und"] * 5 and [got[36 + k].score for k in (0, 1)] == [0, 0]


def test_many_languages_are_all_learned(spark, monkeypatch):
    import sightline.llm.language_id as module

    monkeypatch.setattr(module, "ALL_CHARS", 3000)
    rows = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}rd " * 4 for i in range(300)]
    got = labelled_samples(table(spark, rows, langs=[f"l{i:03}" for i in range(300)]))
    assert len(got) == 300 and all(0 < len(t) <= 10 for _, t in got)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 12345, lambda i: 1, lambda i: -i % 3])
def test_labels_are_learned_whatever_the_ids(spark, ids):
    texts = [invented(lang, 30, i) for i, lang in enumerate(["aa", "bb", "cc"] * 12)] + ["zkwy qqpv jjux " * 20] * 40
    langs = ["aa", "bb", "cc"] * 12 + ["dd"] * 40
    docs = table(spark, texts, [ids(i) for i in range(len(texts))], langs)
    samples = labelled_samples(docs.filter(~held_out()))
    assert [lang for lang, text in samples if text] == ["aa", "bb", "cc", "dd"]
    got = language_id(docs).collect()
    assert {r.lang_pred for r in got} == {"aa", "bb", "cc", "dd"} and len(got) == len(texts)


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr("sightline.llm.language_id.MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="labels"):
        labelled_samples(table(spark, ["ab"] * 4, langs=list("abcd")))


def test_language_stage_keeps_clashing_columns(spark):
    docs = table(spark, ["aber die eine", "the one"], langs=["de", "en"]).withColumn("found", F.lit("mine")).withColumn("FOUND_", F.lit(3))
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {(r["found"], r["FOUND_"]) for r in kept.collect()} == {("mine", 3)}


def test_language_id_without_labels(spark):
    assert {r.lang_pred for r in language_id(table(spark, ["abc", "d"], langs=[None, None])).collect()} == {"und"}
    assert language_id(table(spark, []).limit(0)).count() == 0
    assert CrossParser([]).predict("abc")[0] == "und"


def brute_katz(docs, order=3):
    """Scores by the definition, over dictionaries of n-grams; checks that distributions sum to one."""
    k = katz.K
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in docs}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = lambda t, n: list(zip(*([None] * (n - 1 - j) + t for j in range(n))))
    counts = {n: Counter(g for t in train for g in grams(t, n)) for n in range(1, order + 1)}
    one = Counter({g[0]: c for g, c in counts[1].items()})
    n, types = sum(one.values()), len(one)
    of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, k + 2)], float)
    d = {j: katz.discounts(of(c), n) for j, c in counts.items()}
    paid = lambda j, c: (d[j][c] if c <= k else 1) * c
    left = sum(c - paid(1, c) for c in one.values())
    extra = 0 if left > 0 else 1
    unknown = (left + extra) / (n + extra)
    contexts = defaultdict(dict)
    for j in range(2, order + 1):
        for g, c in counts[j].items():
            contexts[g[:-1]][g[-1]] = c

    def p(context, w):
        if not context:
            return paid(1, one[w]) / (n + extra) if one[w] else unknown
        seen = contexts.get(context)
        if not seen:
            return p(context[1:], w)
        total, j = sum(seen.values()) + all(c > k for c in seen.values()), len(context) + 1
        if w in seen:
            return paid(j, seen[w]) / total
        if context not in weights:
            weights[context] = (total - sum(paid(j, c) for c in seen.values())) / total / (1 - sum(p(context[1:], v) for v in seen))
        return weights[context] * p(context[1:], w)

    weights = {}
    for context in list(contexts)[:: max(1, len(contexts) // 40)]:
        assert abs(sum(p(context, w) for w in one) + p(context, b"unknown token") - 1) < 1e-9
    score = lambda t: sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order))
    return {i: (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + types + 1)) for w in t), score(t)) for i, t in tokens.items()}


@pytest.mark.parametrize("order, chunk_bytes, hot", [(3, 2000, 2.0), (3, 1 << 23, 2.0), (3, 3000, 0.0), (2, 2000, 1.0)])
def test_katz_against_brute_force(spark, monkeypatch, order, chunk_bytes, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "LEAST_OWNERS", 3)
    texts = sample_texts(120) + ["the of and"] * 30 + ["x1 re-do x1 re-do A"] * 25
    want = brute_katz(list(enumerate(texts)), order)
    got = katz.katz_scores(table(spark, texts), order=order, chunk_bytes=chunk_bytes, range_bytes=4000).collect()
    assert len(got) == len(texts)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)


def test_katz_edge_cases(spark):
    assert katz.katz_scores(table(spark, []).limit(0)).count() == 0
    rows = katz.katz_scores(table(spark, [None, "", "A a"], ids=[None, 1, 1])).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) for r in rows)
    only_held_out = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = katz.katz_scores(table(spark, ["a b", "c", None], ids=only_held_out)).collect()
    assert {(r.train_tokens, r.score, r.n_known) for r in rows} == {(0, 0.0, 0)}


def test_shards(spark, tmp_path):
    texts = sample_texts(400)
    docs = table(spark, texts, ids=[*range(len(texts) - 1), None])
    rows = shard(docs, 7, path=str(tmp_path / "map")).collect()
    assert len(rows) == len(texts)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] if r.doc_id is not None else texts[-1]) or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode()) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(load) == set(range(7)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    biggest = max(r.size for r in rows)
    assert max(load.values()) - min(load.values()) <= biggest
    again = {(r.doc_id, r.shard, r.slot) for r in shard(docs, 7, path=str(tmp_path / "again")).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert shard(docs.limit(0), 7, path=str(tmp_path / "none")).count() == 0


def test_rebalancing_edits_few_slots(spark, tmp_path):
    totals = slot_totals(with_slots(table(spark, sample_texts(500))))
    old = deal(totals, 6)
    new = rebalance(totals, old, 7)
    moved = [s for s in old if old[s] != new[s]]
    assert {new[s] for s in moved} == {6}
    load = Counter()
    for slot, size, _ in totals:
        load[new[slot]] += size
    assert load[6] > 0 and set(load) == set(range(7))
    store_map(spark, str(tmp_path / "m"), 0, totals, old)
    store_map(spark, str(tmp_path / "m"), 1, totals, new)
    assert {r.slot: r.shard for r in read_map(spark, str(tmp_path / "m")).collect()} == new
    assert {r.slot: r.shard for r in read_map(spark, str(tmp_path / "m"), 0).collect()} == old


def test_shards_of_repeated_and_missing_ids_are_balanced(spark):
    docs = table(spark, [f"text number {i} " * 9 for i in range(900)], ids=[None] * 450 + [7] * 450)
    sizes = Counter()
    for r in shard(docs, 10).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 10 and max(sizes.values()) < 1.3 * min(sizes.values())


def test_storing_a_map_again_changes_nothing(spark, tmp_path):
    totals = [(0, 10, 1), (5, 20, 2), (9, 5, 1)]
    for _ in range(2):
        store_map(spark, str(tmp_path / "map"), 0, totals, deal(totals, 2))
    assert read_map(spark, str(tmp_path / "map")).count() == 3
    store_map(spark, str(tmp_path / "map"), 1, totals, deal(totals, 3))
    assert {r.version for r in read_map(spark, str(tmp_path / "map")).collect()} == {1}


def test_top_k_against_all_pairs(spark):
    r = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in r.normal(size=12) / 3], 0) for i in range(160)]
    vectors += [(200, None, 0), (220, [None] * 12, 0), (240, [float("nan")] * 12, 0), (260, [float("inf")] + [0.0] * 11, 0), (280, [0.0] * 12, 0)]
    vectors += [(300 + i, vectors[0][1], 0) for i in range(30)] + [(0, vectors[5][1], 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for blocks in ({}, {"candidate_rows": 25, "query_rows": 3}):
        v = quantised(df)
        rows = top_k(v, v.filter("vec_id % 20 = 0 AND vec_id <> 0"), 7, **blocks).collect()
        got = defaultdict(list)
        for x in rows:
            got[x.query_id].append((x.rank, x.vec_id, x.score))
        queries = [(i, q) for i, q in ok if i % 20 == 0 and i]
        assert set(got) == {i for i, _ in queries}
        for i, q in queries:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:7]
            assert [(-s, j) for s, j in best] == [(s, j) for _, j, s in sorted(got[i])]
    assert top_k_of_every(df.limit(0)).count() == 0
    assert top_k_of_every(df.filter("vec_id in (20, 21)")).count() == 1


def test_top_k_of_large_components(spark):
    vectors = [(0, [1e9, -3e12, 2.0]), (1, [1e9, 5e11, -1.0]), (2, [-1e9, 1e12, 3.5]), (3, [1e300, 0.0, 0.0]), (4, [float(2**56), 1.0, 0.5]), (20, [1.0, -1e9, 7.0])]
    rows = top_k_of_every(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=4).collect()
    longs = {i: [min(max(math.floor(64 * x), -(2**63)), 2**63 - 1) for x in v] for i, v in vectors}
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for i in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(longs[i], c)), j) for j, c in longs.items() if j != i)[:4]
        assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == i] == [(j, clip(-s)) for s, j in best]


def test_search_stops_on_proof():
    r = np.random.default_rng(9)
    rows = np.floor(64 * r.normal(size=(6000, 16)) / 4).astype(np.int64)
    index = ImpactIndex(np.arange(6000), rows)
    for i in range(0, 6000, 300):
        ids, score = index.best(i, rows[i], 10)
        want = sorted(((-int(s), j) for j, s in enumerate(rows @ rows[i]) if j != i))[:10]
        assert [(-int(s), int(j)) for j, s in zip(ids, score)] == want
    assert index.read < 0.8 * 20 * rows.size and index.scored < 0.2 * 20 * len(rows)
