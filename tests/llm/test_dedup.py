import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import common
from sightline.llm.common import chunked, golomb_decode, golomb_encode, pack, unpack
from sightline.llm.exact_dedup import WHITE, exact_dedup
from sightline.llm.simhash import Forest, components, links, near_duplicates, trie_pairs
from sightline.llm.suffix_dedup import COVER, RESIDUES, equal_windows, removed_spans
from tests.llm.helpers import sample_texts, table


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for values in ([], [0], [5, 5, 5], [0, 2**63], sorted(r.integers(0, 2**40, 1000).tolist()), list(range(100))):
        assert golomb_decode(golomb_encode(np.array(values, np.uint64))).tolist() == values
    a, b = unpack(pack(np.arange(3), b"xyz"))
    assert a.tolist() == [0, 1, 2] and b.tobytes() == b"xyz"


def test_exact_dedup_against_grouping(spark):
    texts = sample_texts()
    got = {r.doc_id: r for r in exact_dedup(table(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").encode().translate(None, WHITE), []).append((-len(t or ""), i))
    assert len(got) == len(texts)
    for normal, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(members), i == keep, hashlib.sha256(normal).hexdigest())


def test_exact_dedup_of_nothing_and_null_ids(spark):
    assert exact_dedup(table(spark, []).limit(0)).count() == 0
    rows = exact_dedup(table(spark, ["b", "b", "c"], ids=[None, 4, None])).collect()
    assert {(r.doc_id is None, r.keep_id, r.group_size) for r in rows} == {(False, 4, 2), (True, None, 1), (True, 4, 2)}


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    texts = ["x y", "xy", "xy ", "x y", None, "", "z"]
    rows = exact_dedup(table(spark, texts, ids=[1, 1, 1, 1, None, None, None])).collect()
    assert sorted((r.text_sha256, r.group_size) for r in rows if r.kept) == sorted((hashlib.sha256(t).hexdigest(), n) for t, n in ((b"xy", 4), (b"", 2), (b"z", 1)))


def test_exact_dedup_of_many_chunks_and_one_long_text(spark, monkeypatch):
    import sightline.llm.exact_dedup as module

    monkeypatch.setattr(module, "chunked", lambda docs, text: chunked(docs, text, chunk_bytes=1 << 9))
    texts = sample_texts() + ["w " * 300_000]  # one text is much longer than a chunk
    rows = exact_dedup(table(spark, texts)).collect()
    groups = {(t or "").encode().translate(None, WHITE) for t in texts}
    assert len(rows) == len(texts) and sum(r.kept for r in rows) == len(groups)


def test_groups_larger_than_the_rest_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_GROUPS", 1)
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else "c") for i in range(30)], "row long, k string")
    groups = spark.createDataFrame([("a", 20, 1), ("b", 5, None)], "k string, n long, v int")
    got = common.join_groups(rows, groups, "k", "n", F.col("row")).collect()
    assert sorted((r.row, r.n, r.v) for r in got if r.n) == [(i, 20, 1) if i % 3 else (i, 5, None) for i in range(30) if i % 3 or i % 2]
    assert len(got) == 30


def brute_removed(rows, length):
    first = {}
    rows = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, float("inf")), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes, hot_runs", [(1 << 9, 2), (1 << 12, None), (1 << 23, None), (1 << 12, 0), (1 << 13, 4)])
def test_suffix_dedup_against_brute_force(spark, chunk_bytes, hot_runs):
    texts = sample_texts()
    got = removed_spans(table(spark, texts), chunk_bytes=chunk_bytes, hot_runs=hot_runs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(list(enumerate(texts)), 50)


def test_suffix_dedup_of_negative_ids(spark):
    texts = sample_texts()
    ids = [i - 40 for i in range(len(texts))][::-1]
    for hot_runs in (0, None):
        got = removed_spans(table(spark, texts, ids), chunk_bytes=1 << 10, hot_runs=hot_runs).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(list(zip(ids, texts)), 50)


def test_windows_that_share_a_hash_stay_apart(monkeypatch):
    import sightline.llm.suffix_dedup as module
    from sightline.llm.common import Chunk

    r = np.random.default_rng(2)
    texts = [r.integers(97, 100, 90).astype(np.uint8).tobytes() for _ in range(6)]
    texts += texts[:2]
    chunk = Chunk(pa.table({"doc_id": pa.array(range(8), pa.int64()), "text": pa.array(texts, pa.binary())}))
    anchors = module.Anchors(chunk, 50, 18)
    monkeypatch.setattr(module, "gram_hashes", lambda data, k: data[: max(0, data.size - k + 1)].astype(np.uint64) % np.uint64(2))
    windows = module.HotWindows(chunk, anchors, np.arange(anchors.hash.size), 50)
    flat = chunk.data.tobytes()
    names = [flat[a : a + 50] for a in windows.at.tolist()]
    assert len(set(zip(names, windows.window.tolist()))) == len(set(names)) == windows.hash.size
    assert all(flat[f : f + 50] == name for name, f in zip(names, windows.first[windows.window].tolist()))
    assert (np.diff(windows.hash.astype(np.int64)) >= 0).all()


def test_suffix_dedup_edge_cases(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(120))
    inf = float("inf")
    for ids in ([3, None, 3, 9, 9], [-5, 3, -5, -300, 7], [-1, -(2**62), -3, 2**61, None]):
        rows = list(zip(ids, [text, text, text, text[:49], "é" * 40 + text[10:70]]))
        got = removed_spans(table(spark, [t for _, t in rows], ids=ids)).collect()
        assert sorted((inf if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(rows, 50)
    assert removed_spans(table(spark, []).limit(0)).count() == 0
    assert removed_spans(table(spark, [None, ""])).count() == 2


def test_whole_points_keep_utf8(spark):
    a = "x" + "é" * 60
    got = removed_spans(table(spark, [a, "é" * 60 + "ü"]), keep_bytes=True, whole_points=True, carry=["lang"]).collect()
    for r in got:
        bytes(r.kept).decode("utf-8")
    assert {r.rest.lang for r in got} == {"en"}


def test_cover_and_equal_windows():
    assert all(any((a + d) % COVER in RESIDUES and (b + d) % COVER in RESIDUES for d in range(COVER)) for a in range(COVER) for b in range(COVER))
    r = np.random.default_rng(3)
    for text in (r.integers(97, 99, 3000), np.tile(r.integers(97, 100, 70), 30), np.full(500, 97)):
        text = text.astype(np.uint8)
        places = np.sort(r.choice(text.size - 49, min(400, text.size - 49), replace=False))
        classes = equal_windows(text, places, 50)
        windows = [text[p : p + 50].tobytes() for p in places]
        order = {w: k for k, w in enumerate(sorted(set(windows)))}
        assert classes.tolist() == [order[w] for w in windows]


def brute_simhash(text, words=3):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(2)
    texts = sample_texts(40)
    long = texts[-6].split()
    for k in range(12):  # near copies of a long text: a few words changed
        words = list(long)
        for _ in range(30):
            words[r.randrange(len(words))] = f"zzz{k}"
        texts.append(" ".join(words))
    prints = {i: brute_simhash(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    got = near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(set(prints.values()))


def test_trie_join_finds_all_close_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(8):
            values.add(b ^ sum(1 << r.randrange(64) for _ in range(1)) ^ (1 << r.randrange(64)))
    values = np.array(sorted(values), np.uint64)
    pairs = {(int(a), int(b)) for x, y in trie_pairs(values, np.zeros(values.size, np.int64), 2) for a, b in zip(x, y)}
    want = {(a, b) for a in range(values.size) for b in range(a + 1, values.size) if bin(int(values[a]) ^ int(values[b])).count("1") <= 2}
    assert {tuple(sorted(p)) for p in pairs} == want
    forest = Forest(values.size)
    for a, b in want:
        forest.join(np.array([a]), np.array([b]))
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    found = components(links(rows))
    root = {x.node: x.root for x in found.collect()}
    signed = values.view(np.int64).tolist()
    for a in range(values.size):
        for b in range(a):
            assert (forest.root[a] == forest.root[b]) == (root.get(signed[a], signed[a]) == root.get(signed[b], signed[b]))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(table(spark, []).limit(0)).count() == 0
    rows = near_duplicates(table(spark, [None, "", " "], ids=[5, None, 2])).collect()
    assert {r.component_id for r in rows} == {2} and {r.fingerprint for r in rows} == {"0" * 16}
