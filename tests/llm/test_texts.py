"""Periodic runs, fill-in-the-middle texts and fingerprints against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sightline.llm import fingerprints as prints
from sightline.llm import periodic_runs as runs
from sightline.llm.fill_in_middle import ByteIndex, fill_in_middle, form_digests, restored
from sightline.llm.queries import ORACLE_SQL
from tests.llm.helpers import sample_texts, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hexdigest(b):
    return hashlib.sha256(b).hexdigest()


def brute_runs(w, least=12):
    """Each maximal stretch with its smallest period, by comparing the words of every distance."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def periodic_words(r, kinds, n):
    w = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randrange(4)):
        if n > 3:
            a, b = sorted(r.sample(range(n), 2))
            p = 1 + r.randrange(max(1, (b - a) // 2))
            for i in range(a + p, b):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("block", [16, 1 << 19])
def test_runs_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    r = random.Random(block)
    for _ in range(120):
        least = r.choice([2, 5, 12])
        docs = [periodic_words(r, r.choice([1, 2, 3, 40]), r.choice([0, 1, 3, 11, 12, 13, 40, 150])) for _ in range(r.randrange(1, 8))]
        got = runs.runs_of(np.array([x for d in docs for x in d], np.int32), np.array([len(d) for d in docs], np.int64), 60, least)
        assert list(zip(*[g.tolist() for g in got])) == [(d, *x) for d, w in enumerate(docs) for x in brute_runs(w, least)]


def test_extensions_of_any_two_places():
    r = random.Random(2)
    for _ in range(60):
        w = periodic_words(r, r.choice([1, 2, 5]), 60)
        symbols = np.array([50, *w, 51], np.int32)
        grammar = runs.Grammar(symbols, (50, 52))
        i, j = np.array([(i, j) for i in range(1, 61) for j in range(i + 1, 61)]).T
        ahead, behind = grammar.extensions(i, j, True).tolist(), grammar.extensions(i, j, False).tolist()
        for a, b, f, g in zip(i.tolist(), j.tolist(), ahead, behind):
            assert f == next(k for k in range(99) if symbols[a + k] != symbols[b + k])
            assert g == next(k for k in range(99) if symbols[a - k] != symbols[b - k])


def repeated(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def want_runs(doc_id, text):
    w = repeated(doc_id, text)
    found = brute_runs(w)
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda x: (x[0], x[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hexdigest(listed.encode()), hexdigest(kept.encode()))


def test_runs_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_WORDS", 700)
    r = random.Random(9)
    texts = sample_texts() + [" ".join("ab"[x] for x in periodic_words(r, 2, 90)) for _ in range(60)] + ["x " * 500, "a\x0bb\x0ca\rb \x1c" * 9, "ü " * 12, "ü " * 11]
    ids = [*range(len(texts) - 4), None, -5, 2**62, None]
    docs = table(spark, texts, ids)
    got = runs.run_digests(runs.periodic_runs(runs.with_repeats(docs))).collect()
    assert sorted(map(repr, (tuple(x) for x in got))) == sorted(repr((i, *want_runs(i, t))) for i, t in zip(ids, texts))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in zip(ids, texts))
    assert runs.run_digests(runs.periodic_runs(runs.with_repeats(docs.limit(0)))).count() == 0


def test_collapsed_text_and_spans(spark):
    text = "start " + "one two three " * 5 + "end"
    (row,) = runs.periodic_runs(table(spark, [text])).collect()
    assert [tuple(x) for x in row.runs] == [(1, 15, 3)] and row.collapsed == b"start one two three end" and row.n_words == 17


def test_byte_index_translates_both_ways():
    texts = ["", "abc", "aé漢😀b", "😀😀", "x" * 50 + "é", "漢字" * 9]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    index = ByteIndex(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert index.lengths().tolist() == [len(t) for t in texts]
    for k in range(51):
        points = np.array([min(k, len(t)) for t in texts])
        at = index.to_bytes(points)
        assert (at - offsets[:-1]).tolist() == [len(t[:k].encode()) for t in texts]
        assert (index.to_points(at) == points).all()


def test_forms_equal_brute_force_and_sql(spark):
    texts = sample_texts() + ["<P", "a<M>b", "<<P>", "é<S", "S>" * 9, "<\n>" * 20, "😀" * 33]
    ids = [*range(len(texts) - 2), None, -7]
    docs = table(spark, texts, ids)
    got = {r.doc_id: tuple(r)[1:] for r in form_digests(fill_in_middle(docs)).collect()}
    for doc_id, t in zip(ids, texts):
        t = t or ""
        h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or h3 % 100 >= 90 or re.search("<[PSM]>", t):
            form, out, a2, b2 = "plain", t, None, None
        elif h4 % 100 < 20:
            form, out, a2, b2 = "spm", f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", a, b - a
        else:
            form, out, a2, b2 = "psm", f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", a, b - a
        assert got[doc_id] == (len(t), form, a2, b2, hexdigest(out.encode()), hexdigest(t.encode()))
    assert {x[1] for x in got.values()} == {"plain", "psm", "spm"}
    back = restored(fill_in_middle(docs)).filter("form <> 'plain'").collect()
    assert back and all((r.prefix_chars, r.middle_chars) == (r.restored_prefix, r.restored_middle) for r in back)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert {r[0]: r[1:] for r in con.sql(ORACLE_SQL["op12_fill_in_middle"]).fetchall()} == got
    assert form_digests(fill_in_middle(docs.limit(0))).count() == 0


def word_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def hashes(text):
    w = WORD.findall(text)
    return {word_hash(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b, k):
    x, y = sorted(a)[:k], sorted(b)[:k]
    union = sorted({*x, *y})[:k]
    return sum(h in x and h in y for h in union) / len(union) if union else 1.0


@pytest.mark.parametrize("k", [8, 256])
def test_fingerprints_equal_brute_force(spark, k):
    texts = sample_texts() + ["one two three", "é" * 9, "\x0b\x0c"]
    docs = table(spark, texts, [7 * i - 30 for i in range(len(texts))])
    order = [t or "" for t in texts]
    got = {r.doc_id: r for r in prints.fingerprints(docs, k=k).collect()}
    shown = lambda h: "".join(f"{x % 2**64:016X}" for x in sorted(h)[:k])
    for i, t in enumerate(order):
        following = order[(i + 1) % len(order)]
        edit = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        r = got[7 * i - 30]
        assert (r.n_chars, r.edited_sha256) == (len(t), hexdigest(edit.encode()))
        assert (r.fingerprint, r.edited_fingerprint) == (shown(hashes(t)), shown(hashes(edit)))
        assert r.near_edited == pytest.approx(likeness(hashes(t), hashes(edit), k)) and r.near_next == pytest.approx(likeness(hashes(t), hashes(following), k))
        if len(hashes(t)) < k:
            assert r.n_shingles == len(hashes(t))
    assert len(got) == len(order) and prints.fingerprints(docs.limit(0)).count() == 0


def test_next_documents_of_null_and_repeated_ids(spark):
    one = table(spark, ["a single text"], [None])
    assert [r.next_text for r in prints.with_next(one).collect()] == ["a single text"]
    same = table(spark, ["u", "v", "v", None, "w", "x"], [4, 4, 4, 1, None, None])
    rows = prints.with_next(same).collect()
    hashed = same.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    order = [r.text for r in sorted(hashed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]
    assert sorted((r.text, r.next_text) for r in rows) == sorted(zip(order, [*order[1:], order[0]]))


def test_sketches_merge_and_estimate(spark):
    r = random.Random(4)
    sets = [{r.randrange(-(2**63), 2**63) for _ in range(3000)} for _ in range(3)]
    sets[1] |= set(list(sets[0])[:1500])
    k = 256
    rows = spark.createDataFrame([("x" if i < 2 else None, sorted(s)[:k]) for i, s in enumerate(sets)] + [("y", [])], "name string, sketch array<long>")
    got = {r.name: r.sketch for r in prints.merged_by(rows, ["name"], "sketch", k).collect()}
    assert got == {"x": sorted(sets[0] | sets[1])[:k], None: sorted(sets[2])[:k], "y": []}
    pair = spark.createDataFrame([(sorted(sets[0])[:k], sorted(sets[1])[:k])], "a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    (e,) = pair.select(prints.merged(a, b, k).alias("m"), prints.resemblance(a, b, k).alias("j"), prints.containment(a, b, k).alias("c"), prints.distinct_shingles(a, k).alias("n")).collect()
    assert e.m == got["x"]
    assert e.j == pytest.approx(1500 / 6000, abs=0.1) and e.c == pytest.approx(0.5, abs=0.15) and e.n == pytest.approx(3000, rel=0.2)
