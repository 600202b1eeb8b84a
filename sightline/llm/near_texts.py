"""Near-duplicate texts: candidates by the trie self-join of several fingerprints, links by exact shingle similarity.

1. Each text becomes PRINTS fingerprints of 64 bits: DIGITS minima each of hashes of its word shingles, 8 bits of every minimum.
2. In each of the fingerprints the trie self-join of simhash finds those that differ in at most `errors` bits.  Equal and close
   fingerprints make candidate components; every pair inside one is a candidate, so that nothing a chain holds is left out.
3. A candidate component is dealt into blocks by a hash, and a pair of blocks is one bounded task.  It counts the shingles that two texts
   share, keeps the pairs with a Jaccard similarity of 0.8 or more, and sends one tree for each part that they connect.  First every block
   meets one block only, the component's representatives.  Texts that these links already connect need no further comparison with one
   another: parts of a block's size or more get blocks of their own, the rest is pooled, and only blocks of different parts, and the
   pooled ones, meet.  So a large group of near copies costs work in proportion to its texts.
4. Components are built from these verified links only.

Defined results.  A text without words, or null, has no near copy.  Texts with fewer words than a shingle have one shingle of them all.
Pairs of similar texts that no chain of close fingerprints connects are missed; the README has the measured share.  Rows that repeat a `row` are one
node, linked if any of them is; a null `row` has no links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import batch_of, checkpoint, join_groups, one_array
from sightline.llm.simhash import Forest, components, group_keys, trie_pairs

PRINTS, DIGITS = 8, 8
#: Texts of a candidate component in one block.
BLOCK = 256
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, PRINTS * DIGITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _RANDOM.integers(0, 1 << 63, PRINTS * DIGITS, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKETCHED = pa.schema([("row", pa.int64()), ("prints", pa.list_(pa.int64()))])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted: A-Z in lower case, words between white space, joined by blanks."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    k = min(words, len(found))
    flat = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.cumsum(size + 1) - size - 1
    first, last = start[: len(found) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b]) for a, b in zip(first, last)], np.uint64))


def sketch(found: np.ndarray) -> np.ndarray:
    """The fingerprints of a text with these shingles."""
    least = np.full(PRINTS * DIGITS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, found.size, 1 << 12):
        np.minimum(least, (found[i : i + (1 << 12), None] * _FACTORS + _SUMMANDS).min(axis=0), out=least)
    return (((least ^ (least >> np.uint64(29))) * _MIX) >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _close(firsts: DataFrame, errors: int) -> DataFrame:
    """a, b: links between the rows of fingerprints (number, print, first) of one number that differ in at most `errors` bits."""
    keyed = firsts.select("print", "first", F.explode(group_keys(errors)).alias("key"), "number")
    keyed = keyed.select(F.col("key").bitwiseOR(F.shiftleft(F.col("number").cast("long"), 56)).alias("key"), "print", "first")
    n = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(keys, prints, rows):
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        many = size[group] > 1
        group, prints, rows = group[many], prints[many].view(np.uint64), rows[many]
        order = np.lexsort((prints, group))
        group, prints, rows = group[order], prints[order], rows[order]
        values, number = np.unique(rows, return_inverse=True)
        forest = Forest(values.size)
        for a, b in trie_pairs(prints, group, errors):
            forest.join(number[a], number[b])
        child = np.flatnonzero(forest.root != np.arange(values.size))
        return batch_of(_LINKS, values[child], values[forest.root[child]]).to_batches()

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if held[0].size else 0  # the last group may go on
            if whole > 200_000:
                yield from solve(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        yield from solve(*held)

    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray):
    """Yields (i, all j > i) with a Jaccard similarity of 0.8 or more where one of the two is in left and the other in right."""
    sizes = np.array([s.size for s in sets], np.int64)
    _, shingle, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    whose = np.repeat(np.arange(len(sets)), sizes)
    shared = many[shingle] > 1
    shingle, whose = shingle[shared], whose[shared]
    order = np.argsort(shingle, kind="stable")
    holders = whose[order]
    count = np.bincount(shingle, minlength=many.size)
    start = np.cumsum(count) - count
    edges = np.searchsorted(whose, np.arange(len(sets) + 1))
    for i in range(len(sets) - 1):
        mine = shingle[edges[i] : edges[i + 1]]
        if not mine.size:
            continue
        n = count[mine]
        at = np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)
        both = np.bincount(holders[at], minlength=len(sets))
        ok = (9 * both >= 4 * (sizes + sizes[i])) & ((left[i] & right) | (right[i] & left))
        ok[: i + 1] = False
        if ok.any():
            yield i, np.flatnonzero(ok)


def _met(rows: DataFrame, dealt: DataFrame, words: int) -> DataFrame:
    """a, b: trees of the links of similarity 0.8 or more between the blocks of a root that meet.

    dealt: root, row, block, and the blocks to meet: 0 to total - 1 but for those from `since` to before `until`."""

    def cut(batches):
        for batch in batches:
            blobs = [shingles(t.as_py(), words).tobytes() for t in one_array(batch.column("text"))]
            out = [*(batch.column(c) for c in ("root", "row", "block", "since", "until", "total")), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["root", "row", "block", "since", "until", "total", "found"])

    def solve(rows):
        rows.sort(key=lambda r: r[0])  # the trees do not depend on the order of delivery
        ids = np.array([r[0] for r in rows], np.int64)
        block = np.array([r[1] for r in rows])
        lo, hi = rows[0][2], rows[0][3]
        forest = Forest(ids.size)
        for i, j in similar_pairs([np.frombuffer(r[4], np.uint64) for r in rows], block == lo, block == hi):
            forest.join(np.full(j.size, i), j)
        child = np.flatnonzero(forest.root != np.arange(ids.size))
        return ids[child], ids[forest.root[child]]

    def run(batches):
        at, rows, out = None, [], []
        for batch in batches:
            for root, lo, hi, block, row, found in zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "block", "row", "found"))):
                if (root, lo, hi) != at:
                    if len(rows) > 1:
                        out.append(solve(rows))
                    at, rows = (root, lo, hi), []
                rows.append((row, block, lo, hi, found))
            if out:
                yield from batch_of(_LINKS, *map(np.concatenate, zip(*out))).to_batches()
                out = []
        if len(rows) > 1:
            yield from batch_of(_LINKS, *solve(rows)).to_batches()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.join(dealt, "row").select("root", "row", "block", "since", "until", "total", "text")
    cuts = whole.mapInArrow(cut, "root long, row long, block int, since int, until int, total int, found binary")
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    others = F.concat(span(F.lit(0), F.col("since")), span(F.col("until"), F.col("total")))
    pairs = cuts.select("root", "block", F.explode(others).alias("other"), "row", "found")
    pairs = pairs.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "row", "found")
    return pairs.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(run, "a long, b long")


def _blocks(size) -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("int")


def _of(blocks) -> Column:
    """The block of a row among so many."""
    return F.pmod(F.xxhash64("row"), blocks).cast("int")


def _with_representatives(members: DataFrame) -> DataFrame:
    """What _met needs for every block of a root to meet its first one; members: root, row, n (rows of the root)."""
    block = members.select("root", "row", _of(_blocks("n")).alias("block"), _blocks("n").alias("blocks"))
    return block.select("root", "row", "block", F.lit(0).alias("since"), F.lit(0).alias("until"), F.when(F.col("block") == 0, F.col("blocks")).otherwise(1).alias("total"))


def _with_other_parts(members: DataFrame) -> DataFrame:
    """What _met needs for all pairs of rows of a root to meet whose parts differ; members: root, row, part (of one root)."""
    large = F.col("size") >= BLOCK
    parts = members.groupBy("part").agg(F.min("root").alias("root"), F.count("*").alias("size"))
    before = Window.partitionBy("root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK texts at least
    start = F.coalesce(F.sum(_blocks("size")).over(before), F.lit(0)).cast("int")
    apart = parts.filter(large).select("part", "size", start.alias("since"))
    own = F.coalesce(F.sum(F.when(large, _blocks("size"))), F.lit(0)).cast("int")
    totals = parts.groupBy("root").agg(own.alias("own"), F.coalesce(F.sum(F.when(~large, F.col("size"))), F.lit(0)).alias("pooled"), F.sum("size").alias("n"))
    placed = join_groups(members, totals, "root", "n", F.col("row"))
    placed = join_groups(placed, apart, "part", "size", F.col("row"))
    total = F.col("own") + _blocks("pooled")
    alone = F.col("since").isNotNull()
    placed = placed.select(
        "root",
        "row",
        F.when(alone, F.col("since") + _of(_blocks("size"))).otherwise(F.col("own") + _of(_blocks("pooled"))).alias("block"),
        F.coalesce("since", total).alias("since"),
        F.when(alone, F.col("since") + _blocks("size")).otherwise(total).alias("until"),
        total.alias("total"),
    )
    return placed.filter("until - since < total")


def _verified(rows: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """a, b: trees of the links of similarity 0.8 or more within each root of candidates (root, row)."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"))
    members = checkpoint(join_groups(candidates, sizes, "root", "n", F.col("row")))
    found = checkpoint(_met(rows, _with_representatives(members), words))
    more = members.filter(_blocks("n") > 1).select("root", "row")
    if not more.limit(1).count():
        return found
    parts = components(found).select(F.col("node").alias("row"), F.col("root").alias("part"))
    more = checkpoint(more.join(parts, "row", "left").select("root", "row", F.coalesce("part", "row").alias("part")))
    return found.union(_met(rows, _with_other_parts(more), words))


def near_texts(rows: DataFrame, words: int = 5, errors: int = 4) -> DataFrame:
    """node, root for each row with a near copy; rows: row (a distinct long) and text, which must not change between reads."""
    rows = rows.select(F.col("row").cast("long").alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def sketched(batches):
        for batch in batches:
            found = [shingles(t.as_py(), words) for t in one_array(batch.column("text"))]
            prints = [sketch(s) if s.size else [] for s in found]
            yield from batch_of(_SKETCHED, batch.column("row"), prints).to_batches()

    sketches = checkpoint(rows.mapInArrow(sketched, "row long, prints array<long>"))
    flat = sketches.filter("row IS NOT NULL").select("row", F.posexplode("prints").alias("number", "print")).select("row", F.struct("number", "print").alias("key"))
    firsts = checkpoint(flat.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    equal = join_groups(flat, firsts, "key", "n", F.col("row")).filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    candidates = components(_close(firsts.select("key.number", "key.print", "first"), errors).union(equal))
    return components(_verified(rows, candidates.withColumnRenamed("node", "row"), words))
