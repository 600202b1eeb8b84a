"""SimHash near-deduplication by a self-join of binary tries.

1. Each text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word shingles.
2. Fingerprints are cut into BLOCKS blocks.  Two that differ in at most `errors` bits agree in BLOCKS - errors blocks, so each is
   sent, once for each choice of that many blocks, to the group of those bits.  The bits left bound a group's distinct
   fingerprints by a constant, whatever the data.
3. In a group the fingerprints form a binary trie.  Pairs of nodes are traversed together from the root; bits that differ
   are added up, and a pair is dropped as soon as they exceed the budget.  The pairs of leaves that remain are the links.
4. Links are reduced to one tree for each connected part within a task, then joined into components by hooking and pointer jumping.

Defined results.  A text without words, or null, has fingerprint 0 and links like any other.  Texts with fewer words than a shingle have
one shingle of them all.  A null doc_id is larger than any other; a component of nulls alone has a null component_id.  Rows that repeat a
doc_id are linked each on its own.  A bit that is set in exactly half of the hashes is 0.  An empty table gives no rows.  A text of any
length is read whole.  Only doc_id and the text column are read, so that other columns may have any names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import NULL_ID, batch_of, checkpoint, join_groups, one_array

#: Widths of the blocks that a fingerprint is cut into, from its highest bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Pairs of nodes traversed at once; more wait on a stack.
FRONTIER = 1 << 20
_PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def simhash(text: bytes, words: int, seed: int) -> int:
    """Fingerprint of a text: A-Z in lower case, words between white space, shingles joined by blanks."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    flat = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.cumsum(size + 1) - size - 1
    k = min(words, len(found))
    first, last = start[: len(found) - k + 1].tolist(), (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for i in range(0, len(first), 1 << 16):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)])], ">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    bits = (2 * count > len(first)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and print (the 64 bits as a long)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        for batch in batches:
            prints = [simhash(t.as_py(), words, seed) for t in one_array(batch.column(1))]
            yield from batch_of(_PRINTS, batch.column(0), prints).to_batches()

    return rows.mapInArrow(run, "doc_id long, print long")


def group_keys(errors: int):
    """One key for each choice of blocks that must agree; the choice is part of the key."""
    edges = np.cumsum([0, *BLOCKS])
    parts = [F.shiftrightunsigned("print", int(64 - edges[i + 1])).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1)) for i in range(len(BLOCKS))]
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - errors)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def trie_pairs(prints: np.ndarray, group: np.ndarray, errors: int):
    """Yields index pairs of fingerprints of one group that differ in at most `errors` bits.

    prints: unsigned, sorted and distinct within each group; group: ascending numbers.  Each group is a trie; a node is a range
    of prints that share their first bits."""
    edge = np.flatnonzero(np.diff(group, prepend=-1)) if group.size else np.zeros(0, np.int64)
    lo, hi = edge, np.append(edge[1:], group.size)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(63, lo, hi, lo, hi, np.zeros(lo.size, np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        while bit >= 0 and alo.size:
            if alo.size > FRONTIER:
                half = alo.size // 2
                stack.append((bit, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
                alo, ahi, blo, bhi, err = alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half]
                continue
            base = int(alo.min())
            ones = np.concatenate([[0], np.cumsum((prints[base : int(bhi.max())] >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
            amid = ahi - (ones[ahi - base] - ones[alo - base])
            bmid = bhi - (ones[bhi - base] - ones[blo - base])
            same = alo == blo
            more = err + 1
            alo, ahi, blo, bhi, err = (
                np.concatenate(x) for x in zip((alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, more), (amid[~same], ahi[~same], blo[~same], bmid[~same], more[~same]))
            )
            keep = (err <= errors) & (ahi > alo) & (bhi > blo) & ((alo != blo) | (ahi - alo > 1))
            alo, ahi, blo, bhi, err = alo[keep], ahi[keep], blo[keep], bhi[keep], err[keep]
            bit -= 1
        if alo.size:
            yield alo, blo


class Forest:
    """Connected parts of numbered items; the smallest number names a part."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        self.root = root


def links(distinct: DataFrame, errors: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints (column print), reduced to one tree for each part that meets in a task."""
    keyed = distinct.select("print", F.explode(group_keys(errors)).alias("key"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(keys: np.ndarray, prints: np.ndarray):
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        many = size[group] > 1
        group, prints = group[many], prints[many].view(np.uint64)
        order = np.lexsort((prints, group))
        group, prints = group[order], prints[order]
        fresh = np.ones(prints.size, bool)
        fresh[1:] = (np.diff(group) != 0) | (prints[1:] != prints[:-1])
        group, prints = group[fresh], prints[fresh]
        values, number = np.unique(prints, return_inverse=True)
        forest = Forest(values.size)
        for a, b in trie_pairs(prints, group, errors):
            forest.join(number[a], number[b])
        child = np.flatnonzero(forest.root != np.arange(values.size))
        values = values.view(np.int64)
        return batch_of(_LINKS, values[child], values[forest.root[child]]).to_batches()

    def run(batches):
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(1).to_numpy()])
            prints = np.concatenate([prints, batch.column(0).to_numpy()])
            whole = int(np.searchsorted(keys, keys[-1])) if keys.size else 0  # the last group may go on
            if whole > 200_000:
                yield from solve(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        yield from solve(keys, prints)

    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): root is the smallest node that can be reached.

    Rounds of hooking (a root goes below the least root next to its part) and pointer jumping, each cut off by a
    checkpoint; a logarithmic number of rounds is usual.  Nodes with very many neighbours, and roots of very many nodes, are looked up
    by broadcast, so that a large star is no task of its own."""
    # both directions come from one reading of the edges, which may be other trees of the same parts when they are read again
    ways = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    both = checkpoint(edges.select(ways.alias("w")).select("w.u", "w.v").distinct())
    parent = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("p"), "n", F.lit(True).alias("moved")))
    while True:
        there = join_groups(both, parent.select(F.col("u").alias("v"), "p", "n"), "v", "n", F.col("u"))
        near = there.groupBy("u").agg(F.min("p").alias("m"))
        step = parent.select("u", "p", "n").join(near, "u").select("u", "n", "p", F.least("p", "m").alias("q"))
        hooks = step.groupBy("p").agg(F.min("q").alias("h")).select(F.col("p").alias("u"), "h")
        hooked = step.join(hooks, "u", "left").select("u", "n", F.col("p").alias("old"), F.least("q", F.coalesce("h", "q")).alias("p"))
        hooked = checkpoint(hooked)
        sizes = hooked.groupBy(F.col("p").alias("u")).agg(F.count("*").alias("size"))
        up = sizes.join(hooked, "u").select(F.col("u").alias("p"), F.col("p").alias("pp"), "size")
        jumped = join_groups(hooked, up, "p", "size", F.col("u"))
        parent = checkpoint(jumped.select("u", F.col("pp").alias("p"), "n", (F.col("pp") != F.col("old")).alias("moved")))
        if not parent.filter("moved").limit(1).count():
            return parent.select(F.col("u").alias("node"), F.col("p").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, errors: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of docs."""
    prints = checkpoint(fingerprints(docs, text, words, seed))
    distinct = checkpoint(prints.groupBy("print").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first"), F.count("*").alias("n")))
    found = components(links(distinct, errors))
    placed = distinct.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "first", "n", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    component = placed.select("print", "n", "root").join(least, "root").select("print", "n", F.nullif("least", F.lit(NULL_ID)).alias("component_id"))
    out = join_groups(prints, component, "print", "n", F.col("doc_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
