"""Removal of repeated passages by suffix sorting, one bucket at a time, with a difference cover.

Two positions match if the next `length` bytes are equal.  A position of a document is a repeat if it matches one of a
document with a smaller doc_id; the bytes that repeats cover are removed.

1. Anchors.  Among the k-grams of each window of `length` bytes the one with the smallest hash is its anchor.  Equal windows
   have equal anchors at equal places, so windows whose anchor occurs in one document alone repeat nothing.  Chunks send the
   owners Golomb-coded anchor fingerprints and get bitmaps of the shared ones, as exact_dedup does.
2. Buckets.  Runs of windows with one shared anchor form a segment, sent once for each distinct segment and chunk (with its
   smallest doc_id) to the bucket of that anchor.  All windows that can be equal meet in one bucket.  An anchor with very many
   runs would overload its bucket, since of a line that very many documents hold the windows that cross its ends all differ: of such
   hot anchors the windows are exchanged once more by fingerprints of their own, and only shared ones go, one for each distinct
   window and chunk, to the buckets of these fingerprints.
3. Sorting.  Equal segments of several chunks are sorted once.  A bucket is cut into blocks by anchor.  In a block, suffixes are sorted by their first COVER bytes.  Ties are
   resolved by the ranks of cover samples: positions whose remainder modulo COVER lies in a difference cover were ranked
   before, and for any two suffixes some shift below COVER makes both of them samples.  Tied groups are
   split three ways around a pivot until each holds equal windows only.  Memory is bounded by the block.
4. Runs of equal windows give the smallest doc_id, answers go back to the chunks, and these cover and cut the texts.

Defined results.  A null text is empty.  A null doc_id is larger than any other; rows with the same doc_id do not repeat each
other.  Texts shorter than `length` stay whole.  An empty table gives no rows.  A text of any length is sorted in bounded blocks; it is one
value, up to the 2 GB of a Spark row.  Of equal windows in several documents the smallest doc_id alone keeps its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import (
    CHUNK_BYTES,
    Chunk,
    batch_of,
    chunked,
    counts_packed,
    counts_unpacked,
    expanded,
    forget_model,
    golomb_decode,
    golomb_encode,
    merged,
    one_array,
    owner_of,
    owners_for,
    pack,
    parts_of,
    small,
    squeezed,
    unpack,
)

#: Period of the difference cover, and residues among which every difference modulo COVER occurs.
COVER = 16
RESIDUES = (0, 1, 2, 5, 8)
#: Windows that one block sorts at a time (more only if one anchor has more).
BLOCK_WINDOWS = 1 << 19
_TILE = 1 << 14
_LOW = np.uint64((1 << 15) - 1)
_COUNT = np.arange(1 << 15, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_WIRE = "key int, kind int, chunk int, blob binary"
_WIRE_ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_ANSWER = "chunk int, kind int, owner int, bits binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("owner", pa.int32()), ("bits", pa.binary())])
SEGMENTS, PLACES, MATCHES = 0, 1, 2
ANCHORS, WINDOWS = 0, 1
#: An anchor is hot with more runs than this many for each chunk, within these bounds.
HOT_RUNS_PER_CHUNK, HOT_RUNS = 16, (256, 20_000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_POW: dict = {}


def _tables(n: int):
    if n not in _POW:
        _POW[n] = (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n), np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64))
    return _POW[n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit rolling hash of each k bytes, for a tile of data."""
    n = data.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse, letters = _tables(_TILE + 256)
    sums = np.zeros(n + k, np.uint64)
    np.cumsum(letters[data] * power[: data.size], out=sums[1:])
    h = sums[k:] - sums[:-k]
    h *= inverse[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: x.size - (w - step)], x[w - step :]) if w > step else x


class Anchors:
    """The runs of windows of a chunk that share an anchor: start, end (of window starts), anchor position, hash, document."""

    def __init__(self, chunk: Chunk, length: int, k: int):
        data, offsets = chunk.data, chunk.offsets
        w = length - k + 1
        n = data.size - length + 1
        starts, ends = offsets[:-1], offsets[1:] - length + 1
        some = ends > starts
        if n <= 0 or not some.any():
            self.start = self.end = self.at = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        # tile by tile: where the anchor changes, where it is, and its hash
        edges, places, hashes = [], [], []
        before = -1
        for a in range(0, n, _TILE):
            b = min(n, a + _TILE)
            h = gram_hashes(data[a : b + length - 1], k)
            low = (_sliding_min((h & ~_LOW) | _COUNT[: h.size], w) & _LOW).astype(np.int32)
            edge = np.flatnonzero(low[1:] != low[:-1]) + 1
            if low[0] + a != before:
                edge = np.concatenate([[0], edge])
            before = int(low[-1]) + a
            edges.append(edge + a)
            places.append(low[edge] + np.int64(a))
            hashes.append(h[low[edge]])
        edge, place, hashes = np.concatenate(edges), np.concatenate(places), np.concatenate(hashes)
        # windows that cross the end of a document are none
        ends_of_texts = np.unique(np.concatenate([starts[some], ends[some]]))
        at = np.searchsorted(edge, ends_of_texts)
        fresh = (at == edge.size) | (edge[at.clip(0, edge.size - 1)] != ends_of_texts)
        first = np.insert(edge, at[fresh], ends_of_texts[fresh])
        own = np.insert(np.ones(edge.size, np.int64), at[fresh], 0)
        run = np.cumsum(own) - 1
        last = np.append(first[1:], n)
        doc = np.repeat(np.arange(starts.size), np.diff(np.append(np.searchsorted(first, starts), first.size)))
        keep = (first < ends[doc]) & (first < n)
        self.start, self.end, self.doc, run = first[keep], last[keep], doc[keep], run[keep]
        # anchors are least hashes, so these crowd at the low end: mixed again, they spread evenly over the owners
        mixed = hashes[run] * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(35)
        self.at, self.hash = place[run], mixed * np.uint64(0xD6E8FEB86659FD93)


class HotWindows:
    """The windows of a chunk's hot runs: position, document, and the distinct windows (hash, first position) they belong to."""

    def __init__(self, chunk: Chunk, anchors: Anchors, runs: np.ndarray, length: int):
        count = anchors.end[runs] - anchors.start[runs]
        self.at = np.repeat(anchors.start[runs] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.doc = np.repeat(anchors.doc[runs], count)
        order = np.argsort(self.at, kind="stable")
        self.at, self.doc = self.at[order], self.doc[order]
        data = chunk.data
        h = np.empty(self.at.size, np.uint64)
        edges = np.searchsorted(self.at, np.arange(0, data.size + _TILE, _TILE))
        for tile, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                base = tile * _TILE
                h[a:b] = gram_hashes(data[base : base + _TILE + length - 1], length)[self.at[a:b] - base]
        self.hash, first, self.window = np.unique(h, return_index=True, return_inverse=True)
        self.first = self.at[first]
        self._split(data, length)

    def _split(self, data: np.ndarray, length: int) -> None:
        """Windows with one hash and different bytes become windows of their own, next to each other in the order of hashes."""
        view = np.lib.stride_tricks.sliding_window_view(data, length) if data.size >= length else None
        differ = [np.zeros(0, np.int64)]
        for a in range(0, self.at.size, 1 << 18):
            part = slice(a, a + (1 << 18))
            differ.append(a + np.flatnonzero((view[self.at[part]] != view[self.first[self.window[part]]]).any(axis=1)))
        differ = np.concatenate(differ)
        if not differ.size:
            return
        number: dict = {}
        hashes, first = [self.hash], [self.first]
        for i in differ.tolist():
            at = int(self.at[i])
            key = (int(self.window[i]), data[at : at + length].tobytes())
            if key not in number:
                number[key] = self.hash.size + len(number)
                hashes.append(self.hash[key[0] : key[0] + 1])
                first.append(np.array([at]))
            self.window[i] = number[key]
        self.hash, self.first = np.concatenate(hashes), np.concatenate(first)
        order = np.argsort(self.hash, kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        self.hash, self.first, self.window = self.hash[order], self.first[order], place[self.window]


def _shift_table() -> np.ndarray:
    """For two residues the smallest shift that takes both into the cover."""
    table = np.full((COVER, COVER), -1, np.int64)
    for a in range(COVER):
        for b in range(COVER):
            table[a, b] = next(d for d in range(COVER) if (a + d) % COVER in RESIDUES and (b + d) % COVER in RESIDUES)
    return table


def _words(buffer: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as a number that sorts as they do; buffer ends with eight spare bytes."""
    return np.ndarray((buffer.size - 8,), ">u8", buffer, 0, (1,))


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by several keys, and whether each differs from the one before.  Later keys are looked at only where earlier ones tie."""
    order = np.argsort(keys[0])
    new = np.ones(order.size, bool)
    first = keys[0][order]
    new[1:] = first[1:] != first[:-1]
    for k in keys[1:]:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not at.size:
            break
        own = order[at]
        values = k[own]
        by_value = np.argsort(values)
        values = values[by_value]
        rank = np.empty(at.size, np.int64)
        rank[by_value] = np.cumsum(np.append(False, values[1:] != values[:-1]))
        rank |= np.cumsum(new[at]) << 32
        by_rank = np.argsort(rank)
        order[at], rank = own[by_rank], rank[by_rank]
        new[at[1:]] = rank[1:] != rank[:-1]
    return order, new


def equal_windows(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A class number for each place: equal if and only if the next `length` bytes of text are.  Classes are numbered in
    the sorted order of the windows.  Suffix sorting with a difference cover; length is 2 * COVER at least."""
    n = places.size
    if not n:
        return np.zeros(0, np.int64)
    buffer = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    word = _words(buffer)
    depth = length - COVER  # bytes by which cover samples are ranked
    # ranks of the samples
    all_places = np.arange(text.size, dtype=np.int64)
    sample = all_places[np.isin(all_places % COVER, RESIDUES)]
    at = [*range(0, depth - 7, 8)]
    if depth % 8:
        at.append(depth - 8)
    order, new = _dense([word[sample + a].astype(np.uint64) for a in at])
    rank = np.zeros(text.size + COVER, np.int64)
    rank[sample[order]] = np.cumsum(new)
    # first COVER bytes
    order, new = _dense([word[places + a].astype(np.uint64) for a in range(0, COVER, 8)])
    group = np.cumsum(new) - 1
    at = places[order]
    # ties, split around pivots
    shift = _shift_table()
    tail = [length - 16, length - 8]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    starts_class = new
    while lo.size:
        sizes = hi - lo
        index = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        which = np.repeat(np.arange(lo.size), sizes)
        mine = at[index]
        pivot = at[(lo + hi) // 2][which]
        d = shift[mine % COVER, pivot % COVER]
        side = np.sign(rank[mine + d] - rank[pivot + d])
        for a in tail:
            tie = np.flatnonzero(side == 0)
            if tie.size:
                x, y = word[mine[tie] + a].astype(np.uint64), word[pivot[tie] + a].astype(np.uint64)
                side[tie] = (x > y).astype(np.int64) - (x < y)
        part = which * 3 + side + 1
        new_order = np.argsort(part, kind="stable")
        at[index] = mine[new_order]
        order[index] = order[index][new_order]
        part = part[new_order]
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        starts_class[index[edge]] = True
        stop = np.append(edge[1:], part.size)
        more = (stop - edge > 1) & (part[edge] % 3 != 1)
        lo, hi = index[edge[more]], index[stop[more] - 1] + 1
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(starts_class) - 1
    return classes


def _squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _match_blocks(parts: list[list[np.ndarray]], length: int):
    """For segments of several chunks (hash, length, doc_id, multi, bytes): (index of segment, first window, windows, smallest doc_id)
    runs of windows with a partner in another document."""
    hashes = np.concatenate([p[0].astype(np.uint64) for p in parts])
    sizes = np.concatenate([p[2].astype(np.int64) for p in parts])
    ids = np.concatenate([p[3].astype(np.uint64).astype(np.int64) for p in parts])
    multi = np.concatenate([np.unpackbits(p[4], count=p[0].size).astype(bool) for p in parts])
    # segments with equal bytes are one, with the smallest doc_id and more than one document if these differ
    number: dict[bytes, int] = {}
    same = []
    for p in parts:
        flat = pa.decompress(p[5].tobytes(), int(p[2].sum(dtype=np.int64)), "zstd", asbytes=True)
        ends = np.cumsum(p[2], dtype=np.int64).tolist()
        same.extend([number.setdefault(flat[a:b], len(number)) for a, b in zip([0, *ends], ends)])
    same = np.array(same, np.int64)
    data = np.frombuffer(b"".join(number), np.uint8)
    low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(low, same, ids)
    np.maximum.at(high, same, ids)
    several = low < high
    several[same[multi]] = True
    one = np.empty(len(number), np.int64)
    one[same] = np.arange(same.size)
    hashes, sizes, ids, multi = hashes[one], sizes[one], low, several
    del number
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    order = np.argsort(hashes, kind="stable")
    # blocks end where an anchor's segments end
    edge = np.flatnonzero(np.append(np.diff(hashes[order]) != 0, True)) + 1 if order.size else np.zeros(0, np.int64)
    total = np.cumsum(windows[order])
    cut, base = [0], 0
    for e in edge.tolist():
        if total[e - 1] - base >= BLOCK_WINDOWS or e == order.size:
            cut.append(e)
            base = total[e - 1]
    found = []
    for a, b in zip(cut, cut[1:]):
        own = order[a:b]
        size = sizes[own]
        put = np.cumsum(size) - size
        take = np.repeat(begin[own] - put, size) + np.arange(size.sum())
        text = data[take]
        count = windows[own]
        first = np.cumsum(count) - count
        inside = np.arange(count.sum()) - np.repeat(first, count)
        seg = np.repeat(np.arange(own.size), count)
        classes = equal_windows(text, put[seg] + inside, length)
        doc = ids[own][seg]
        least = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, doc)
        least = least[classes]
        hit = (least < doc) | multi[own][seg]
        if not hit.any():
            continue
        at = np.flatnonzero(hit)
        cont = np.zeros(at.size, bool)
        cont[1:] = (np.diff(at) == 1) & (seg[at][1:] == seg[at][:-1]) & (least[at][1:] == least[at][:-1])
        head = np.flatnonzero(~cont)
        found.append((own[seg[at[head]]], inside[at[head]], np.diff(np.append(head, at.size)), least[at[head]]))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    seg, first, count, least = (np.concatenate(x) for x in zip(*found))
    # back to all segments: each gets the runs of the one that stands for it
    order = np.argsort(seg, kind="stable")
    seg, first, count, least = seg[order], first[order], count[order], least[order]
    lo, hi = np.searchsorted(seg, same, "left"), np.searchsorted(seg, same, "right")
    each = hi - lo
    take = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return [np.repeat(np.arange(same.size), each), first[take], count[take], least[take]]


def removed_spans(docs: DataFrame, text: str = "text", length: int = 50, k: int = 18, carry: list[str] | None = None, keep_bytes: bool = False, whole_points: bool = False, chunk_bytes: int = CHUNK_BYTES // 4, hot_runs: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs; `kept` (binary) with keep_bytes; the columns
    `carry` in a struct `rest`.  With whole_points a code point goes only if all its bytes do."""
    rows, n, total = chunked(docs, text, carry, chunk_bytes)
    bits = min(64, max(24, total.bit_length() + 10))
    owned = owners_for(total, n)
    hot = hot_runs if hot_runs is not None else min(max(HOT_RUNS_PER_CHUNK * n, HOT_RUNS[0]), HOT_RUNS[1])

    def prints_of(anchors: Anchors) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints in order, and for each run the index of its own."""
        return np.unique(anchors.hash >> np.uint64(64 - bits), return_inverse=True)

    def edges_of(prints: np.ndarray):
        whose = owner_of(prints, bits, owned)
        edges = np.flatnonzero(np.diff(whose, prepend=-1))
        return [(int(whose[a]), int(a), int(b)) for a, b in zip(edges, [*edges[1:], len(prints)])]

    def several(ids: np.ndarray, which: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest doc_id of each kind, and whether it has more than one."""
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        return low, low < high

    def send(key, table):
        chunk = Chunk(table)
        anchors = Anchors(chunk, length, k)
        prints, which = prints_of(anchors)
        _, multi = several(chunk.ids[anchors.doc], which, prints.size)
        runs = np.bincount(which, minlength=prints.size)
        edges = edges_of(prints)
        blobs = [pack(golomb_encode(prints[a:b]), np.packbits(multi[a:b]), counts_packed(runs[a:b])) for _, a, b in edges]
        return batch_of(_WIRE_ARROW, [o for o, _, _ in edges], [ANCHORS] * len(edges), [key[0].as_py()] * len(edges), blobs)

    def answer(key, table):
        prints, multi, runs = [], [], []
        column = parts_of(table)
        for blob in column("blob"):
            p, m, r = unpack(blob.as_buffer())
            prints.append(golomb_decode(p))
            multi.append(np.unpackbits(m, count=prints[-1].size).astype(bool))
            runs.append(counts_unpacked(r.tobytes()))
        _, back, counts = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[back[np.concatenate(multi)]] = True
        many = np.bincount(back, np.concatenate(runs), shared.size) > hot
        shared, many = shared[back], many[back]
        edges = np.cumsum([0, *(p.size for p in prints)])
        blobs = [pack(np.packbits(shared[a:b]), np.packbits(many[a:b])) for a, b in zip(edges, edges[1:])]
        return batch_of(_ANSWER_ARROW, column("chunk"), column("kind"), [key[0].as_py()] * len(prints), blobs)

    def flags(prints: np.ndarray, answers, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each fingerprint is shared, and whether it is hot."""
        kinds = answers.column("kind").to_pylist()
        got = {o: b for k, o, b in zip(kinds, answers.column("owner").to_pylist(), one_array(answers.column("bits"))) if k == kind}
        shared, many = np.zeros(prints.size, bool), np.zeros(prints.size, bool)
        for owner, a, b in edges_of(prints):
            x, y = unpack(got[owner].as_buffer())
            shared[a:b], many[a:b] = np.unpackbits(x, count=b - a), np.unpackbits(y, count=b - a)
        return shared, many

    def send_windows(key, table, answers):
        if not any(unpack(b.as_buffer())[1].any() for b in one_array(answers.column("bits"))):  # nothing is hot here
            return batch_of(_WIRE_ARROW, *[[]] * len(_WIRE_ARROW))
        chunk = Chunk(table)
        anchors = Anchors(chunk, length, k)
        prints, which = prints_of(anchors)
        shared, many = flags(prints, answers, ANCHORS)
        edges, blobs = [], []
        runs = np.flatnonzero((shared & many)[which])
        if runs.size:
            windows = HotWindows(chunk, anchors, runs, length)
            kinds, of = np.unique(windows.hash >> np.uint64(64 - bits), return_inverse=True)
            _, multi = several(chunk.ids[windows.doc], of[windows.window], kinds.size)
            edges = edges_of(kinds)
            blobs = [pack(golomb_encode(kinds[a:b]), np.packbits(multi[a:b]), counts_packed(np.zeros(b - a, np.int64))) for _, a, b in edges]
        return batch_of(_WIRE_ARROW, [o for o, _, _ in edges], [WINDOWS] * len(edges), [key[0].as_py()] * len(edges), blobs)

    def segments(key, table, answers):
        chunk = Chunk(table)
        anchors = Anchors(chunk, length, k)
        prints, which = prints_of(anchors)
        shared, many = flags(prints, answers, ANCHORS)
        me = key[0].as_py()
        flat = chunk.data.tobytes()
        keys, kinds, blobs = [], [], []
        base = 0  # number of the chunk's segments so far

        def put(of: np.ndarray, prints: np.ndarray, texts: list[bytes], low: np.ndarray, multi: np.ndarray) -> None:
            """Segments, ordered by the fingerprint that `of` points to."""
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            for owner, a, b in edges_of(prints):
                x, y = np.searchsorted(of, [a, b])
                if y > x:
                    keys.append(owner)
                    kinds.append(SEGMENTS)
                    blobs.append(pack(small(prints[of[x:y]]), np.array([base + x], np.int64), small(size[x:y]), small(low[x:y]), np.packbits(multi[x:y]), _squeezed(b"".join(texts[x:y]))))

        runs = np.flatnonzero((shared & ~many)[which])
        runs = runs[np.argsort(which[runs], kind="stable")]
        places = []
        if runs.size:
            start, end = anchors.start[runs], anchors.end[runs] + length - 1
            number: dict = {}  # of each distinct segment; its bytes determine its anchor
            seg = np.fromiter((number.setdefault(flat[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist())), np.int64, runs.size)
            low, multi = several(chunk.ids[anchors.doc[runs]], seg, len(number))
            put(which[runs][np.unique(seg, return_index=True)[1]], prints, list(number), low, multi)
            base = len(number)
            places.append((seg, start, anchors.doc[runs]))
        runs = np.flatnonzero((shared & many)[which])
        if runs.size:
            windows = HotWindows(chunk, anchors, runs, length)
            kinds_of, of = np.unique(windows.hash >> np.uint64(64 - bits), return_inverse=True)
            keep = flags(kinds_of, answers, WINDOWS)[0][of]  # of the distinct windows, which are in the order of their hashes
            low, multi = several(chunk.ids[windows.doc], windows.window, windows.hash.size)
            mine = np.flatnonzero(keep)
            put(of[mine], kinds_of, [flat[a : a + length] for a in windows.first[mine].tolist()], low[mine], multi[mine])
            number = np.cumsum(keep) - 1 + base
            at = np.flatnonzero(keep[windows.window])
            seg, start, doc = number[windows.window[at]], windows.at[at], windows.doc[at]
            if at.size:
                places.append((seg, start, doc))
        if places:
            keys.append(me)
            kinds.append(PLACES)
            blobs.append(pack(*[squeezed(np.concatenate(x)) for x in zip(*places)]))
        return batch_of(_WIRE_ARROW, keys, kinds, [me] * len(keys), blobs)

    def sort_bucket(key, table):
        forget_model()
        column = parts_of(table)
        kinds, chunks, blobs = column("kind").to_numpy(), column("chunk").to_numpy(), column("blob")
        keys, out_kinds, out = [], [], []
        parts, owners = [], []
        for i, kind in enumerate(kinds.tolist()):
            if kind == PLACES:
                keys.append(int(chunks[i]))
                out_kinds.append(PLACES)
                out.append(blobs[i].as_py())
            else:
                parts.append(unpack(blobs[i].as_buffer()))
                owners.append(int(chunks[i]))
        if parts:
            seg, first, count, least = _match_blocks(parts, length)
            edges = np.cumsum([0, *(p[0].size for p in parts)])
            order = np.argsort(seg, kind="stable")
            seg, first, count, least = seg[order], first[order], count[order], least[order]
            cut = np.searchsorted(seg, edges)
            for i, owner in enumerate(owners):
                a, b = cut[i], cut[i + 1]
                if b > a:
                    keys.append(owner)
                    out_kinds.append(MATCHES)
                    out.append(pack(small(seg[a:b] - edges[i] + parts[i][1][0]), small(first[a:b]), small(count[a:b]), small(least[a:b])))
        return batch_of(_WIRE_ARROW, keys, out_kinds, keys, out)

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_bytes:
        fields.append(("kept", pa.binary()))
        ddl += ", kept binary"

    def cut(key, table, matches):
        chunk = Chunk(table)
        size = chunk.data.size
        edge = np.zeros(size + 1, np.int32)
        places, runs = None, []
        for kind, blob in zip(matches.column("kind").to_pylist(), one_array(matches.column("blob"))):
            parts = unpack(blob.as_buffer())
            if kind == PLACES:
                places = [expanded(x.tobytes()) for x in parts]
            else:
                runs.append([x.astype(np.uint64).astype(np.int64) for x in parts])
        if places and runs:
            seg, first, count, least = (np.concatenate(x) for x in zip(*runs))
            order = np.argsort(seg, kind="stable")
            seg, first, count, least = seg[order], first[order], count[order], least[order]
            lo, hi = np.searchsorted(seg, places[0], "left"), np.searchsorted(seg, places[0], "right")
            each = hi - lo
            occ = np.repeat(np.arange(each.size), each)
            run = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
            ok = least[run] < chunk.ids[places[2][occ]]
            begin = places[1][occ[ok]] + first[run[ok]]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + count[run[ok]] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        if whole_points and gone.any():
            lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
            if lead.size:
                gone = np.repeat(np.minimum.reduceat(gone, lead), np.diff(np.append(lead, size)))
        n_gone = np.concatenate([[0], np.cumsum(gone)])
        rise = np.zeros(size + 1, bool)
        rise[:size] = gone
        rise[1:size] &= ~gone[:-1]
        starts = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
        rise[starts] = gone[starts]
        n_rise = np.concatenate([[0], np.cumsum(rise[:size])])
        a, b = chunk.offsets[:-1], chunk.offsets[1:]
        left = chunk.data[~gone].tobytes() if gone.any() else chunk.data.tobytes()
        at = (chunk.offsets - n_gone[chunk.offsets]).tolist()
        kept = [left[x:y] for x, y in zip(at, at[1:])]
        columns = [chunk.doc_id_column(), b - a, n_gone[b] - n_gone[a], n_rise[b] - n_rise[a], [hashlib.sha256(t).hexdigest() for t in kept]]
        if keep_bytes:
            columns.append(kept)
        schema = pa.schema(fields)
        if carry:
            rest = one_array(chunk.rows.column("rest"))
            schema = schema.append(pa.field("rest", rest.type))
            columns.append(rest)
        return batch_of(schema, *columns)

    if carry:
        ddl += ", rest " + rows.schema["rest"].dataType.simpleString()
    sent = merged(rows.groupBy("chunk").applyInArrow(send, _WIRE))
    answers = sent.groupBy("key").applyInArrow(answer, _ANSWER)
    windows = merged(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send_windows, _WIRE))
    answers = answers.union(windows.groupBy("key").applyInArrow(answer, _ANSWER))
    parts = merged(rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(segments, _WIRE))
    matches = parts.groupBy("key").applyInArrow(sort_bucket, _WIRE)
    return rows.groupBy("chunk").cogroup(matches.groupBy("key")).applyInArrow(cut, ddl)
