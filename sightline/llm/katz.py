"""Language-model scoring: Katz backoff over trigrams with Good-Turing discounts.

    p(w | u v) = d3(c(u v w)) c(u v w) / c(u v)    if u v w was seen
               = alpha(u v) p(w | v)               otherwise, and p(w | v) alone if u v was never seen
    p(w | v)   = d2(c(v w)) c(v w) / c(v)          if v w was seen
               = alpha(v) p(w)                     otherwise, and p(w) alone if v was never seen
    p(w)       = d1(c(w)) c(w) / N                 if w was seen, else the mass that the discounts leave for an unknown token

A text is preceded by two starts.  alpha is exactly what makes each p(. | context) sum to one over the known tokens and the unknown one.

1. Documents are read once.  A chunk keeps its tokens as numbers, and sends the owners of words its distinct words with their counts; these
   number the words of the corpus and answer with number and count.
2. A chunk sends each of its distinct trigrams u v w once, with its count, to the owner of the middle word v, where a range of middle words is counted at a time.  There the trigrams
   give the bigrams v w and what the weights of the contexts u v and v need: how many seen tokens have which count, on both
   orders.  All of it are whole numbers that add up.  A middle word with more than HOT times the mean share of an owner is split by w,
   and what its parts know of a context is added up by the owner of that context in one more exchange.
3. Chunks get the counts of their n-grams, and the numbers of those contexts in which they back off; then they evaluate their texts.
   The frequencies of counts, from which the discounts follow, are one row, summed up by Spark and broadcast.

Defined results.  A null text is empty and is scored as its end.  A null doc_id is learned from.  Rows that repeat a doc_id count each on its own.
Good-Turing discounts that small corpora leave undefined are replaced by an absolute discount of one half.  A context all of whose counts are
too large to be discounted counts one more token, unseen.  With nothing to learn from every token is unknown: train_tokens is 0 and score
is 0.  An empty table gives no rows.  A text of any length is part of one chunk.  Only doc_id and the text column are read, so that other
columns may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import NULL_ID, batch_of, checkpoint, expanded, forget_model, merged, one_array, owners_for, pack, parts_of, squeezed, unpack

#: Counts above this one are not discounted.
K = 5
#: The end of a text as a token; no word can be it.
END = b"\n"
#: Bytes of text behind one range of middle words, ranges that one owner has at most (it counts them one by one), owners that even small inputs
#: get, and the share of a range's mean load from which a middle word is split.
RANGE_BYTES, RANGES, LEAST_OWNERS, HOT = 6 << 20, 8, 64, 2.0
#: Bytes of text that one chunk aims at.
CHUNK_BYTES = 6 << 20
STATE, WORDS, KNOWN, STATS, ANSWERS, PARTS, ASKED, CONTEXTS = range(8)
_WIRE = "key long, kind int, chunk long, blob binary"
_WIRE_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)
_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RANKS = np.arange(1, K + 1)


def discounts(frequency: np.ndarray, total: float) -> np.ndarray:
    """Katz's discount for each count from 0 to K (0: unused) by the numbers of types seen 1 to K + 1 times."""
    n = np.asarray(frequency, np.float64)
    out = np.ones(K + 1)
    if total <= 0:
        return out
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = -1.0
        if n[r - 1] and n[r] and common < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.where(count > K, 0, count)] * count


class Unigrams:
    """p(w) by count, and the mass of the unknown token."""

    def __init__(self, n: float, types: float, frequency: np.ndarray):
        self.n, self.types = n, types
        self.d = discounts(frequency, n)
        left = float(((1 - self.d[1:]) * _RANKS * frequency[:K]).sum())
        self.extra = 0.0 if left > 0 else 1.0  # nothing to discount: one more, unseen token
        self.unknown = (left + self.extra) / (n + self.extra) if n > 0 else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(self.d, count) / max(self.n + self.extra, 1.0), self.unknown)


def _mix(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _frequencies(count: np.ndarray) -> np.ndarray:
    """How many of the counts are 1 to K + 1."""
    return np.bincount(count[count <= K + 1], minlength=K + 2)[1:].astype(np.float64)


def _by_kind(table, kind: int) -> list:
    kinds = table.column("kind").to_numpy()
    blobs = one_array(table.column("blob"))
    owners = table.column("chunk").to_numpy()
    return sorted(((int(owners[i]), blobs[int(i)].as_buffer()) for i in np.flatnonzero(kinds == kind)), key=lambda x: x[0])


def _edges(owner: np.ndarray) -> list[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], owner.size])]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal values."""
    at = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if x.size else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, x.size))


def _steps(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ascending values within runs as steps; the first of a run in full."""
    out = np.diff(x, prepend=0)
    out[at] = x[at]
    return out


def _walked(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse of _steps."""
    total = np.cumsum(steps)
    at = np.cumsum(sizes) - sizes
    return total - np.repeat(total[at] - steps[at], sizes)


def _folded(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours as non-negative numbers; small where x changes little."""
    d = np.diff(x, prepend=0)
    return (d << 1) ^ (d >> 63)


def _unfolded(z: np.ndarray) -> np.ndarray:
    return np.cumsum((z >> 1) ^ -(z & 1))


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _read(rows: list[tuple], owners: int, modulus: int, remainder: int) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The state of a chunk, and (owner, blob) of its words.  rows: (doc_id or None, text)."""
    number: dict[bytes, int] = {}
    codes, size = [], []
    for _, text in rows:
        words = tokens_of(text)
        size.append(len(words))
        codes.extend([number.setdefault(w, len(number)) for w in words])
    codes, size = np.array(codes, np.int64), np.array(size, np.int64)
    # frequent words get small numbers, which pack well
    order = np.argsort(-np.bincount(codes, minlength=len(number)), kind="stable")
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    codes, words = place[codes], list(number)
    words = [words[i] for i in order.tolist()]
    end = int(place[number[END]]) if rows else 0
    held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i, _ in rows], bool)
    learned = np.bincount(codes, np.repeat(~held_out, size), len(words)).astype(np.int64)
    del number
    owner = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * owners >> 32
    order = np.array(sorted(range(len(words)), key=list(zip(owner.tolist(), words)).__getitem__), np.int64)
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    ids = np.array([NULL_ID if i is None else i for i, _ in rows], np.int64)
    null = np.array([i is None for i, _ in rows], bool)
    state = pack(ids, np.packbits(null), np.packbits(held_out), squeezed(size), squeezed(codes), squeezed(place), np.array([place[end]], np.int64))
    out = []
    for to, a, b in _edges(owner[order]):
        mine = [words[i] for i in order[a:b].tolist()]
        out.append((to, pack(pa.compress(b" ".join(mine), "zstd", asbytes=True), np.array([sum(map(len, mine)) + b - a - 1], np.int64), squeezed(learned[order[a:b]]))))
    return state, out


class Grams:
    """The n-grams of a chunk.  Its words are numbered in the order of their numbers in the corpus, from 1 on; 0 is the start of a text."""

    def __init__(self, state, known: list, owners: int, train_tokens: float):
        self.ids, null, held_out, size, codes, place, end = unpack(state)
        n = self.ids.size
        self.null, self.held_out = np.unpackbits(null, count=n).astype(bool), np.unpackbits(held_out, count=n).astype(bool)
        self.size = expanded(size.tobytes())
        self.begin = np.cumsum(self.size) - self.size
        numbers, counts = [], []
        for owner, blob in known:
            number, count = unpack(blob)
            numbers.append(expanded(number.tobytes()) * owners + owner + 1)
            counts.append(expanded(count.tobytes()))
        numbers, counts = np.concatenate(numbers), np.concatenate(counts)
        order = np.argsort(numbers)
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(1, order.size + 1)
        #: Number in the corpus and count of each word; a start is followed as often as documents are learned.
        self.number, self.count = np.append(0, numbers[order]), np.append(counts[int(end[0])], counts[order])
        w3 = rank[expanded(place.tobytes())][expanded(codes.tobytes())]
        w2, w1 = np.zeros_like(w3), np.zeros_like(w3)
        w2[1:] = w3[:-1]
        w2[self.begin] = 0
        w1[1:] = w2[:-1]
        w1[self.begin] = 0
        self.token, m = w3, order.size + 1
        pairs, which = np.unique(w2 * m + w3, return_inverse=True)
        w2, w3 = pairs // m, pairs % m
        share = np.ceil(self.count * (owners / max(train_tokens, 1.0))).astype(np.int64)
        #: Parts that a middle word is split into, the same wherever it occurs.
        self.parts = np.where(share > HOT, share, 1)
        owner = ((_mix(self.number)[w2] + _mix(self.number)[w3] % self.parts[w2].astype(np.uint64)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner.astype(np.uint16) if owners < 1 << 16 else owner, kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        self.w2, self.w3, self.owner, self.pair = w2[order], w3[order], owner[order], place[which]
        triples, self.triple = np.unique(self.pair * m + w1, return_inverse=True)
        self.of, self.w1 = triples // m, triples % m
        self.learned = np.bincount(self.triple, np.repeat(~self.held_out, self.size), triples.size).astype(np.int64)
        self.m = m

    def blocks(self, each: int = 1):
        """(range or, of `each` ranges, owner; pairs from, to, triples from, to)."""
        for to, a, b in _edges(self.owner // each):
            c, d = np.searchsorted(self.of, [a, b])
            yield to, a, b, int(c), int(d)

    def request(self, a: int, b: int, c: int, d: int) -> bytes:
        """Pairs a to b and their triples c to d.  Words are named by their place in a list of those that occur."""
        at, size = _runs(self.owner[a:b])
        w2, w3, w1 = self.w2[a:b], self.w3[a:b], self.w1[c:d]
        words = np.unique(np.concatenate([w2, w3, w1]))
        lead, pairs = _runs(self.owner[a:b] * self.m + w2)
        first, triples = _runs(self.of[c:d])
        w3, w1 = np.searchsorted(words, w3), np.searchsorted(words, w1)
        named = np.searchsorted(words, w2[lead])
        # numbers follow counts, so that the counts of words in order hardly change from one to the next
        ints = (self.owner[a:b][at], size, np.diff(self.number[words], prepend=0), _folded(self.count[words]), named, pairs, _steps(w3, lead), triples, _steps(w1, first))
        return pack(*map(squeezed, ints), np.packbits(self.parts[w2[lead]] > 1), squeezed(self.learned[c:d]))


def _wanted(count: np.ndarray) -> np.ndarray:
    """Whether the context of an n-gram with this count is asked for: to back off, or as it may have nothing to discount."""
    return (count == 0) | (count > K)


def _class_sums(needed: np.ndarray, context: np.ndarray, count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each of the needed contexts (ascending): seen types by count from 1 to K, seen types by the count one order below, and the sum of
    those counts above K.  context: of each type."""
    out = np.zeros((needed.size, 2 * K + 1), np.int64)
    if not needed.size:
        return out
    at = np.searchsorted(needed, context)
    at[at == needed.size] = 0
    own = np.flatnonzero((needed[at] == context) & (count > 0))
    at, count, below = at[own], count[own], below[own]
    for r in range(1, K + 1):
        out[:, r - 1] = np.bincount(at[count == r], minlength=needed.size)
        out[:, K + r - 1] = np.bincount(at[below == r], minlength=needed.size)
    large = below > K
    out[:, 2 * K] = np.bincount(at[large], below[large], needed.size)
    return out


def _columns_squeezed(x: np.ndarray) -> bytes:
    return squeezed(x.T.ravel())


def _columns_expanded(x) -> np.ndarray:
    return expanded(x.tobytes()).reshape(2 * K + 1, -1).T


class Requests:
    """What chunks sent to an owner.  Words are numbered anew, in the order of their numbers in the corpus."""

    def __init__(self, chunks: list[int], blobs: list):
        self.chunks = chunks
        named, self.parts = [], []
        for blob in blobs:
            got = unpack(blob)
            ranges, sizes, steps, count, lead, pairs, w3, triples, w1 = (expanded(x.tobytes()) for x in got[:9])
            w2, learned = np.repeat(lead, pairs), expanded(got[10].tobytes())
            named.append((np.cumsum(steps), _unfolded(count), lead[np.unpackbits(got[9], count=lead.size).astype(bool)]))
            cut = np.append(0, np.cumsum(sizes))
            self.parts.append((ranges, cut, np.append(0, np.cumsum(triples))[cut], [x.astype(np.int32) for x in (w2, _walked(w3, pairs), triples, _walked(w1, triples), learned)]))
        self.numbers, place = np.unique(np.concatenate([x[0] for x in named]), return_inverse=True)
        self.count, self.hot = np.zeros(self.numbers.size, np.int64), np.zeros(self.numbers.size, bool)
        at = 0
        for (own, count, split), (_, _, _, columns) in zip(named, self.parts):
            local = place[at : at + own.size].astype(np.int32)
            at += own.size
            self.count[local] = count
            self.hot[local[split]] = True
            for i in (0, 1, 3):
                columns[i] = local[columns[i]]

    def ranges(self) -> list[int]:
        return np.unique(np.concatenate([x[0] for x in self.parts])).tolist()

    def of_range(self, one: int):
        """(chunk, w2, w3, triples of each pair, w1, learned) of the chunks that have any."""
        for chunk, (ranges, cut, cut3, columns) in zip(self.chunks, self.parts):
            i = int(np.searchsorted(ranges, one))
            if i < ranges.size and ranges[i] == one:
                pairs, triples = slice(cut[i], cut[i + 1]), slice(cut3[i], cut3[i + 1])
                yield chunk, *(columns[k][pairs].astype(np.int64) for k in (0, 1, 2)), *(columns[k][triples].astype(np.int64) for k in (3, 4))


def _count_triples(requests: Requests, one: int, owners: int):
    """(key, kind, blob) of a range's answers to the chunks, of what it knows of split contexts, and of its frequencies of counts."""
    numbers, count1, hot = requests.numbers, requests.count, requests.hot
    w = numbers.size
    chunks, pair_keys, pair_sizes, w1s, learned = [], [], [], [], []
    for chunk, w2, w3, sizes, w1, c in requests.of_range(one):
        chunks.append(chunk)
        pair_keys.append(w2 * w + w3)
        pair_sizes.append(sizes)
        w1s.append(w1)
        learned.append(c)
    learned = np.concatenate(learned)
    pairs, pair_of = np.unique(np.concatenate(pair_keys), return_inverse=True)
    del pair_keys
    triples, triple_of = np.unique(np.repeat(pair_of, np.concatenate(pair_sizes)) * w + np.concatenate(w1s), return_inverse=True)
    c3 = np.bincount(triple_of, learned, triples.size).astype(np.int64)
    of, w1 = triples // w, triples % w
    c2 = np.bincount(of, c3, pairs.size).astype(np.int64)
    w2, w3 = pairs // w, pairs % w
    lead_of, context = w2, w2[of] * w + w1
    # what chunks ask for, and what is split
    asks, needed2, needed3 = [], [np.flatnonzero(hot)], [context[hot[lead_of[of]]]] if hot.any() else []
    x = y = 0
    for sizes, w1_ in zip(pair_sizes, w1s):
        own2, own3 = pair_of[x : x + sizes.size], triple_of[y : y + w1_.size]
        x, y = x + sizes.size, y + w1_.size
        two, three = c2[own2], c3[own3]
        lead = np.unique(lead_of[own2[_wanted(two)]])
        back = np.unique(context[own3[_wanted(three)]])
        asks.append((squeezed(two), squeezed(three), lead[count1[lead] > 0], back))
        needed2.append(asks[-1][2])
        needed3.append(back)
    del pair_of, triple_of, learned
    needed2, needed3 = np.unique(np.concatenate(needed2)), np.unique(np.concatenate(needed3))
    sums2 = _class_sums(needed2, lead_of, c2, count1[w3])
    sums3 = _class_sums(needed3, context, c3, c2[of])
    seen3 = (sums3[:, :K].sum(axis=1) > 0) | np.isin(needed3, context[c3 > K])
    out = [(-1, STATS, np.concatenate([_frequencies(c2), _frequencies(c3)]).tobytes())]

    def spread(kind: int, g2, g1, rest) -> None:
        """Split contexts, to their owners."""
        to = ((_mix(g2) + _mix(g1 + 1)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for key, a, b in _edges(to[order]):
            own = order[a:b]
            out.append((-2 - key, kind, pack(g2[own], g1[own], rest[own].ravel())))

    if hot.any():
        mine3, mine2 = np.flatnonzero(hot[needed3 // w]), np.flatnonzero(hot[needed2])
        g2, g1 = numbers[np.append(needed3[mine3] // w, needed2[mine2])], np.append(numbers[needed3[mine3] % w], np.full(mine2.size, -1))
        spread(PARTS, g2, g1, np.concatenate([sums3[mine3], sums2[mine2]]))
    asked: list[tuple] = []
    for chunk, (two, three, lead, back) in zip(chunks, asks):
        at2, at3 = np.searchsorted(needed2, lead), np.searchsorted(needed3, back)
        if hot.any():
            far2, far3 = lead[hot[lead]], back[hot[back // w]]
            g2, g1 = np.append(numbers[far2], numbers[far3 // w]), np.append(np.full(far2.size, -1), numbers[far3 % w])
            asked.append((g2, g1, np.full(g2.size, chunk)))
            at2, at3 = at2[~hot[lead]], at3[~hot[back // w]]
        at3 = at3[seen3[at3]]
        out.append((chunk, ANSWERS, pack(two, three, _columns_squeezed(sums2[at2]), _columns_squeezed(sums3[at3]))))
    if asked:
        spread(ASKED, *(np.concatenate(z) for z in zip(*asked)))
    return out


def _add_contexts(told: list, asked: list):
    """(chunk, blob): the sums of the split contexts that each chunk asked for."""
    if not asked:
        return
    g2, g1, sums = (np.concatenate(x) for x in zip(*((a, b, c.reshape(-1, 2 * K + 1)) for a, b, c in map(unpack, told))))
    a2, a1, chunk = (np.concatenate(x) for x in zip(*map(unpack, asked)))
    order = np.lexsort((np.append(g1, a1), np.append(g2, a2)))
    s2, s1 = np.append(g2, a2)[order], np.append(g1, a1)[order]
    number = np.empty(order.size, np.int64)
    number[order] = np.cumsum(np.append(True, (s2[1:] != s2[:-1]) | (s1[1:] != s1[:-1]))) - 1
    total = np.zeros((int(number.max()) + 1, 2 * K + 1), np.int64)
    np.add.at(total, number[: g2.size], sums)
    mine = number[g2.size :]
    for c in np.unique(chunk).tolist():
        one, first = np.unique(mine[chunk == c], return_index=True)
        rows = np.flatnonzero(chunk == c)[first]
        yield c, pack(a2[rows], a1[rows], total[one].ravel())


def _scores(grams: Grams, unigrams: Unigrams, answers: list, contexts: list, frequency: np.ndarray, order: int) -> np.ndarray:
    """log10 p of each token."""
    d2, d3 = discounts(frequency[: K + 1], unigrams.n), discounts(frequency[K + 1 :], unigrams.n)
    m = grams.m
    c2, c3 = np.zeros(grams.w2.size, np.int64), np.zeros(grams.of.size, np.int64)
    got = {}
    for _, blob in answers:
        ranges, *blobs = unpack(blob)
        got.update(zip(ranges.tolist(), blobs))
    sums2 = np.zeros((m, 2 * K + 1))
    for to, a, b, c, d in grams.blocks():
        blob = unpack(got[to].tobytes())
        c2[a:b], c3[c:d] = expanded(blob[0].tobytes()), expanded(blob[1].tobytes())
        got[to] = blob[2:]
    # c(u v) of each triple: the count of the pair before it in a text, or of the starts
    before = np.zeros_like(grams.pair)
    before[1:] = grams.pair[:-1]
    total = c2[before]
    total[grams.begin] = grams.count[0]
    total3 = np.zeros(grams.of.size, np.int64)
    total3[grams.triple] = total
    split = grams.parts > 1
    asked3 = np.flatnonzero(_wanted(c3) & (total3 > 0))
    sums3 = np.zeros((asked3.size, 2 * K + 1))
    for to, a, b, c, d in grams.blocks():
        two, three = got.pop(to)
        lead = np.unique(grams.w2[a:b][_wanted(c2[a:b])])
        lead = lead[(grams.count[lead] > 0) & ~split[lead]]
        sums2[lead] = _columns_expanded(two)
        x, y = np.searchsorted(asked3, [c, d])
        own = asked3[x:y]
        w2 = grams.w2[grams.of[own]]
        near = ~split[w2]
        _, which = np.unique(w2[near] * m + grams.w1[own[near]], return_inverse=True)
        sums3[x:y][near] = _columns_expanded(three)[which]
    if contexts:
        g2, g1, sums = (np.concatenate(x) for x in zip(*((a, b, s.reshape(-1, 2 * K + 1)) for a, b, s in (unpack(blob) for _, blob in contexts))))
        one = g1 < 0
        sums2[np.searchsorted(grams.number, g2[one])] = sums[one]
        keys = np.searchsorted(grams.number, g2[~one]) * m + np.searchsorted(grams.number, g1[~one])
        by_key = np.argsort(keys)
        keys, sums = keys[by_key], sums[~one][by_key]
        w2 = grams.w2[grams.of[asked3]]
        far = np.flatnonzero(split[w2])
        sums3[far] = sums[np.searchsorted(keys, w2[far] * m + grams.w1[asked3[far]])]

    def weights(total, sums, d, below_d, below_total):
        """Denominator and backoff weight of contexts."""
        seen = sums[:, :K] @ _RANKS
        whole = total + ((total > 0) & (sums[:, :K].sum(axis=1) == 0))  # nothing to discount: one more, unseen token
        kept = sums[:, :K] @ (d[1:] * _RANKS) + (total - seen)
        below = (sums[:, K : 2 * K] @ (below_d[1:] * _RANKS) + sums[:, 2 * K]) / below_total
        return np.maximum(whole, 1), np.where(total > 0, (whole - kept) / np.maximum(whole, 1) / (1.0 - below), 1.0)

    p1 = unigrams.p(grams.count)
    whole2, alpha2 = weights(grams.count.astype(np.float64), sums2, d2, unigrams.d, max(unigrams.n + unigrams.extra, 1.0))
    # sums are known of the contexts asked for only; the others all have something to discount, and are not backed off from
    asked = np.zeros(m, bool)
    asked[grams.w2[_wanted(c2)]] = True
    whole2 = np.where(asked, whole2, np.maximum(grams.count, 1))
    p2 = np.where(c2 > 0, discounted(d2, c2) / whole2[grams.w2], alpha2[grams.w2] * p1[grams.w3])
    if order == 2:
        return np.log10(p2)[grams.pair]
    p = np.where(total3 > 0, discounted(d3, c3) / np.maximum(total3, 1), p2[grams.of])
    of, c = grams.of[asked3], c3[asked3]
    whole3, alpha3 = weights(total3[asked3].astype(np.float64), sums3, d3, d2, whole2[grams.w2[of]])
    p[asked3] = np.where(c > 0, discounted(d3, c) / whole3, alpha3 * p2[of])
    return np.log10(p)[grams.triple]


def katz_scores(docs: DataFrame, text: str = "text", modulus: int = 7, remainder: int = 2, order: int = 3, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; learned from the documents
    whose crc32 of doc_id, modulo `modulus`, is not `remainder`.  order: 3, or 2 for bigrams."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    owners = owners_for(size, -(-size // chunk_bytes), range_bytes)  # of words, and ranges of middle words
    each = min(RANGES, max(1, owners // LEAST_OWNERS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        forget_model()
        chunk = TaskContext.get().partitionId() << 24
        held, held_bytes = [], 0

        def flush():
            state, words = _read(held, owners, modulus, remainder)
            forget_model()
            return batch_of(_WIRE_ARROW, [chunk, *(o for o, _ in words)], [STATE] + [WORDS] * len(words), [chunk] * (len(words) + 1), [state, *(b for _, b in words)]).to_batches()

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), one_array(batch.column(1))):
                held.append((doc_id, value.as_py()))
                held_bytes += len(held[-1][1])
                if held_bytes >= chunk_bytes:
                    yield from flush()
                    chunk, held, held_bytes = chunk + 1, [], 0
        if held:
            yield from flush()

    def count_words(key, table):
        forget_model()
        me = key[0].as_py()
        column = parts_of(table)
        total: dict[bytes, int] = {}
        parts = []
        for chunk, blob in zip(column("chunk").to_pylist(), column("blob")):
            words, size, counts = unpack(blob.as_buffer())
            words = pa.decompress(words.tobytes(), int(size[0]), "zstd", asbytes=True).split(b" ")
            parts.append((chunk, words))
            for w, c in zip(words, expanded(counts.tobytes()).tolist()):
                total[w] = total.get(w, 0) + c
        number = {w: i for i, w in enumerate(sorted(total, key=lambda w: (-total[w], w)))}  # frequent words have small numbers
        c = np.fromiter(total.values(), np.int64, len(total))
        keys, kinds, blobs = [-1], [STATS], [np.concatenate([[c.sum(), (c > 0).sum()], _frequencies(c[c > 0])]).tobytes()]
        for chunk, words in parts:
            keys.append(chunk)
            kinds.append(KNOWN)
            blobs.append(pack(squeezed(np.fromiter(map(number.__getitem__, words), np.int64, len(words))), squeezed(np.fromiter(map(total.__getitem__, words), np.int64, len(words)))))
        return batch_of(_WIRE_ARROW, keys, kinds, [me] * len(keys), blobs)

    def statistics(batches):
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                if kind == STATS:
                    yield pa.RecordBatch.from_arrays([pa.array([STATE], pa.int32()), pa.array([np.frombuffer(blob.as_buffer(), np.float64).tolist()], pa.list_(pa.float64()))], ["kind", "x"])

    def summed(wire: DataFrame, n: int) -> DataFrame:
        """kind (of states), x: the sums of all owners' statistics, one row."""
        return wire.mapInArrow(statistics, "kind int, x array<double>").groupBy("kind").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(n)]).alias("x"))

    first = checkpoint(rows.mapInArrow(read, _WIRE))
    known = checkpoint(merged(first.filter(F.col("kind") == WORDS)).groupBy("key").applyInArrow(count_words, _WIRE))
    base = summed(known, K + 3).first()
    base = np.array(base["x"] if base else np.zeros(K + 3))
    unigrams = Unigrams(base[0], base[1], base[2:])
    state = first.filter(F.col("kind") == STATE).select("chunk", "kind", "blob").repartition(tasks, "chunk")
    known = known.filter(F.col("kind") == KNOWN).repartition(tasks, "key")

    def grams_of(table, answers) -> Grams:
        return Grams(one_array(table.column("blob"))[0].as_buffer(), _by_kind(answers, KNOWN), owners, unigrams.n)

    def send(key, table, answers):
        forget_model()
        if not table.num_rows:
            return batch_of(_WIRE_ARROW, *[[]] * len(_WIRE_ARROW))
        grams = grams_of(table, answers)
        blocks = list(grams.blocks(each))
        return batch_of(_WIRE_ARROW, [x[0] for x in blocks], [ANSWERS] * len(blocks), [key[0].as_py()] * len(blocks), [grams.request(*x[1:]) for x in blocks])

    def count_triples(key, table):
        me = key[0].as_py()
        column = parts_of(table)
        requests = Requests(column("chunk").to_pylist(), [b.as_buffer() for b in column("blob")])
        del table, column
        out, told = [], {}
        for one in requests.ranges():
            forget_model()
            for to, kind, blob in _count_triples(requests, one, owners):
                if kind == ANSWERS:
                    told.setdefault(to, []).append((one, blob))
                else:
                    out.append((to, kind, blob))
        out += [(chunk, ANSWERS, pack(np.array([r for r, _ in parts], np.int64), *(b for _, b in parts))) for chunk, parts in told.items()]
        keys, kinds, blobs = zip(*out)
        return batch_of(_WIRE_ARROW, keys, kinds, [me] * len(keys), blobs)

    def split_contexts(batches):
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column("kind").to_numpy(), [PARTS, ASKED])))

    def add_contexts(key, table):
        got = list(_add_contexts([b for _, b in _by_kind(table, PARTS)], [b for _, b in _by_kind(table, ASKED)]))
        return batch_of(_WIRE_ARROW, [c for c, _ in got], [CONTEXTS] * len(got), [key[0].as_py()] * len(got), [b for _, b in got])

    def evaluate(key, table, answers):
        forget_model()
        if not table.num_rows:  # what was sent to the owners of contexts
            return batch_of(_OUT, *[[]] * len(_OUT))
        grams = grams_of(table, answers)
        p = _scores(grams, unigrams, _by_kind(answers, ANSWERS), _by_kind(answers, CONTEXTS), np.array(table.column("x")[0].as_py()), order)
        base = np.log10((grams.count + 1.0) / (unigrams.n + unigrams.types + 1.0))
        add = lambda x: np.add.reduceat(x, grams.begin)
        n = grams.ids.size
        return batch_of(
            _OUT, pa.array(grams.ids, pa.int64(), mask=grams.null), grams.held_out, grams.size, add((grams.count > 0)[grams.token].astype(np.int64)), np.full(n, int(unigrams.n)), add(base[grams.token]), add(p)
        )

    sent = merged(state.groupBy("chunk").cogroup(known.groupBy("key")).applyInArrow(send, _WIRE))
    answers = sent.groupBy("key").applyInArrow(count_triples, _WIRE).repartition(tasks, "key")
    contexts = answers.mapInArrow(split_contexts, _WIRE).groupBy("key").applyInArrow(add_contexts, _WIRE)
    told = state.join(F.broadcast(summed(answers, 2 * K + 2)), "kind")  # one row
    # all three are dealt by key already, and their union stays so: nothing is shuffled again
    given = answers.union(contexts.repartition(tasks, "key")).union(known)
    return told.groupBy("chunk").cogroup(given.groupBy("key")).applyInArrow(evaluate, _DDL)
