"""Matching: candidate pairs, aligned series similarity, neighbour votes, and one score for each query and candidate."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.series import log_mean_exp, weighted_jaccard
from sightline.operators.shared import every_pair


@dataclass(frozen=True)
class Comparison:
    """Settings of the aligned comparison of series."""

    bins: int = 240
    gradient_weight: float = 0.5
    shift_fraction: float = 0.10
    stretch_steps: int = 8
    stretch_base: float = 1.2
    tau: float = 0.05
    weight_centre: float = 120.0
    weight_width: float = 35.0
    shift_scale: float = 0.16
    stretch_scale: float = 0.32

    def __post_init__(self):
        if self.bins < 2 or not 0 <= self.gradient_weight <= 1 or self.tau <= 0:
            raise ValueError("bins, gradient_weight or tau out of range")

    def alignments(self) -> list[tuple[float, int]]:
        """(stretch, shift) in the order that decides ties."""
        top = round(self.shift_fraction * self.bins)
        stretches = [self.stretch_base ** (k / 8) for k in range(-self.stretch_steps, self.stretch_steps + 1)]
        return [(t, b) for t in stretches for b in range(-top, top + 1)]


def candidate_pairs(queries: DataFrame, catalog: DataFrame, on: list[str], query_key: str, catalog_key: str) -> DataFrame:
    """All pairs that agree on `on`, without a query's own key (held out)."""
    return queries.join(catalog, on).filter(F.col(query_key) != F.col(catalog_key))


#: Numbers of aligned queries, and references, that the comparison holds at a time; about how many pairs of blocks it is dealt into, and the least and the largest rows of a block.
ALIGNED, CHUNK, GROUPS, LEAST_BLOCK, MOST_BLOCK = 3 << 19, 32, 64, 256, 1024


# ---- the block kernel ------------------------------------------------------------------------------------------------


def _at(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The series in the last axis of v at places p, between whose neighbours it is linear."""
    low = np.floor(p).astype(int)
    return (v[..., np.minimum(low + 1, v.shape[-1] - 1)] - v[..., low]) * (p - low) + v[..., low]


def _channels(depths: np.ndarray, start: np.ndarray, end: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth and gradient channel, (rows, bins) each, of depths (rows, values); gradients are 0 outside each row's start and end."""
    clipped = np.maximum(depths, 0.0)
    n = depths.shape[1]
    angle, g = np.arange(n) * 180.0 / (n - 1), np.zeros(depths.shape)
    spans, of = np.unique(np.column_stack([start, end]), axis=0, return_inverse=True)
    for k, (low, high) in enumerate(spans):
        inside, rows = np.flatnonzero((angle > low) & (angle < high)), np.flatnonzero(of.ravel() == k)
        if inside.size > 1:
            g[np.ix_(rows, inside)] = np.gradient(clipped[np.ix_(rows, inside)], axis=1)
    places = np.linspace(0, n - 1, bins)
    return _at(np.sqrt(clipped), places), _at(np.sign(g) * np.sqrt(np.abs(g)), places)


def _aligned(channel: np.ndarray, alignments: list[tuple[float, int]]) -> np.ndarray:
    """(rows, alignments, bins) of a channel (rows, bins)."""
    n = channel.shape[1]
    unit = np.arange(n) / (n - 1)
    out = np.zeros((len(channel), len(alignments), n))
    stretched: dict[float, np.ndarray] = {}
    for i, (t, b) in enumerate(alignments):
        if t not in stretched:
            p = ((unit - 0.5) / t + 0.5) * (n - 1)
            stretched[t] = np.where((p < 0) | (p > n - 1), 0.0, _at(channel, np.clip(p, 0, n - 1)))
        s = stretched[t]
        if abs(b) < n:
            out[:, i, max(0, b) : n + min(0, b)] = s[:, max(0, -b) : n - max(0, b)]
    return out


def _best_alignments(queries: list, refs: list, alignments: list[tuple[float, int]], weight: np.ndarray, penalty: np.ndarray, slope: np.ndarray, gradient_weight: float):
    """Yields (first query, first reference, similarity, alignment), the last two (references, queries), for parts of the channels (depth, gradient) of each scale of queries and of references.

    Where a reference's channel is 0 it adds nothing to what it has in common with an aligned query, so only its other bins are looked at; what is left of a sum of absolute differences
    are minima.  Single precision, whose error is bounded, tells which alignments of a pair can be the best; those are compared exactly.  References are looked at one by one, so that what
    is held of the aligned queries for one bin, and of their scores, stays in a core's cache."""
    bins, many = len(weight), len(alignments)
    parts = lambda x: np.concatenate([np.maximum(x, 0.0) * weight, np.maximum(-x, 0.0) * weight], axis=-1)
    share = [(1 - gradient_weight) / len(refs), gradient_weight / len(refs)] * len(refs)
    norm = lambda x: np.abs(x) @ weight
    every = [np.concatenate([norm(d), norm(g)]) for d, g in (*queries, *refs)]
    sizes = np.concatenate(every)
    usual = np.isfinite(sizes).all() and sizes.max(initial=0.0) < 1e15 and sizes[sizes > 0].min(initial=1.0) > 1e-15
    kind = np.float32 if usual else np.float64
    error = kind(8 * (2 * bins + 8) * float(np.finfo(kind).eps))
    cells, norms = [], []
    for pair in refs:
        for c, x in enumerate(pair):
            values, own = parts(x) if c else x * weight, norm(x)
            values = np.where(np.isfinite(own)[:, None], values, 0.0).astype(kind)  # what is not finite has nothing in common with anything
            cells.append([list(zip(at.tolist(), row[at])) for row in values for at in (np.flatnonzero(row),)])
            norms.append(own)
    size = np.nan_to_num(np.stack(norms, axis=1), posinf=0.0).astype(kind)[..., None, None]
    step = max(1, ALIGNED // (3 * bins * many))
    for a in range(0, len(queries[0][0]), step):
        exact, rough, owns = [], [], []
        for pair in queries:
            for c, x in enumerate(pair):
                x = _aligned(x[a : a + step], alignments)
                x = x * slope[:, None] if c else x
                exact.append(x.reshape(-1, bins))
                owns.append(norm(x))
                told = np.where(np.isfinite(owns[-1])[..., None], parts(x) if c else x * weight, 0.0)
                rough.append(np.ascontiguousarray(told.astype(kind).transpose(2, 1, 0)))  # by bin, alignment and query
        n = len(exact[0]) // many
        mine = np.stack([np.nan_to_num(own.T, posinf=0.0).astype(kind, order="C") for own in owns]) + np.finfo(kind).tiny  # nothing is divided by 0
        fine, shares = penalty.astype(kind)[:, None], np.array(share, kind)
        common, rest, held, score, line = np.empty_like(mine), np.empty_like(mine), np.empty_like(mine[0]), np.empty_like(mine[0]), np.empty(n, kind)
        near = np.zeros((CHUNK, -(-held.size // 8) * 8), bool)
        for b in range(0, len(refs[0][0]), CHUNK):
            rows = min(CHUNK, len(refs[0][0]) - b)
            for r in range(rows):
                for k, turned in enumerate(rough):
                    out = common[k]
                    if not cells[k][b + r]:
                        out.fill(0.0)
                    for bin_, value in cells[k][b + r]:
                        line.fill(value)  # the least of two arrays is found faster than that of an array and a number
                        np.minimum(turned[bin_], line, out=out)
                        if out is held:
                            np.add(common[k], held, out=common[k])
                        out = held
                np.subtract(mine, common, out=rest)
                np.add(rest, size[b + r], out=rest)
                np.divide(common, rest, out=rest)
                np.dot(shares, rest.reshape(len(rest), -1), out=score.reshape(-1))
                np.multiply(score, fine, out=score)
                top = score.max(axis=0)
                np.greater_equal(score, np.where(top > 0, top - error, kind(np.inf)), out=near[r, : held.size].reshape(many, n))
            words = np.flatnonzero(near[:rows].view(np.uint64))  # few are set
            word, byte = np.nonzero(near[:rows].reshape(-1, 8)[words])
            r, al = np.divmod(words[word] * 8 + byte, near.shape[1])
            al, q = np.divmod(al, n)
            pair = r * n + q
            order = np.argsort(pair.astype(np.min_scalar_type(rows * n)), kind="stable")
            r, q, al, pair = r[order], q[order], al[order], pair[order]
            place, value = q * many + al, np.zeros(len(r))
            for k, (x, own) in enumerate(zip(exact, owns)):
                apart = np.abs(x.take(place, axis=0) - refs[k // 2][k % 2].take(b + r, axis=0)) @ weight
                both = own.take(place) + norms[k][b + r]
                total = both + apart
                value += share[k] * np.where(total > 0, (both - apart) / np.where(total > 0, total, 1.0), 0.0)
            value *= penalty[al]
            similarity, best = np.zeros((rows, n)), np.zeros((rows, n), int)
            if len(pair):
                lead = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                most = np.maximum.reduceat(value, lead)
                hit = np.flatnonzero(value == np.repeat(most, np.diff(np.append(lead, len(pair)))))
                pair, where = np.unique(pair[hit], return_index=True)  # the first one of equal alignments
                similarity.ravel()[pair], best.ravel()[pair] = value[hit[where]], al[hit[where]]
            yield a, b, similarity, best


def _alike(queries: DataFrame, catalog: DataFrame) -> None:
    """Fails unless all ears hold as many series as each other, of the same lengths."""
    shape = lambda d: d.select(F.transform("profiles", lambda p: F.size(p["depths"])).alias("lengths")).groupBy("lengths").count()
    shapes = [r["lengths"] for r in shape(queries).unionByName(shape(catalog)).select("lengths").distinct().limit(3).collect()]
    if len(shapes) > 1 or any(not s or min(s) < 2 for s in shapes):
        raise ValueError(f"all ears need the same scales, with series of equal lengths, of two values or more: found lengths {shapes}")


class _Kernel:
    """The comparison of the series of two blocks, with what follows from the settings alone."""

    def __init__(self, settings: Comparison):
        self.settings, self.alignments = settings, settings.alignments()
        self.weight = np.exp(-0.5 * ((np.arange(settings.bins) * 180.0 / (settings.bins - 1) - settings.weight_centre) / settings.weight_width) ** 2)
        self.penalty = np.array([math.exp(-((abs(b) / settings.bins / settings.shift_scale) ** 4)) * math.exp(-((abs(math.log(t)) / settings.stretch_scale) ** 4)) for t, b in self.alignments])
        self.slope = np.array([t**-0.5 for t, _ in self.alignments])

    def scales(self, profiles: pa.ChunkedArray) -> list:
        """The channels of each scale of a column of profiles."""
        flat = pa.concat_arrays(profiles.chunks).flatten()
        n, fields = len(flat) // len(profiles), dict(zip([f.name for f in flat.type], flat.flatten()))
        out = []
        for s in range(n):
            at = pa.array(np.arange(s, len(flat), n))
            depths, start, end = (fields[c].take(at) for c in ("depths", "start", "end"))
            depths = depths.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(profiles), -1)
            out.append(_channels(depths, *(x.to_numpy(zero_copy_only=False).astype(float) for x in (start, end)), self.settings.bins))
        return out

    def parts(self, queries: list, refs: list):
        return _best_alignments(queries, refs, self.alignments, self.weight, self.penalty, self.slope, self.settings.gradient_weight)

    def similarities(self, queries: list, refs: list) -> np.ndarray:
        """(references, queries)"""
        out = np.zeros((len(refs[0][0]), len(queries[0][0])))
        for a, b, similarity, _ in self.parts(queries, refs):
            out[b : b + similarity.shape[0], a : a + similarity.shape[1]] = np.where(similarity <= 1e-12, 0.0, similarity)
        return out


def _spread(blocks: DataFrame, keys: list[str], groups: float) -> DataFrame:
    """blocks in partitions of a fixed number: a pair of blocks is few bytes and much work, so that small partitions must not be put together."""
    return blocks.repartition(max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(groups)), *keys)


def block_similarities(queries: DataFrame, catalog: DataFrame, settings: Comparison = Comparison()) -> DataFrame:
    """query_ear, ear, similarity, stretch, shift: the best alignment of each query series with each series of the same side and
    another sighting.

    queries, catalog: ear, sighting, side, profiles ARRAY<STRUCT<depths, start, end>> (one for each scale).  Both sides are dealt
    into blocks, and each pair of blocks is one task's group, so a task holds two blocks however large a side is; there are more than about GROUPS pairs of blocks only where a block would
    have more than MOST_BLOCK rows.  Fails if ears have different numbers of scales, no scale, or at one scale series of different lengths: what is compared was extracted alike."""
    _alike(queries, catalog)
    kernel = _Kernel(settings)
    stretches, shifts = np.array([t for t, _ in kernel.alignments]), np.array([b for _, b in kernel.alignments])
    schema = pa.schema([("query_ear", pa.string()), ("ear", pa.string()), ("similarity", pa.float64()), ("stretch", pa.float64()), ("shift", pa.int32())])

    def compare(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        who = [t.column(f"{p}_sighting").to_numpy().astype(str) for t, p in ((left, "q"), (right, "r"))]
        of = np.unique(np.concatenate(who), return_inverse=True)[1]
        q_of, r_of = of[: left.num_rows], of[left.num_rows :]
        names = [pa.concat_arrays(t.column(f"{p}_ear").chunks) for t, p in ((left, "q"), (right, "r"))]
        out = []
        for a, b, similarity, best in kernel.parts(kernel.scales(left.column("q_profiles")), kernel.scales(right.column("r_profiles"))):
            r, q = np.nonzero(r_of[b : b + len(best), None] != q_of[None, a : a + best.shape[1]])
            out.append((a + q, b + r, similarity[r, q], best[r, q]))
        q, r, top, best = (np.concatenate(x) for x in zip(*out))
        none = top <= 1e-12
        columns = (names[0].take(pa.array(q)), names[1].take(pa.array(r)), np.where(none, 0.0, top), np.where(none, 1.0, stretches[best]), np.where(none, 0, shifts[best]))
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    size = lambda df, name: df.groupBy("side").agg(F.count("*").alias(name))
    pairs = size(queries, "n").join(size(catalog, "m"), "side").agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("n")).first()["n"] or 0.0
    rows = min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(math.sqrt(pairs / GROUPS))))
    count = lambda df, name: df.groupBy("side").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    n, m = count(queries, "_n"), count(catalog, "_m")

    def blocks(df, prefix, own, other):
        dealt = df.join(n, "side").join(m, "side")
        spread = F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)).alias(f"{prefix}_{other[0]}")
        return dealt.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("ear", "sighting", "side", "profiles")], F.pmod(F.xxhash64("ear"), F.col(own[1])).cast("int").alias(f"{prefix}_{own[0]}"), spread)

    q, r = blocks(queries, "q", ("qb", "_n"), ("rb", "_m")), blocks(catalog, "r", ("rb", "_m"), ("qb", "_n"))
    q, r = (_spread(d, [f"{p}_side", f"{p}_qb", f"{p}_rb"], pairs / rows**2) for d, p in ((q, "q"), (r, "r")))
    return q.groupBy("q_side", "q_qb", "q_rb").cogroup(r.groupBy("r_side", "r_qb", "r_rb")).applyInArrow(compare, "query_ear string, ear string, similarity double, stretch double, shift int")


def symmetric_likeness(settings: Comparison = Comparison()) -> Callable:
    """like(r)(q), as `cohorts` takes it: the similarities of rows q with rows r, whose e are series measured from 0 to 180 degrees, averaged over both directions."""
    kernel = _Kernel(settings)
    shaped = lambda e: [_channels(e.astype(float), np.zeros(len(e)), np.full(len(e), 180.0), settings.bins)]

    def like(r):
        refs = shaped(r["e"])

        def of(q):
            mine = shaped(q["e"])
            return (kernel.similarities(mine, refs).T + kernel.similarities(refs, mine)) / 2

        return of

    return like


def pair_alignments(pairs: DataFrame, settings: Comparison = Comparison()) -> DataFrame:
    """i, j, stretch, shift: the alignment that `block_similarities` finds for the series a of i, as a query, and b of j, for each of pairs (i, j, a, b), measured from 0 to 180 degrees."""
    kernel = _Kernel(settings)
    alignments = np.array(kernel.alignments)

    def compare(table: pa.Table) -> pa.Table:
        a, b = (pa.concat_arrays(table.column(c).chunks) for c in "ab")
        a, b = a.slice(0, 1).flatten().to_numpy(zero_copy_only=False)[None, :], b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        shaped = [[_channels(e.astype(float), np.zeros(len(e)), np.full(len(e), 180.0), settings.bins)] for e in (a, b)]
        found = list(kernel.parts(*shaped))
        top, best = (np.concatenate([x[k][:, 0] for x in found]) for k in (2, 3))
        none = top <= 1e-12
        return table.select(["i", "j"]).append_column("stretch", pa.array(np.where(none, 1.0, alignments[best, 0]))).append_column("shift", pa.array(np.where(none, 0, alignments[best, 1]), pa.int32()))

    return pairs.groupBy("i").applyInArrow(compare, "i long, j long, stretch double, shift int")


def _best(s: np.ndarray, known: np.ndarray, rows: np.ndarray, columns: np.ndarray, tau: float) -> np.ndarray:
    """The largest of each group of rows and columns, which begin at these places, of what is known; NaN where nothing is."""
    top = np.maximum.reduceat(np.maximum.reduceat(np.where(known, s, -np.inf), rows, axis=0), columns, axis=1)
    return np.where(top > -np.inf, top, np.nan)


def _log_mean_exp(s: np.ndarray, known: np.ndarray, rows: np.ndarray, columns: np.ndarray, tau: float) -> np.ndarray:
    """The log-mean-exp of each group, as `_best` takes them."""
    top = _best(s, known, rows, columns, tau)
    add = lambda x: np.add.reduceat(np.add.reduceat(x, rows, axis=0), columns, axis=1)
    size = [np.diff(np.append(first, n)) for first, n in zip((rows, columns), s.shape)]
    each = np.repeat(np.repeat(np.nan_to_num(top), size[0], axis=0), size[1], axis=1)
    total, n = add(np.where(known, np.exp((s - each) / tau), 0.0)), add(known.astype(float))
    ok = n > 0
    return np.where(ok, top + tau * (np.log(np.where(ok, total, 1.0)) - np.log(np.where(ok, n, 1.0))), np.nan)


def _scored(queries: DataFrame, catalog: DataFrame, settings: Comparison, reduce, required: int) -> DataFrame:
    """query, candidate, score: the mean over the sides of what reduce makes of the similarities of a side, where there are `required` sides.

    All rows of a query are in one block, of both sides, and all of a candidate, so that a pair of blocks sends finished scores and no similarity is shuffled."""
    kernel, kinds = _Kernel(settings), {"query": queries.schema["query"].dataType, "candidate": catalog.schema["candidate"].dataType}

    def groups(table: pa.Table, prefix: str, key: str):
        keys = pa.concat_arrays(table.column(f"{prefix}_{key}").chunks).dictionary_encode(null_encoding="encode")
        return len(keys.dictionary), keys.indices.to_numpy(), keys.dictionary, table.column(f"{prefix}_sighting").to_numpy().astype(str), table.column(f"{prefix}_side").to_numpy().astype(str)

    def compare(key, left, right):
        empty = lambda t, c: pa.array([], t.schema.field(c).type)
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([empty(left, "q_query"), empty(right, "r_candidate"), pa.array([], pa.float64())], ["query", "candidate", "score"])
        (m, q_code, asked, q_who, q_side), (n, r_code, known, r_who, r_side) = groups(left, "q", "query"), groups(right, "r", "candidate")
        total, many = np.zeros((n, m)), np.zeros((n, m), int)
        for side in np.intersect1d(q_side, r_side):
            qi, ri = (np.flatnonzero(s == side) for s in (q_side, r_side))
            qi, ri = qi[np.argsort(q_code[qi], kind="stable")], ri[np.argsort(r_code[ri], kind="stable")]
            (gq, columns), (gr, rows) = np.unique(q_code[qi], return_index=True), np.unique(r_code[ri], return_index=True)
            s = kernel.similarities(*(kernel.scales(t.column(c).take(pa.array(i))) for t, c, i in ((left, "q_profiles", qi), (right, "r_profiles", ri))))
            score = reduce(s, r_who[ri][:, None] != q_who[qi][None, :], rows, columns, settings.tau)
            ok = ~np.isnan(score)
            total[np.ix_(gr, gq)] += np.where(ok, score, 0.0)
            many[np.ix_(gr, gq)] += ok
        r, q = np.nonzero(many >= required)
        return pa.Table.from_arrays([asked.take(pa.array(q)), known.take(pa.array(r)), pa.array(total[r, q] / many[r, q])], ["query", "candidate", "score"])

    wanted = lambda d, key: d.select(key, "sighting", "side", "profiles")
    ddl = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
    return both_sides(wanted(queries, "query"), wanted(catalog, "candidate"), ("query", "candidate"), compare, f"{ddl}, score double")


def both_sides(queries: DataFrame, catalog: DataFrame, keys: tuple[str, str], compare: Callable, ddl: str) -> DataFrame:
    """compare(key, left, right) for each pair of blocks of queries and catalog, whose columns are named q_ and r_ there.  All rows of one value of the key (one key for each table) are in one
    block, of whatever `side`; blocks are as large as those of `block_similarities`, but for a key with more rows."""
    count = lambda df: {r["side"]: r["n"] for r in df.groupBy("side").agg(F.count("*").alias("n")).collect()}
    left, right = count(queries), count(catalog)
    pairs = sum(n * right.get(side, 0) for side, n in left.items())
    rows = min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(math.sqrt(pairs / max(1, len(left)) / GROUPS))))
    n, m = (max(1, -(-max(x.values(), default=1) // rows)) for x in (left, right))

    def blocks(df, prefix, key, own, of, other, many):
        spread = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(f"{prefix}_{other}")
        dealt = df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns], F.pmod(F.xxhash64(key), F.lit(of)).cast("int").alias(f"{prefix}_{own}"), spread)
        return _spread(dealt, [f"{prefix}_qb", f"{prefix}_rb"], n * m)

    q, r = blocks(queries, "q", keys[0], "qb", n, "rb", m), blocks(catalog, "r", keys[1], "rb", m, "qb", n)
    return q.groupBy("q_qb", "q_rb").cogroup(r.groupBy("r_qb", "r_rb")).applyInArrow(compare, ddl)


def large_groups(df: DataFrame, key: str) -> DataFrame:
    """The values of key that have more rows of one side than a block may."""
    return df.groupBy(key, "side").count().filter(F.col("count") > MOST_BLOCK).select(key).distinct()


def _aligned_scores(queries: DataFrame, catalog: DataFrame, settings: Comparison, reduce, required: int, of_pairs) -> DataFrame:
    """`_scored`, but what has more rows than a block may goes by of_pairs(similarities: query, candidate, side, similarity), which shuffles them."""
    _alike(queries, catalog)
    queries, catalog = (d.select("ear", key, "sighting", "side", "profiles") for d, key in ((queries, "query"), (catalog, "candidate")))
    large = [(large_groups(queries, "query"), "query"), (large_groups(catalog, "candidate"), "candidate")]
    some = [not d.isEmpty() for d, _ in large]
    part = lambda d, k, how: d.join(large[k][0], large[k][1], how) if some[k] else d if how == "left_anti" else None
    few, small = part(queries, 0, "left_anti"), part(catalog, 1, "left_anti")
    out = _scored(few, small, settings, reduce, required)
    for q, c in ((part(queries, 0, "left_semi"), catalog), (few, part(catalog, 1, "left_semi"))):
        if q is not None and c is not None:
            pairs = block_similarities(q, c, settings).join(q.select(F.col("ear").alias("query_ear"), "query", "side"), "query_ear").join(c.select("ear", "candidate"), "ear")
            out = out.unionByName(of_pairs(pairs.select("query", "candidate", "side", "similarity")).select("query", "candidate", "score"))
    return out


def aligned_scores(queries: DataFrame, catalog: DataFrame, settings: Comparison = Comparison(), required: int = 2) -> DataFrame:
    """query, candidate, score: what `candidate_scores` gives of the `side_scores` of `block_similarities`, without a table of pairs.

    queries, catalog: as there, and query or candidate."""
    return _aligned_scores(queries, catalog, settings, _log_mean_exp, required, lambda p: candidate_scores(side_scores(p, ["query", "side", "candidate"], tau=settings.tau), ["query", "candidate"], required))


def aligned_best_scores(queries: DataFrame, catalog: DataFrame, settings: Comparison = Comparison()) -> DataFrame:
    """query, candidate, score: what `available_side_scores` gives of `block_similarities`, without a table of pairs.  queries, catalog: as there, and query or candidate."""
    return _aligned_scores(queries, catalog, settings, _best, 1, lambda p: available_side_scores(p, "query", "candidate", "side", "similarity"))


def shared_sides(uploads: DataFrame, pairs: DataFrame, weights: Column) -> DataFrame:
    """a, b, side, similarity, fault of pairs (a, b) of uploads: for each side that both show, the weighted Jaccard similarity of their first series of it; a pair that shares none has
    one row with a fault.

    uploads: upload, side, place, depths; the first series is that of the least place."""
    first = uploads.groupBy("upload", "side").agg(F.min_by("depths", "place").alias("d"))
    a = pairs.join(first.select(F.col("upload").alias("a"), "side", F.col("d").alias("x")), "a")
    met = a.join(first.select(F.col("upload").alias("b"), "side", F.col("d").alias("y")), ["b", "side"])
    compared = met.select("a", "b", "side", weighted_jaccard(F.col("x"), F.col("y"), weights).alias("similarity"))
    every = pairs.select("a", "b").join(compared, ["a", "b"], "left")
    return every.withColumn("fault", F.when(F.col("side").isNull(), F.lit("the uploads share no side")))


# ---- aggregation to candidates ----------------------------------------------------------------------------------------


def side_scores(similarities: DataFrame, keys: list[str], column: str = "similarity", tau: float = 0.05) -> DataFrame:
    """score: log-mean-exp of the similarities of each group of keys.  The largest one, taken out so that nothing overflows, comes from a window over the same
    keys, so that the similarities are computed and shuffled once."""
    top = similarities.select(*keys, column).withColumn("_top", F.max(column).over(Window.partitionBy(*keys)))
    return top.groupBy(*keys, "_top").agg(log_mean_exp(F.col(column), tau, F.col("_top")).alias("score")).drop("_top")


def candidate_scores(sides: DataFrame, keys: list[str], required: int = 2) -> DataFrame:
    """Mean over the sides; only candidates with `required` sides."""
    return sides.groupBy(*keys).agg(F.avg("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") >= required).drop("n")


def available_side_scores(pairs: DataFrame, query: str, candidate: str, side: str, score: str) -> DataFrame:
    """Best score of each side, then the mean of the sides that there are."""
    return pairs.groupBy(query, candidate, side).agg(F.max(score).alias("best")).groupBy(query, candidate).agg(F.avg("best").alias("score"))


def nearest(pairs: DataFrame, query: str, distance: str, tie: str, k: int) -> DataFrame:
    """The k nearest rows of each query, numbered from 1."""
    w = Window.partitionBy(query).orderBy(F.col(distance), F.col(tie))
    return pairs.withColumn("nn", F.row_number().over(w)).filter(F.col("nn") <= k)


def neighbour_votes(neighbours: DataFrame, query: str | list[str], candidate: str, distance: str, k: int = 2) -> DataFrame:
    """Margin votes: each candidate among the first k neighbours adds, once, its closest distance less the last neighbour's.  query: the query's column, and any that follow from it."""
    query = [query] if isinstance(query, str) else query
    w = Window.partitionBy(query[0])  # the neighbours are numbered by query, so that nothing moves
    last = neighbours.withColumns({"_last": F.max(distance).over(w), "_n": F.max("nn").over(w)})
    first = last.filter((F.col("nn") <= k) & (F.col("nn") < F.col("_n")))
    return first.groupBy(*query, candidate).agg((F.min(distance) - F.first("_last")).alias("vote"))


def vote_scores(votes: DataFrame, catalog: DataFrame, queries: DataFrame, query: str, candidate: str) -> DataFrame:
    """Negated sums of the votes; candidates of the catalog without votes score 0.  catalog and queries: distinct keys."""
    total = votes.groupBy(query, candidate).agg(F.sum("vote").alias("total"))
    spread = every_pair(queries, catalog, F.col(query), F.col(candidate))  # the result itself has a row for each query and candidate
    return spread.join(total, [query, candidate], "left").select(query, candidate, (F.lit(0.0) - F.coalesce("total", F.lit(0.0)) + F.lit(0.0)).alias("score"))


def ranked(scores: DataFrame, query: str, score: str = "score", name: str = "rank") -> DataFrame:
    """Competition rank of the candidates of each query, larger scores first."""
    return scores.withColumn(name, F.rank().over(Window.partitionBy(query).orderBy(F.col(score).desc())).cast("long"))


def top_n(scores: DataFrame, query: str, candidate: str, n: int = 12, score: str = "score") -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(candidate))
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def symmetric(pairs: DataFrame) -> DataFrame:
    """i, j, s in every direction of pairs (i, j, score) that have both: the mean of the two, which meet under their unordered pair in one shuffle."""
    both = pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("score").alias("s"), F.count("*").alias("n")).filter("n = 2")
    return both.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), "s").select("p.i", "p.j", "s")


def symmetrised_z(pairs: DataFrame) -> DataFrame:
    """i, j, z: scores averaged over both directions, then standardised within each row, then averaged over both directions."""
    w = Window.partitionBy("i")
    row = symmetric(pairs).withColumns({"m": F.avg("s").over(w), "sd": F.stddev_pop("s").over(w)})
    z = row.select("i", "j", F.when(F.col("sd") > 0, (F.col("s") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("score"))
    return symmetric(z).withColumnRenamed("s", "z")


def fused(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """Weighted mean of two similarity tables (i, j, s), each standardised over the whole table."""
    def standard(df, name):
        stats = df.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d"))
        return df.join(F.broadcast(stats)).select("i", "j", ((F.col("s") - F.col("m")) / F.col("d")).alias(name))  # one row of statistics

    return standard(a, "x").join(standard(b, "y"), ["i", "j"]).select("i", "j", (F.col("x") * weight + F.col("y") * (1 - weight)).alias("s"))


def fused_columns(pairs: DataFrame, x: Column, y: Column, weight: float) -> DataFrame:
    """i, j, s of pairs: the weighted mean of two numbers of each pair, each standardised over the whole table.  Nothing is shuffled but one row of statistics."""
    both = pairs.select("i", "j", x.alias("x"), y.alias("y"))
    stats = both.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.avg, "m"), (F.stddev_pop, "d"))])
    standard = lambda c: (F.col(c) - F.col(f"{c}m")) / F.col(f"{c}d")
    return both.crossJoin(F.broadcast(stats)).select("i", "j", (standard("x") * weight + standard("y") * (1 - weight)).alias("s"))


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def strength(score: Column, strong: Column, moderate: Column) -> Column:
    return F.when(score >= strong, "strong").when(score >= moderate, "moderate").otherwise("weak")
