"""Exact comparison of vectors block by block: a pair of blocks is one bounded task, and partial results leave it reduced."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.retrieval import nearest

#: Pairs of blocks that a comparison is dealt into, and rows of a block that are not split further for it.
GROUPS, BLOCK_ROWS = 64, 2048
#: Components that a block holds and rows that a pair of blocks sends, both at most; pairs whose numbers are in memory at a time, and rows that are sent together where there is one for each pair.
BLOCK_VALUES, SENT_ROWS, TILE_PAIRS, BATCH_ROWS = 1 << 22, 1 << 22, 1 << 22, 1 << 16
#: Rows whose least number stands for them in a search for the nearest, and pairs whose vectors are gathered at a time.
STRIPE, EXACT_PAIRS = 64, 1 << 16
#: Queries, and rows, that such a search looks at together; and how many times TILE_PAIRS are passed to it.
QUERIES, STRIP_ROWS, TILES = 512, 1024, 16


def _most_rows(vectors: DataFrame, sent: int | None, copies: int) -> int:
    """Rows that a block of these vectors may have where a pair of blocks sends up to `sent` rows for each query (none given: they are sent as they come, and do not count)."""
    width = vectors.agg(F.max(F.size("e")).alias("w")).first()["w"] or 1
    most = BLOCK_VALUES // max(1, width * copies)
    return max(1, most if sent is None else min(most, max(math.isqrt(SENT_ROWS), SENT_ROWS // max(1, sent))))


def block_columns(table: pa.Table, prefix: str) -> dict:
    """The columns of a block by name, without the prefix, as numpy arrays; e as a matrix."""
    out = {}
    for name in table.column_names:
        column = table.column(name)
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
        if name == f"{prefix}e":
            width = np.unique(np.diff(column.offsets.to_numpy()))
            if column.null_count or width.size != 1:
                raise ValueError("vectors need one length")
            out["e"] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(width[0]))
        else:
            out[name.removeprefix(prefix)] = column.to_numpy(zero_copy_only=False)
    return out



def block_join(left: DataFrame, right: DataFrame, on: list[str], prepare: Callable, schema: pa.Schema, ddl: str, sent: int | None = None, copies: int = 1, deal: str = "id", expand: Callable | None = None, beside: DataFrame | None = None, rows_between: tuple[int, int] | None = None, mirrored: bool = False, tiles: int = 1) -> DataFrame:
    """prepare(r)(q) for each pair of blocks of left and right that agree on `on`; q, r: columns by name as numpy arrays, e as a matrix.  The right block is prepared once, and the rows of the
    left one are passed in parts, so that at most TILE_PAIRS pairs, or `tiles` times as many, are looked at together.

    left, right: id, e (array<double>) and any more.  There are about GROUPS pairs of blocks, so that a row is copied some sqrt(GROUPS) times however many rows there are, and more only where
    a block would be too large for a task: it has BLOCK_VALUES components at most (in `copies` versions) and, where each query sends up to `sent` rows, SENT_ROWS of them; where `sent` is not
    given, the rows of a part are sent before the next part is compared, so that blocks need not be small because there is a row for each pair.  Left rows with
    one value of `deal` are in one block.  A block's number among those that its other side meets is in the column _b of r; left rows take along what beside (id, block, more) has for them
    and the right block of that number, and those without go.  expand turns the columns of a block, before anything else looks at them, into those of the vectors that its rows stand for.

    rows_between, for comparisons that take long: the fewest rows of a block that is split no further, and the most; each pair of blocks is then in a partition of its own, or nearly so.  mirrored: both
    sides are the same rows, and of two pairs of blocks that differ in their order one is made; the columns _a and _b of r tell which blocks meet."""
    most = min(_most_rows(left, sent, copies), _most_rows(right, sent, copies))
    size = lambda df, name: df.groupBy(*on).agg(F.count("*").cast("double").alias(name))
    met = size(left, "_l").join(size(right, "_r"), on) if on else size(left, "_l").crossJoin(size(right, "_r"))
    pairs = met.agg(F.sum(F.col("_l") * F.col("_r")).alias("n")).first()["n"] or 0.0
    fewest, most = (BLOCK_ROWS, most) if rows_between is None else (rows_between[0], min(most, rows_between[1]))
    rows = max(1, min(most, max(fewest, math.ceil(math.sqrt(pairs / GROUPS)))))

    def side(df: DataFrame, prefix: str, first: bool) -> DataFrame:
        own, other = (n, m) if first else (m, n)
        dealt = df.join(own, on).join(other, on) if on else df.withColumns(own | other)
        names = ("_n", "_m") if first else ("_m", "_n")
        block = F.pmod(F.xxhash64(deal if first else "id"), F.col(names[0])).cast("int")
        spread = F.explode(F.sequence(block if mirrored and first else F.lit(0), block if mirrored and not first else F.col(names[1]) - 1))
        a, b = (block, spread) if first else (spread, block)
        return dealt.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns], a.alias(f"{prefix}_a"), b.alias(f"{prefix}_b"))

    def blocks(df: DataFrame, name: str):
        if not on:
            return {name: F.lit(max(1, -(-df.count() // rows)))}
        return df.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    n, m = blocks(left, "_n"), blocks(right, "_m")
    q, r = side(left, "q_", True), side(right, "r_", False)
    if beside is not None:
        q = q.join(beside.select(*[F.col(c).alias({"id": "q_id", "block": "q__b"}.get(c, f"q_{c}")) for c in beside.columns]), ["q_id", "q__b"])

    def compared(a: pa.Table, b: pa.Table) -> Iterator[pa.Table]:
        if not a.num_rows or not b.num_rows:
            return
        q, r = (block_columns(t, p) if expand is None else expand(block_columns(t, p)) for t, p in ((a, "q_"), (b, "r_")))
        if not len(q["id"]) or not len(r["id"]):
            return
        compare = prepare(r)
        if deal != "id":
            order = np.argsort(q[deal], kind="stable")
            q = {c: x[order] for c, x in q.items()}
        at, step = 0, max(1, tiles * TILE_PAIRS // len(r["id"]))
        while at < len(q["id"]):
            end = min(len(q["id"]), at + step)
            while deal != "id" and end < len(q["id"]) and q[deal][end] == q[deal][end - 1]:
                end += 1
            got = compare({c: x[at:end] for c, x in q.items()})
            yield pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(got, schema)], schema=schema)
            at = end

    keys = lambda p: [*(f"{p}{c}" for c in on), f"{p}_a", f"{p}_b"]
    if rows_between is not None:
        groups = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / rows**2))
        q, r = q.repartition(groups, *keys("q_")), r.repartition(groups, *keys("r_"))
    if sent is not None:
        run = lambda key, a, b: pa.concat_tables([schema.empty_table(), *compared(a, b)])
        return q.groupBy(*keys("q_")).cogroup(r.groupBy(*keys("r_"))).applyInArrow(run, ddl)

    # both sides as rows of one table: such a group may be sent as it is made
    lefts, rights = q.columns, r.columns
    key = {f"k{n}": pair for n, pair in enumerate(zip(keys("q_"), keys("r_")))}
    tagged = lambda df, first: df.select("*", F.lit(first).alias("k_left"), *[F.col(pair[0 if first else 1]).alias(k) for k, pair in key.items()])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b = (table.filter(mask).select(names) for mask, names in ((table["k_left"], lefts), (pc.invert(table["k_left"]), rights)))
        for part in compared(a, b):
            yield from part.to_batches(max_chunksize=BATCH_ROWS)

    return tagged(q, True).unionByName(tagged(r, False), allowMissingColumns=True).groupBy(*key).applyInArrow(stream, ddl)


def same(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all wanted[i] that equal keys[j]."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    lo, n = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, "right")
    n = n - lo
    return np.repeat(np.arange(len(wanted)), n), order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def least(s: np.ndarray, k: int, limit: Callable, value: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, value) of the k places j of each row i of s with the least value(i, j), ties to the smaller j; infinite numbers are no candidates.

    value is evaluated only where s is at most limit(k-th least number of each row), beyond which no value can be among the k least."""
    row, taken = np.arange(len(s)), []
    for _ in range(min(k, s.shape[1])):
        j = s.argmin(axis=1)
        taken.append((j, s[row, j]))
        s[row, j] = np.inf
    top = taken[-1][1].copy()
    for j, v in reversed(taken):
        s[row, j] = v
    i, j = np.nonzero((s <= limit(top)[:, None]) & (s < np.inf))
    v = value(i, j)
    order = np.lexsort((j, v, i))
    i, j, v = i[order], j[order], v[order]
    first = np.arange(i.size) - np.searchsorted(i, i) < k
    return i[first], j[first], v[first]


def candidate_scores(queries: DataFrame, catalog: DataFrame, tau: float = 0.05) -> DataFrame:
    """query, candidate, score: log-mean-exp of the inner products of each query (id, e) with the vectors (id, candidate, e) of each
    candidate, its own id held out.  A pair of blocks sends one row for each query and candidate."""
    schema = pa.schema([("query", pa.int64()), ("candidate", pa.string()), ("m", pa.float64()), ("s", pa.float64()), ("n", pa.int64())])

    def prepare(r):
        order = np.argsort(r["candidate"], kind="stable")
        names, first = np.unique(r["candidate"][order], return_index=True)
        ids, turned = r["id"][order], np.ascontiguousarray(r["e"][order].T)
        size = np.diff(np.append(first, len(order)))
        group = np.repeat(np.arange(len(names)), size)

        def compare(q):
            sims = q["e"] @ turned
            i, j = same(ids, q["id"])
            sims[i, j] = -np.inf
            count = np.tile(size, (len(sims), 1))
            np.subtract.at(count, (i, group[j]), 1)
            top = np.maximum.reduceat(sims, first, axis=1)
            sims -= np.repeat(np.where(count > 0, top, 0.0), size, axis=1)
            sims /= tau
            total = np.add.reduceat(np.exp(sims, out=sims), first, axis=1)
            i, j = np.nonzero(count)
            return q["id"][i], names[j], top[i, j], total[i, j], count[i, j]

        return compare

    catalog = catalog.withColumn("candidate", F.col("candidate").cast("string"))
    many = catalog.select("candidate").distinct().count()
    parts = block_join(queries.select("id", "e"), catalog.select("id", "candidate", "e"), [], prepare, schema, "query long, candidate string, m double, s double, n long", sent=many)
    best = F.max("m").over(Window.partitionBy("query", "candidate"))
    merged = parts.withColumn("top", best).groupBy("query", "candidate", "top").agg(F.sum(F.col("s") * F.exp((F.col("m") - F.col("top")) / tau)).alias("s"), F.sum("n").alias("n"))
    return merged.select("query", "candidate", (F.col("top") + tau * (F.log("s") - F.log(F.col("n").cast("double")))).alias("score"))


def _neighbours(e: np.ndarray, own: np.ndarray, k: int) -> Callable:
    """A function of queries (e, own): (i, j, distance) of the k nearest rows j of e with another `own`, distances to nine decimals, ties to the smaller j.

    A product of single precision, whose error is bounded, tells which rows can be among them, by the least number of each STRIPE of rows; only those are compared exactly."""
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    square, width, rows = dot(e, e), e.shape[1], -(-len(e) // STRIPE) * STRIPE
    longest = float(np.sqrt(square.max()))
    rough = np.zeros((rows, width + 1), np.float32)
    plain = longest < 1e15  # nothing overflows; not so where a number is not finite
    if plain:
        rough[: len(e), :width], rough[: len(e), width], rough[len(e) :, width] = -2 * e, square, np.inf
    stripes = rough.reshape(-1, STRIPE, width + 1)

    def part(q: np.ndarray, q_own: np.ndarray):
        mine = dot(q, q)  # summed in one way, so that equal vectors are 0 apart
        if not plain or not (mine < 1e30).all():
            s = square - q @ (2 * e.T)
            s[same(own, q_own)] = np.inf
            limit = lambda top: (np.sqrt(np.maximum(0.0, top + mine)) + 2e-9) ** 2 - mine + 1e-15 * (1 + mine)
            return least(s, k, limit, lambda i, j: np.round(np.sqrt(np.maximum(0.0, mine[i] + s[i, j])), 9))
        asked = np.column_stack([q, np.ones(len(q))]).astype(np.float32)
        turned, low = np.ascontiguousarray(asked.T), np.empty((len(stripes), len(q)), np.float32)
        mine_i, mine_j = same(own, q_own)
        order = np.argsort(mine_j, kind="stable")
        mine_i, mine_j = mine_i[order], mine_j[order]
        for at in range(0, rows, STRIP_ROWS):  # few rows at a time, so that their numbers stay in a core's cache
            s = rough[at : at + STRIP_ROWS] @ turned  # the squared distance less the query's own square
            lo, hi = np.searchsorted(mine_j, (at, at + STRIP_ROWS))
            s[mine_j[lo:hi] - at, mine_i[lo:hi]] = np.inf
            np.min(s.reshape(-1, STRIPE, len(q)), axis=1, out=low[at // STRIPE : (at + len(s)) // STRIPE])
        # k stripes have a row each that is not farther than this
        top = np.partition(low, k - 1, axis=0)[k - 1].astype(float) if len(low) >= k else np.full(len(q), np.inf)
        error = (width + 4) * 2.0**-23 * (2 * np.sqrt(mine) * longest + longest**2) + 1e-30
        most = (np.sqrt(np.maximum(0.0, top + error + mine)) + 2e-9) ** 2 - mine + error + 1e-15 * (1 + mine)
        most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
        stripe, i = np.nonzero((low <= most) & (low < np.inf))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(i), EXACT_PAIRS // STRIPE):
            x, y = i[a : a + EXACT_PAIRS // STRIPE], stripe[a : a + EXACT_PAIRS // STRIPE]
            near = np.matmul(stripes[y], asked[x][:, :, None])[..., 0]
            at, place = np.nonzero((near <= most[x][:, None]) & (near < np.inf))
            found.append((x[at], y[at] * STRIPE + place))
        i, j = (np.concatenate(x) for x in zip(*found))
        other = own[j] != q_own[i]
        i, j = i[other], j[other]
        v = np.empty(len(i))
        for a in range(0, len(i), EXACT_PAIRS):
            x, y = i[a : a + EXACT_PAIRS], j[a : a + EXACT_PAIRS]
            v[a : a + EXACT_PAIRS] = np.round(np.sqrt(np.maximum(0.0, mine[x] + square[y] - 2 * dot(q[x], e[y]))), 9)
        order = np.lexsort((j, v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.arange(i.size) - np.searchsorted(i, i) < k
        return i[first], j[first], v[first]

    def of(q: np.ndarray, q_own: np.ndarray):
        step = min(QUERIES, len(q)) if plain else max(1, TILE_PAIRS // len(e))
        out = [(a, part(q[a : a + step], q_own[a : a + step])) for a in range(0, len(q), step)]
        return tuple(np.concatenate(x) for x in zip(*((i + a, j, v) for a, (i, j, v) in out)))

    return of


def nearest_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """query, other, distance, nn: the exact k nearest other vectors of each one (id, e) by Euclidean distance, ties to the smaller id."""
    schema = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])

    def prepare(r):
        order = np.argsort(r["id"], kind="stable")
        ids = r["id"][order]
        near = _neighbours(r["e"][order], ids, k)

        def compare(q):
            i, j, d = near(q["e"], q["id"])
            return q["id"][i], ids[j], d

        return compare

    v = vectors.select("id", "e")
    return nearest(block_join(v, v, [], prepare, schema, "query long, other long, distance double", sent=k, tiles=TILES), "query", "distance", "other", k)


def nearest_between(queries: DataFrame, catalog: DataFrame, on: list[str], k: int, expand: Callable | None = None, many: int = 1, copies: int = 1) -> DataFrame:
    """query, sighting, other, candidate, distance, nn: for each vector of queries (id, sighting, e and the columns `on`) the exact k nearest ones of catalog (id, sighting,
    candidate, e, on) that agree on `on` and are of another sighting; ties go to the smaller id.  A pair of blocks sends one row for each query, with k neighbours at most.

    Rows may stand for up to `many` vectors each, of `copies` times the components of e, which expand makes of a block's columns (see `block_join`), so that what the vectors have in common
    is sent once; query and other are then the ids that it gives."""
    found = pa.list_(pa.struct([("distance", pa.float64()), ("other", pa.int64()), ("candidate", pa.string())]))
    schema = pa.schema([("query", pa.int64()), ("sighting", pa.string()), ("near", found)])

    def prepare(r):
        order = np.argsort(r["id"], kind="stable")
        ids, names = r["id"][order], r["candidate"][order]
        near = _neighbours(r["e"][order], r["sighting"][order].astype(str), k)

        def compare(q):
            i, j, d = near(q["e"], q["sighting"].astype(str))
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if i.size else i
            rows = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(ids[j], pa.int64()), pa.array(names[j], pa.string())], fields=list(found.value_type))
            return q["id"][i[first]], q["sighting"][i[first]], pa.ListArray.from_arrays(pa.array(np.append(first, i.size), pa.int32()), rows, type=found)

        return compare

    text = lambda df, *names: df.withColumns({c: F.col(c).cast("string") for c in names})
    rest = [] if expand is None else [c for c in queries.columns if c not in ("id", "sighting", "candidate", "e", *on)]
    q = text(queries, "sighting").select("id", "sighting", "e", *on, *rest)
    c = text(catalog, "sighting", "candidate").select("id", "sighting", "candidate", "e", *on, *rest)
    ddl = "query long, sighting string, near array<struct<distance: double, other: bigint, candidate: string>>"
    parts = block_join(q, c, on, prepare, schema, ddl, sent=k * many, copies=copies, expand=expand, tiles=TILES).repartition("query")
    return nearest(parts.select("query", "sighting", F.explode("near").alias("n")).select("query", "sighting", "n.*"), "query", "distance", "other", k)


def best_correlations(series: DataFrame, window: int, trim: int) -> DataFrame:
    """id, other, corr, lag: of each series (id, e, all of one length) the other one with the largest Pearson correlation with it, without `trim` values at either end, of the other turned by
    -window to window places.  Ties go to the smaller other, then the smaller lag.  Series that do not vary there have none.

    A pair of blocks is a product of matrices for each lag, and sends the best other of each row alone."""
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("corr", pa.float64()), ("lag", pa.int32())])

    def unit(x: np.ndarray) -> np.ndarray:
        d = x - x.mean(axis=1, keepdims=True)
        size = np.sqrt((d * d).sum(axis=1, keepdims=True))
        return np.where(size > 1e-12 * np.sqrt(x.shape[1]), d / np.where(size > 0, size, 1.0), np.nan)

    def prepare(r):
        n = r["e"].shape[1]
        order = np.argsort(r["id"], kind="stable")
        ids, e = r["id"][order], r["e"][order]
        turned = []
        for shift in range(-window, window + 1):
            u = unit(np.roll(e, -shift, axis=1)[:, trim : n - trim]) if n > 2 * trim + 1 else e
            flat = np.flatnonzero(np.isnan(u).any(axis=1))
            u[flat] = 0.0
            turned.append((shift, np.ascontiguousarray(-u.T), flat))

        def compare(q):
            if q["e"].shape[1] != n or n <= 2 * trim + 1:
                raise ValueError("series need one length, of more than twice the trim")
            a = unit(q["e"][:, trim : n - trim])
            varies = np.flatnonzero(~np.isnan(a).any(axis=1))
            a, mine = a[varies], q["id"][varies]
            own = same(ids, mine)
            best, at, lag = np.full(len(mine), -np.inf), np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int32)
            for shift, u, flat in turned if len(mine) else ():
                c = a @ u
                c[own] = np.inf
                c[:, flat] = np.inf
                i, j, v = least(c, 1, lambda top: top + 2e-9, lambda i, j: np.round(c[i, j], 9))
                better = (-v > best[i]) | ((-v == best[i]) & (ids[j] < ids[at[i]]))
                i, j, v = i[better], j[better], v[better]
                best[i], at[i], lag[i] = -v, j, shift
            ok = np.isfinite(best)
            return mine[ok], ids[at[ok]], best[ok] + 0.0, lag[ok]

        return compare

    v = series.select("id", "e")
    parts = block_join(v, v, [], prepare, schema, "id long, other long, corr double, lag int", sent=1, copies=(2 * window + 2) // 3)
    return parts.groupBy("id").agg(F.min_by(F.struct("other", "corr", "lag"), F.struct(-F.col("corr"), "other", "lag")).alias("b")).select("id", "b.*")


def pair_scores(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """i, j, score: inner products of all pairs of different ids of left and right (id, e and the columns `on`) that agree on `on`."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("score", pa.float64())])

    def prepare(r):
        turned = r["e"].T

        def compare(q):
            s = q["e"] @ turned
            i, j = np.nonzero(q["id"][:, None] != r["id"][None, :])
            return q["id"][i], r["id"][j], s[i, j]

        return compare

    return block_join(left.select("id", "e", *on), right.select("id", "e", *on), on, prepare, schema, "i long, j long, score double")
