"""Exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers.  For each block of candidates an index keeps, for each dimension, the block's rows in the order of
their quantised value, and where each value begins.  A posting segment is a dimension and a value; its impact on a query is the
product of the query's component and the value.  Segments are processed by descending impact, in narrow levels of impact, negative ones too.
After each level a row's score is at most what it has gathered plus, for each dimension in which it was not yet met, the impact of that
dimension's next segment.  The k-th best of some rows scored exactly is a proven threshold.  Rows whose bound is below it cannot be
among the k best; the search stops when it is cheaper to score all others exactly than to read the postings that are left.  Where that
never holds all segments are read, and what the rows have gathered are their scores.

A query set and the candidates meet block by block: each pair of a query block and a candidate block is one bounded task, whose index is
built once for its queries, and the tasks' k best are merged for each query in two steps.

Defined results.  Vectors that are null, or hold null or non-finite components, take no part.  Ties go to the smaller vec_id; a query with fewer
than k candidates gets them all.  Rows that repeat a vec_id are candidates each on its own, but no candidates of queries with that id.
Queries and candidates of different lengths share no score: a candidate counts the components that both have.  Empty tables give no rows.
A component whose floor is no long counts as the nearest long.  Where products could exceed what a double holds exactly, whole
numbers of any size are added up instead; a score that is no long is given as the nearest one, and the ranking is by the true one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import batch_of, one_array

#: Components of a candidate block, which bound its memory, and rows of a query block.
COMPONENTS = 1 << 22
QUERIES = 512
#: Shares of a query's largest possible impact that bound the levels; the last level has all that is left.
LEVELS = (0.3, 0.0, -0.04, -0.1, -0.2)
#: Rows scored exactly for the threshold, as multiples of k; postings that take as long to read as one component to score.
TRIED, WORTH = 4, 4
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("part", pa.int32())])
_LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, scale: int = 64, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and v, the floors of scale * x, without the vectors that take no part."""
    x = F.transform(F.col(column), lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    finite = F.forall(F.col(column), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & F.col(id_column).isNotNull()).filter(finite).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("v"))


def _matrix(table, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = one_array(table.column(prefix + "vec_id")).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = one_array(table.column(prefix + "v"))
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    width = int(size.max()) if size.size else 0
    out = np.zeros((len(ids), width), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), size)
    out[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return ids, out


class ImpactIndex:
    """The index of one block of candidates (ids and rows of integers)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")  # places ascend with ids, so a stable sort settles ties
        self.ids, self.rows = ids[order], rows[order]
        self.dims = self.rows.shape[1]
        columns = np.ascontiguousarray(self.rows.T)
        self.low, self.high = (int(columns.min()), int(columns.max())) if columns.size else (0, 0)
        narrow = columns.astype(np.int16) if -(1 << 15) <= self.low and self.high < 1 << 15 else columns  # sorted by digits
        self.postings = np.argsort(narrow, axis=1, kind="stable")
        self.sorted = np.take_along_axis(columns, self.postings, axis=1)
        self.values = self.sorted.astype(np.float64)
        self.exact = self.rows.astype(np.float64)
        #: Postings read and rows scored exactly so far.
        self.read = self.scored = 0

    def _from(self, d: int, q: int, above: int) -> int:
        """The place in postings[d], counted from the end that has the largest impacts, up to which impacts q * value are larger than `above`."""
        v = self.sorted[d]
        if q > 0:
            return len(v) - int(np.searchsorted(v, above // q, "right"))
        # q < 0: q * value > above  <=>  value < above / q
        return int(np.searchsorted(v, _ceil_div(above, q), "left"))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best rows that are not the query's own."""
        n = len(self.ids)
        query = query[: self.dims]
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        k = min(k, n - (own.stop - own.start))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if query.size and query.size * max(abs(self.low), abs(self.high)) * max(abs(int(query.min())), abs(int(query.max()))) >= 1 << 53:
            return self._best_of_any_size(query, own, k)
        used = np.flatnonzero(query)
        dims, q = used.tolist(), query.astype(np.float64)
        signed = dict(zip(dims, query[used].tolist()))
        done = dict.fromkeys(dims, 0)  # postings read of each dimension
        first = [signed[d] * int(self.sorted[d, -1 if signed[d] > 0 else 0]) for d in dims]
        top = max(map(abs, first), default=0)
        gathered = np.zeros(n)
        last = None
        for level in (*LEVELS, None):
            left = n * len(dims) - sum(done.values())
            above = None if level is None else int(np.floor(level * top))
            if above is not None and above == last:
                continue
            last = above
            places, gains = [], []
            for d in dims:
                upto = n if above is None else self._from(d, signed[d], above)
                a, done[d] = done[d], max(upto, done[d])
                if upto > a:
                    part = slice(n - upto, n - a) if signed[d] > 0 else slice(a, upto)
                    places.append(self.postings[d, part])
                    gains.append(self.values[d, part] * q[d])
            if places:
                places = np.concatenate(places)
                self.read += places.size
                left -= places.size
                gathered += np.bincount(places, np.concatenate(gains), n)
            if not left:
                break
            if level is not None and level > 0 and left > 0.8 * n * len(dims):
                continue  # far too little is read for any proof
            # the next impact of each dimension bounds what rows not met in it may still gain
            rest = {d: signed[d] * int(self.sorted[d, n - 1 - at if signed[d] > 0 else at]) for d, at in done.items() if at < n}
            bound = gathered + float(sum(rest.values()))
            met = [(self.postings[d, n - done[d] :] if signed[d] > 0 else self.postings[d, : done[d]], float(r)) for d, r in rest.items() if r and done[d]]
            if met:
                bound -= np.bincount(np.concatenate([at for at, _ in met]), np.repeat([r for _, r in met], [at.size for at, _ in met]), n)
            bound[own] = -np.inf
            some = min(TRIED * k, n - (own.stop - own.start))
            tried = np.argpartition(np.where(np.isneginf(bound), -np.inf, gathered), n - some)[n - some :]
            score = self.exact[tried, : q.size] @ q
            least = np.partition(score, some - k)[some - k]
            keep = np.flatnonzero(bound >= least)
            self.scored += some
            if keep.size * len(dims) * WORTH <= left:
                self.scored += keep.size
                return self._first(keep, self.exact[keep, : q.size] @ q, k)
        gathered[own] = -np.inf
        keep = np.argpartition(gathered, n - k)[n - k :]
        keep = np.flatnonzero(gathered >= gathered[keep].min())
        return self._first(keep, gathered[keep], k)

    def _first(self, keep: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((keep, -score))[:k]
        return self.ids[keep[order]], score[order].astype(np.int64)

    def _best_of_any_size(self, query: np.ndarray, own: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.rows[:, : query.size].astype(object) @ query.astype(object)
        order = sorted((i for i in range(len(self.ids)) if not own.start <= i < own.stop), key=lambda i: (-score[i], i))[:k]
        return self.ids[order], np.array([min(max(int(score[i]), _LONG.min), _LONG.max) for i in order], np.int64)


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, candidate_rows: int | None = None, query_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest integer inner products for each query.

    vectors, queries: vec_id and v (array<long>)."""
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, m = sizes["n"], queries.count()
    candidate_rows = candidate_rows or max(1, COMPONENTS // max(1, sizes["width"] or 1))
    v_blocks, q_blocks = max(1, -(-n // candidate_rows)), max(1, -(-m // query_rows))
    block = lambda c, of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int").alias(c)
    v = vectors.select("vec_id", "v", block("v_block", v_blocks), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    q = queries.select("vec_id", "v", block("q_block", q_blocks), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("v_block"))
    # other names: two sides of a cogroup that come from one table must not share columns
    v, q = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in ("vec_id", "v", "q_block", "v_block")]) for side, d in (("c", v), ("q", q)))

    def search(key, left, right):
        q_ids, q_rows = _matrix(left, "q_")
        ids, rows = _matrix(right, "c_")
        out = []
        if len(ids) and len(q_ids):
            index = ImpactIndex(ids, rows)
            for i, row in zip(q_ids.tolist(), q_rows):
                got, score = index.best(i, row, k)
                out.append((np.full(len(got), i), got, score))
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return batch_of(_OUT, a, b, c, np.full(len(a), key[1].as_py(), np.int32))

    found = q.groupBy("q_q_block", "q_v_block").cogroup(v.groupBy("c_q_block", "c_v_block")).applyInArrow(search, "query_id long, vec_id long, score long, part int")
    order = [F.col("score").desc(), F.col("vec_id")]
    if v_blocks > 64:  # merge in two steps, so that no query's rows grow with the candidates
        groups = F.pmod(F.col("part"), F.lit(int(v_blocks**0.5)))
        found = found.withColumn("part", groups).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("r") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_of_every(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """top_k with the rows whose vec_id is divisible by `every` as queries, against all rows."""
    v = quantised(vectors)
    return top_k(v, v.filter(F.col("vec_id") % every == 0), k)
