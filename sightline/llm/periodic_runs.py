"""Periodic runs of words by recompression.

The words of many documents form one sequence, each document closed by a symbol of its own.  Two steps alternate until every document is one
symbol: a block step replaces every maximal block of one symbol by a symbol for (symbol, length), a pair step deals the symbols into two sides
and replaces every pair that goes from one side to the other.  Both decide by the symbols themselves, so that equal stretches are parsed
alike.  The levels kept are a run-length grammar: a query for the longest common extension of two positions climbs while both stand at the
edges of their parents, and goes down again from the first difference.

A run of period p and length 2p or more holds two neighbouring points of a grid of step p, and their words are equal.  So the candidates are the
pairs (i, i + p) of the grids of all periods, which is n log n of them; two grammar queries, forwards and backwards, give the run exactly, and
of candidates with the same ends the least period is the run's.

Everything happens within documents, so nothing is shuffled; a task takes documents in groups of GROUP_WORDS words, and candidates in blocks.

Defined results.  A null or empty text has no words and no runs.  A text of any length is read whole; one longer than a group is a group of its
own.  Rows are independent of each other, so that repeated rows and repeated or null doc_ids change nothing.  An empty table gives no rows.  Only
doc_id and the text column are read, so that other columns may have any names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import forget_model, one_array

#: Words of the documents that are parsed together.
GROUP_WORDS = 1 << 19
#: Candidates that are extended together.
BLOCK = 1 << 19
#: The least length of a run.
MIN_LENGTH = 12
#: Odd factors that spread symbols over the two sides of a pair step.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Level:
    """A sequence of symbols, the place of each one's parent in the next sequence, and the first child of each parent (and one place beyond)."""

    def __init__(self, symbols: np.ndarray, blocks: bool, starts: np.ndarray):
        self.symbols, self.blocks = symbols, blocks
        self.up = (np.cumsum(starts, dtype=np.int32) - 1).astype(np.int32)
        self.first = np.append(np.flatnonzero(starts), symbols.size).astype(np.int32)


def _named(keys: np.ndarray, names: int) -> tuple[np.ndarray, int]:
    """One new symbol for each distinct key, from `names` on."""
    distinct, place = np.unique(keys, return_inverse=True)
    return (names + place).astype(np.int32), names + distinct.size


def _block_step(symbols: np.ndarray, names: int):
    starts = np.append(True, symbols[1:] != symbols[:-1])
    if starts.all():
        return None, symbols, names
    level = Level(symbols, True, starts)
    out, size = symbols[starts], np.diff(level.first)
    many = size > 1
    out[many], names = _named((out[many].astype(np.int64) << 32) | size[many], names)
    return level, out, names


def _pair_step(symbols: np.ndarray, names: int, closing: tuple[int, int], turn: int):
    """Pairs from the right-hand side to the left-hand one, or the other way round, whichever are more."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn << 32)) * _MIX[0]
    side = ((mixed ^ (mixed >> np.uint64(29))) * _MIX[1]).astype(np.int64) < 0
    inner = (symbols < closing[0]) | (symbols >= closing[1])
    both = inner[:-1] & inner[1:]
    ways = [both & side[:-1] & ~side[1:], both & ~side[:-1] & side[1:]]
    pair = max(ways, key=np.count_nonzero)
    starts = np.append(True, ~pair)
    level = Level(symbols, False, starts)
    out = symbols[starts]
    at = np.flatnonzero(pair)
    out[level.up[at]], names = _named((symbols[at].astype(np.int64) << 32) | symbols[at + 1], names)
    return level, out, names


class Grammar:
    """The run-length grammar of documents: `words` holds closing symbols, distinct and from closing[0] to closing[1], at its front and behind each."""

    def __init__(self, words: np.ndarray, closing: tuple[int, int]):
        self.levels: list[Level] = []
        symbols, names, turn = words.astype(np.int32), closing[1], 0
        least = 2 * (closing[1] - closing[0]) - 1
        while symbols.size > least:
            level, symbols, names = _block_step(symbols, names)
            if level is not None:
                self.levels.append(level)
            if symbols.size > least:
                level, symbols, names = _pair_step(symbols, names, closing, turn)
                self.levels.append(level)
            turn += 1

    def extensions(self, i: np.ndarray, j: np.ndarray, forwards: bool) -> np.ndarray:
        """How many words from i on (forwards) or from i back equal those from j; i < j, both in one document or at its ends."""
        a, b = i.astype(np.int32), j.astype(np.int32)
        waiting: list[np.ndarray] = []
        live = np.arange(a.size)
        step = 1 if forwards else -1
        for level in self.levels:  # up, as long as the stretches agree
            if not live.size:
                break
            x, y = a[live], b[live]
            ux, uy = level.up[x], level.up[y]
            edge_x, edge_y = (level.first[ux], level.first[uy]) if forwards else (level.first[ux + 1] - 1, level.first[uy + 1] - 1)
            goes = (x == edge_x) & (y == edge_y)
            here = np.flatnonzero(~goes)
            if here.size:
                hx, hy = x[here], y[here]
                same = level.symbols[hx] == level.symbols[hy]
                if level.blocks:
                    left_x, left_y = (level.first[ux[here] + 1] - hx, level.first[uy[here] + 1] - hy) if forwards else (hx - level.first[ux[here]] + 1, hy - level.first[uy[here]] + 1)
                    by, on = np.minimum(left_x, left_y), same & (left_x == left_y)
                else:
                    by, on = np.int32(1), same
                x[here] = hx + step * np.where(same, by, np.int32(0))
                y[here] = hy + step * np.where(same, by, np.int32(0))
                goes[here] = on
                a[live], b[live] = x, y
            waiting.append(live[~goes])
            live = live[goes]
            a[live], b[live] = level.up[x[goes]], level.up[y[goes]]
        moving = live
        for h in range(len(waiting) - 1, -1, -1):  # down to the first words that differ
            level = self.levels[h]
            if moving.size:
                ux, uy = a[moving], b[moving]
                x, y = (level.first[ux], level.first[uy]) if forwards else (level.first[ux + 1] - 1, level.first[uy + 1] - 1)
                same = level.symbols[x] == level.symbols[y]
                by = np.minimum(level.first[ux + 1] - level.first[ux], level.first[uy + 1] - level.first[uy]) if level.blocks else np.int32(1)
                by = step * np.where(same, by, np.int32(0))
                a[moving], b[moving] = x + by, y + by
            moving = np.concatenate([moving, waiting[h]])
        return (a.astype(np.int64) - i) * step


def _grids(first: np.ndarray, n: np.ndarray, min_length: int):
    """(i, p) of all candidates, in blocks: for each document and period, points of the grid.  Runs of short periods are min_length long, so that their grids are wider."""
    periods = n // 2
    edges = np.cumsum(np.append(0, periods))
    at = 0
    while at < edges[-1]:
        upto = min(int(edges[-1]), at + BLOCK // 4)
        flat = np.arange(at, upto)
        doc = np.searchsorted(edges, flat, "right") - 1
        p = flat - edges[doc] + 1
        step = np.maximum(p, min_length - p)
        points = (n[doc] - p - 1) // step + 1  # i = 0, step, ... as long as i + p is a word
        done = np.cumsum(points)
        take = max(1, int(np.searchsorted(done, BLOCK, "right")))
        doc, p, step, points = doc[:take], p[:take], step[:take], points[:take]
        which = np.repeat(np.arange(take), points)
        nth = np.arange(which.size) - np.repeat(np.cumsum(points) - points, points)
        yield first[doc][which] + nth * step[which], p[which]
        at += take


def runs_of(words: np.ndarray, n: np.ndarray, vocabulary: int, min_length: int = MIN_LENGTH):
    """(document, start, length, period) of all runs, in that order.  words: those of all documents in a row, below `vocabulary`; n: words of each document."""
    long = np.flatnonzero(n >= min_length)
    if not long.size:
        return (np.zeros(0, np.int64),) * 4
    at = np.cumsum(n) - n
    n = n[long]
    first = np.cumsum(n + 1) - n  # places of the documents' first words among the symbols
    symbols = np.empty(int(n.sum()) + n.size + 1, np.int32)
    symbols[0] = vocabulary
    symbols[first + n] = vocabulary + 1 + np.arange(n.size)
    inside = np.ones(symbols.size, bool)
    inside[0] = inside[first + n] = False
    symbols[inside] = words if long.size == at.size else words[np.repeat(at[long] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    grammar = Grammar(symbols, (vocabulary, vocabulary + 1 + n.size))
    ends, periods = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, p in _grids(first, n, min_length):
        equal = np.flatnonzero(symbols[i] == symbols[i + p])
        i, p = i[equal], p[equal]
        start = i - grammar.extensions(i - 1, i + p - 1, False)
        end = i + p + grammar.extensions(i, i + p, True)
        good = end - start >= np.maximum(min_length, 2 * p)
        both, periods = np.append(ends, (start[good] << 32) | end[good]), np.append(periods, p[good])
        ends, kept = np.unique(both, return_index=True)  # the earliest of equal ones, which has the least period
        periods = periods[kept]
    start, end = ends >> 32, ends & 0xFFFFFFFF
    order = np.lexsort((periods, start))
    start, end, periods = start[order], end[order], periods[order]
    doc = np.searchsorted(first, start, "right") - 1
    return long[doc], start - first[doc], end - start, periods


def _collapsed(texts: list[list[bytes]], n: np.ndarray, doc, start, length, period) -> list[bytes]:
    """The words of each document but those that repeat a run's first period, joined by one space."""
    at = np.cumsum(n) - n
    depth = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(depth, at[doc] + start + period, 1)
    np.add.at(depth, at[doc] + start + length, -1)
    keep = np.cumsum(depth) == 0
    cut = set(doc.tolist())
    return [b" ".join(compress(words, keep[a : a + len(words)].tolist()) if d in cut else words) for d, (words, a) in enumerate(zip(texts, at.tolist()))]


def _group(ids: pa.Array, texts: list[list[bytes]], min_length: int) -> pa.RecordBatch:
    n = np.array([len(words) for words in texts], np.int64)
    coded = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    doc, start, length, period = runs_of(coded.indices.to_numpy(), n, len(coded.dictionary), min_length)
    offsets = np.searchsorted(doc, np.arange(n.size + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
    collapsed = pa.array(_collapsed(texts, n, doc, start, length, period), pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.array(n), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed (the text without the repetitions of runs) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        forget_model()
        for batch in batches:
            ids, first, held, texts = one_array(batch.column(0)), 0, 0, []
            for at, value in enumerate(one_array(batch.column(1))):
                words = value.as_buffer().to_pybytes().split()
                if texts and held + len(words) > GROUP_WORDS:
                    yield _group(ids.slice(first, len(texts)), texts, min_length)
                    first, held, texts = at, 0, []
                texts.append(words)
                held += len(words)
            if texts:
                yield _group(ids.slice(first, len(texts)), texts, min_length)

    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def with_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id and text), where a tenth of the texts, chosen by their doc_id, repeat a stretch to their end.  A null doc_id is never chosen."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    planned = chosen.select("*", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    return planned.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def _longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start and period; null where there is none."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def run_digests(found: DataFrame) -> DataFrame:
    """The query's columns of what `periodic_runs` found."""
    best = F.col("best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", _longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
