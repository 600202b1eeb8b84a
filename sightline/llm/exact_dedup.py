"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each chunk of documents sends the owners of fingerprint ranges its sorted fingerprints, Golomb-Rice coded.
2. Each owner answers each chunk with a bitmap: which of the fingerprints that it sent occur more than once.
3. Only the suspects' normalised texts are shuffled; grouping by the bytes themselves verifies them, with one row for each
   distinct text and map task, so that a text with very many copies is summed up before it moves.  The largest groups are
   broadcast when the rows are told their group.

Defined results.  A null text counts as empty; all empty texts are equal.  A null doc_id is the largest one.  Rows that repeat
a doc_id and the text are copies of each other and share keep_id; exactly one row of a group is kept, whatever repeats.  An empty table
gives no rows.  A text of any length is one value, up to the 2 GB of a Spark row.  Only doc_id and the text column are read, so that
other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import NULL_ID, Chunk, batch_of, chunked, golomb_decode, golomb_encode, join_groups, merged, one_array, owner_of, owners_for, parts_of

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
_SENT = pa.schema([("owner", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int32()), ("owner", pa.int32()), ("bits", pa.binary())])
_JUDGED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_points", pa.int64()), ("text_sha256", pa.string()), ("suspect", pa.bool_()), ("normal", pa.binary())])


def _fingerprints(chunk: Chunk, bits: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    normal = [t.translate(None, WHITE) for t in chunk.texts()]
    digests = [hashlib.sha256(t).digest() for t in normal]
    heads = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
    return normal, digests, heads >> np.uint64(64 - bits)


def _by_owner(prints: np.ndarray, bits: int, owners: int):
    """(owner, positions of its fingerprints in sorted order) for each owner with any."""
    order = np.argsort(prints, kind="stable")
    whose = owner_of(prints[order], bits, owners)
    edges = np.flatnonzero(np.diff(whose, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(whose[a]), order[a:b]


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    rows, n, total = chunked(docs, text)
    bits = min(64, max(24, total.bit_length() + 12))
    owned = owners_for(total, n)

    def send(key, table):
        chunk = Chunk(table)
        _, _, prints = _fingerprints(chunk, bits)
        owners, blobs = [], []
        for owner, at in _by_owner(prints, bits, owned):
            owners.append(owner)
            blobs.append(golomb_encode(prints[at]))
        return batch_of(_SENT, owners, [key[0].as_py()] * len(owners), blobs)

    def answer(key, table):
        column = parts_of(table)
        parts = [golomb_decode(b.as_buffer()) for b in column("blob")]
        _, back, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        edges = np.cumsum([0, *(p.size for p in parts)])
        bitmaps = [np.packbits(twice[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return batch_of(_ANSWER, column("chunk"), [key[0].as_py()] * len(parts), bitmaps)

    def judge(key, table, answers):
        chunk = Chunk(table)
        normal, digests, prints = _fingerprints(chunk, bits)
        bitmap = dict(zip(answers.column("owner").to_pylist(), one_array(answers.column("bits"))))
        suspect = np.zeros(len(chunk), bool)
        for owner, at in _by_owner(prints, bits, owned):
            suspect[at] = np.unpackbits(np.frombuffer(bitmap[owner].as_buffer(), np.uint8), count=len(at)).astype(bool)
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        row = (np.int64(key[0].as_py()) << np.int64(32)) + np.arange(len(chunk))  # the order in a chunk does not depend on delivery
        return batch_of(
            _JUDGED, chunk.doc_id_column(), row, points[chunk.offsets[1:]] - points[chunk.offsets[:-1]], [d.hex() for d in digests], suspect, [t if s else None for t, s in zip(normal, suspect.tolist())]
        )

    sent = merged(rows.groupBy("chunk").applyInArrow(send, "owner int, chunk int, blob binary"), "owner")
    answers = sent.groupBy("key").applyInArrow(answer, "chunk int, owner int, bits binary")
    judged = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, "doc_id long, row long, n_points long, text_sha256 string, suspect boolean, normal binary")
    best = F.max(F.struct(F.col("n_points"), -F.coalesce("doc_id", F.lit(NULL_ID)), -F.col("row")))
    groups = judged.filter("suspect").groupBy("text_sha256", "normal").agg(best.alias("best"), F.count("*").alias("n")).select("text_sha256", "best", "n")
    out = join_groups(judged.select("doc_id", "row", "text_sha256"), groups, "text_sha256", "n", F.col("row"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.nullif(-F.col("best.col2"), F.lit(NULL_ID)))
    kept = F.col("n").isNull() | (F.col("best.col3") == -F.col("row"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")
