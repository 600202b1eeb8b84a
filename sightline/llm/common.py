"""What the corpus operators share: chunks of documents, packed arrays and the shared folder.

Several operators exchange data between *chunks* (bounded groups of documents, dealt by a hash of the row) and
*owners* (ranges of a key).  A chunk packs all that it has for one owner into one blob, and a task merges the blobs of its chunks
into one row for each owner, so that a shuffle moves a few large rows, as many as tasks times owners, and a key that very many
documents share reaches its owner once for each chunk, not once for each document.  Owners are much larger than chunks, so
that their number grows with the input far more slowly.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one chunk aims at.
CHUNK_BYTES = 8 << 20
#: Bytes of text behind one owner of a key range, and the owners that small inputs get, so that they work side by side.
OWNER_BYTES, LEAST_OWNERS = 64 << 20, 64
#: Packed rows that a task gathers before it merges those for one owner.
MERGE_BYTES = 8 << 20
#: The largest groups that a join takes out of its shuffle.
HOT_GROUPS = 1024
#: Stands for a null doc_id inside the operators: larger than every other one.
NULL_ID = np.iinfo(np.int64).max
#: What a worker keeps between tasks: one model at a time, and none when it turns to chunks of documents.
_MODEL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.  Where the session names none, one is made on a local master and refused on any other."""
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not set_one and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(set_one or tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return set_one or current


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_model(key: str, build: Callable):
    """The model that a worker keeps, built when it has another one.  key: names all that the model depends on."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = build()
    return _MODEL[key]


def forget_model() -> None:
    """For workers that turn to other work: drops the model and gives free memory back, which idle workers would keep."""
    _MODEL.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_bucket(column, modulus: int):
    """crc32 of the column's text form, modulo."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def chunked(docs: DataFrame, text: str = "text", carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """(chunk int, doc_id long, text binary, and `carry` as struct `rest`), the number of chunks and the bytes of text.

    A null text counts as empty.  The total is one cheap aggregate over the table.  Chunks hash doc_id and text, so that rows that share a
    doc_id, or have none, are spread."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    cols = [
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col(text).cast("binary")), F.lit(n)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"),
    ]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"))
    return docs.select(*cols), n, int(total)


def owners_for(total: int, chunks: int, owner_bytes: int = OWNER_BYTES) -> int:
    """Number of owners for `total` bytes of text in `chunks` chunks."""
    return max(1, -(-total // owner_bytes), min(chunks, LEAST_OWNERS))


def merged(wire: DataFrame, key: str = "key") -> DataFrame:
    """Rows key, parts: each task's rows with one key as a list, in the order of the rows (more than one list only beyond MERGE_BYTES)."""
    rest = [c for c in wire.columns if c != key]

    def flush(batches):
        rows = pa.Table.from_batches(batches)
        keys = rows.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")
        rows, keys = rows.take(pa.array(order)), keys[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        parts = pa.StructArray.from_arrays([one_array(rows.column(c)) for c in rest], rest)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge, keys.size), pa.int32()), parts)
        return pa.RecordBatch.from_arrays([pa.array(keys[edge], pa.int64()), lists], ["key", "parts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > MERGE_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in wire.schema if f.name != key)
    return wire.mapInArrow(run, f"key long, parts array<struct<{fields}>>")


def parts_of(table: pa.Table) -> Callable[[str], pa.Array]:
    """The columns of the merged rows of a group."""
    flat = one_array(table.column("parts")).flatten()
    return lambda name: flat.field(name)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread) -> DataFrame:
    """rows with the columns of groups (one row for each key at most; null where there is none).

    The HOT_GROUPS largest groups by the column `size` are broadcast, and their rows are dealt out by `spread` (a column that differs from row to row):
    no key of those that meet in one task holds more than a HOT_GROUPS-th part of the rows."""
    names = [c for c in groups.columns if c != key]
    value = F.struct(*names)
    hot = groups.orderBy(F.col(size).desc(), key).limit(HOT_GROUPS).select(F.col(key).alias("_hot_key"), value.alias("_hot"))
    cold = groups.select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), value.alias("_cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    found = found.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")))
    found = found.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    both = F.coalesce("_hot", "_cold")
    return found.select(*rows.columns, *[both[c].alias(c) for c in names])


def one_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column in one array, and n + 1 offsets."""
    a = one_array(column)
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    wide = pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


class Chunk:
    """The documents of a chunk in an order that does not depend on how Spark delivered them: by doc_id, then text."""

    def __init__(self, rows: pa.Table):
        forget_model()
        ids = one_array(rows.column("doc_id"))
        self.ids = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        order = np.argsort(self.ids, kind="stable")
        if len(ids) and (np.diff(self.ids[order]) == 0).any():
            texts = one_array(rows.column("text")).to_pylist()
            order = np.array(sorted(range(len(texts)), key=lambda i: (self.ids[i], texts[i])), np.int64)
        self.rows = rows.take(pa.array(order))
        self.ids = self.ids[order]
        self.data, self.offsets = raw_bytes(self.rows.column("text"))

    def __len__(self) -> int:
        return len(self.ids)

    def texts(self):
        """Each text as bytes."""
        flat = self.data.tobytes()
        at = self.offsets.tolist()
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def doc_id_column(self) -> pa.Array:
        return one_array(self.rows.column("doc_id")).cast(pa.int64())


def pack(*arrays) -> bytes:
    """Numpy arrays and bytes in one bytes object."""
    parts = []
    for a in arrays:
        a = np.frombuffer(a, np.uint8) if isinstance(a, (bytes, bytearray)) else np.ascontiguousarray(a)
        parts += [np.array([ord(a.dtype.char), a.size], np.int64).tobytes(), a.tobytes()]
    return b"".join(parts)


def unpack(blob) -> list[np.ndarray]:
    out, at, blob = [], 0, bytes(blob)
    while at < len(blob):
        kind, n = np.frombuffer(blob, np.int64, 2, at)
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(blob, dtype, int(n), at + 16))
        at += 16 + int(n) * dtype.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest unsigned type, or as signed 64-bit ones where any is negative."""
    if a.size and a.dtype.kind == "i" and int(a.min()) < 0:
        return a.astype(np.int64)
    top = int(a.max()) if a.size else 0
    for t in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(t).max:
            return a.astype(t)
    return a.astype(np.uint64)


def counts_packed(c: np.ndarray) -> bytes:
    """Mostly small counts: bytes, and the large ones apart."""
    big = np.flatnonzero(c >= 255)
    return pack(np.minimum(c, 255).astype(np.uint8), small(big), small(c[big]))


def counts_unpacked(blob) -> np.ndarray:
    low, at, big = unpack(blob)
    out = low.astype(np.int64)
    out[at.astype(np.int64)] = big.astype(np.int64)
    return out


def squeezed(a: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    a = small(a)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.dtype.itemsize).T).tobytes() if a.size else b""
    return pack(np.array([a.dtype.itemsize, a.size], np.int64), pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def expanded(blob) -> np.ndarray:
    head, data = unpack(blob)
    width, n = int(head[0]), int(head[1])
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data.tobytes(), width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64)


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as Golomb-Rice coded differences: all quotients in unary, then all remainders."""
    v = np.asarray(values, np.uint64)
    if not v.size:
        return pack(np.zeros(4, np.uint64), b"", b"")
    gaps = np.diff(v, prepend=v[0])
    mean = max(1.0, float(v[-1] - v[0]) / v.size)
    b = max(0, int(np.floor(np.log2(mean * 0.6931 + 1e-9)))) if mean > 1.5 else 0
    q = (gaps >> np.uint64(b)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    r = (gaps & np.uint64((1 << b) - 1)).astype(">u8")
    low = np.unpackbits(r.view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - b :] if b else np.zeros((0, 0), np.uint8)
    return pack(np.array([v.size, b, unary.size, v[0]], np.uint64), np.packbits(unary), np.packbits(low))


def golomb_decode(blob) -> np.ndarray:
    head, unary, low = unpack(blob)
    n, b, bits, first = (int(x) for x in head)
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(unary, count=bits))
    q = np.diff(ends, prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(b)
    if b:
        full = np.zeros((n, 64), np.uint8)
        full[:, 64 - b :] = np.unpackbits(low, count=n * b).reshape(n, b)
        gaps |= np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(first)


def owner_of(h: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Range partition of `bits`-bit fingerprints."""
    return ((h.astype(np.float64) / 2.0**bits) * owners).astype(np.int64).clip(0, owners - 1)


def batch_of(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
