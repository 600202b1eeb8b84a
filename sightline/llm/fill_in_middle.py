"""Fill-in-the-middle texts by a sparse index of multibyte characters.

A cut is a number of code points; the text is UTF-8 bytes.  The index of a batch of texts records only its multibyte characters: the position of
each in bytes and the bytes that it has beyond one.  Between two of them, code points and bytes advance alike, so a cut is translated by one binary search
(code points to bytes, or back) and a sum; texts of ASCII need no entry at all.  All cuts of a batch are translated together, and the pieces are
put together as slices of bytes.

Where the cuts fall and which form a text takes depends on hashes of the seed and doc_id alone, so that it repeats.  A form joins pieces with
markers (`<P>` prefix, `<S>` suffix, `<M>` middle): psm is prefix, suffix, middle; spm is suffix, prefix, middle; plain is the text itself.  A text
that holds a marker, or is empty, stays plain, so that `restored` is always exact.

Everything happens within a row, so nothing is shuffled.

Defined results.  A null text counts as empty.  A null doc_id is hashed as the empty string.  Rows are independent: repeated rows give repeated
results.  A text of any length is read whole.  An empty table gives no rows.  Only doc_id and the text column are read, so that other columns may
have any names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import one_array, raw_bytes

#: The markers of the pieces, the order of the pieces in each form, and the percentages of the forms.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
_MARKER = re.compile(b"<[PSM]>")


class ByteIndex:
    """Code points and bytes of texts that lie in one array, the i-th from offsets[i] to offsets[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        extra = 1 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        self.offsets = offsets
        self.before = np.append(0, np.cumsum(extra))  # bytes beyond one of all multibyte characters before
        self.at_byte = lead
        self.at_point = lead - self.before[:-1]
        self.point_offsets = offsets - self.before[np.searchsorted(lead, offsets)]

    def lengths(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.point_offsets)

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        """Byte positions in the array of cuts before the given code point of each text."""
        flat = self.point_offsets[:-1] + points
        return flat + self.before[np.searchsorted(self.at_point, flat)]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code points of each text before the byte positions in the array."""
        return at - self.before[np.searchsorted(self.at_byte, at)] - self.point_offsets[:-1]


def _draws(seed: int):
    """Four unsigned 32-bit columns that depend on the seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _longs(column) -> np.ndarray:
    return one_array(column).to_numpy(zero_copy_only=False)


def fill_in_middle(docs: DataFrame, text: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (bytes) of each row of docs; null lengths where the form is plain."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("doc_id", "text", *_draws(seed))

    def run(batches):
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            index = ByteIndex(data, offsets)
            n = index.lengths()
            h1, h2, h3, h4 = (_longs(batch.column(k)) for k in (2, 3, 4, 5))
            one, two = h1 % (n + 1), h2 % (n + 1)
            first, second = np.minimum(one, two), np.maximum(one, two)
            cut, cut2 = index.to_bytes(first).tolist(), index.to_bytes(second).tolist()
            flat, edges = data.tobytes(), offsets.tolist()
            whole, spm = (h3 % 100 >= PLAIN_FROM).tolist(), (h4 % 100 < SPM_BELOW).tolist()
            forms, outputs = [], []
            for k, (a, d) in enumerate(zip(edges, edges[1:])):
                if a == d or whole[k] or _MARKER.search(flat, a, d):
                    forms.append("plain")
                    outputs.append(flat[a:d])
                    continue
                prefix, middle, suffix = flat[a : cut[k]], flat[cut[k] : cut2[k]], flat[cut2[k] : d]
                forms.append("spm" if spm[k] else "psm")
                outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm[k] else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            plain = np.array([f == "plain" for f in forms], bool)
            columns = [pa.array(n), pa.array(forms, pa.string()), pa.array(first, mask=plain), pa.array(second - first, mask=plain), pa.array(outputs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(rows: DataFrame) -> DataFrame:
    """rows (with form and output) and `text`, the bytes of the text that output was made of, and restored_prefix and restored_middle, the code points of its pieces."""
    keep = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            form = batch.column(keep.index("form")).to_pylist()
            texts, first, second = [], [], []
            for kind, value in zip(form, one_array(batch.column(keep.index("output")))):
                out = value.as_buffer().to_pybytes()
                a, b, c = len(out), len(out), b""
                if kind != "plain":
                    inner = out.index(PREFIX if kind == "spm" else SUFFIX, len(PREFIX))
                    last = out.index(MIDDLE, inner + len(SUFFIX))
                    left, right, c = out[len(PREFIX) : inner], out[inner + len(SUFFIX) : last], out[last + len(MIDDLE) :]
                    prefix, suffix = (right, left) if kind == "spm" else (left, right)
                    out, a, b = prefix + c + suffix, len(prefix), len(prefix) + len(c)
                texts.append(out)
                first.append(a)
                second.append(b)
            texts = pa.array(texts, pa.binary())
            data, offsets = raw_bytes(texts)
            index = ByteIndex(data, offsets)
            plain = np.array([f == "plain" for f in form], bool)
            one, two = (index.to_points(offsets[:-1] + np.array(cut, np.int64)) for cut in (first, second))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, pa.array(one, mask=plain), pa.array(two - one, mask=plain)], [*keep, "text", "restored_prefix", "restored_middle"])

    return rows.mapInArrow(run, f"{fields}, text binary, restored_prefix long, restored_middle long")


def form_digests(made: DataFrame) -> DataFrame:
    """The query's columns: output and the text rebuilt from it by their SHA-256."""
    return restored(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")
    )
