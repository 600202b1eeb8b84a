"""Vector bin packing of tokenised examples into training sequences.

Each sequence has three limits that hold at once: tokens, segments and loss-bearing tokens.  One sequence is open at a time in a
partition; the dot-product heuristic puts into it the waiting example, of those that fit, whose demand has the largest dot
product with the room left, both as shares of the limits.  If none fits, the largest is cut to fill the room.
A pool of bounded size waits, so memory does not grow with a partition, and partitions pack independently: nothing
is shuffled, and only the last sequence of each partition is padded.

Defined results.  A null text is empty and has the end id alone.  Rows that repeat a doc_id, or have none, are packed each on its own.  Of examples
that fit equally well the one that waits in the first place is taken.  A text longer than a sequence is cut into pieces.  An empty table
gives no rows.  Only the keys, the text and what says whether it bears loss are read, so that other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batch_of, one_array, worker_model
from sightline.llm.token_counts import byte_letters

CAPACITY = 4096
#: Segments and loss-bearing tokens that one sequence may hold.
MAX_SEGMENTS = 512
MAX_LOSS = 4096
#: Examples that wait for the best place in a partition, and bytes of text behind one packing partition.
POOL = 512
PARTITION_BYTES = 10 << 20
#: Distinct words whose ids a worker keeps, and distinct pieces of words, which more words share and which cost more.
MEMO_WORDS, MEMO_PIECES = 100_000, 400_000
END_ID = 2
_LETTER_OF = {b: c for c, b in byte_letters().items()}
_PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment"]


#: Words of these code points are split here: each has one lower-case form, is composed already, and is a letter, an ASCII digit or a sign.
_PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]+")
#: What the vocabulary's own splitting pattern does to such words in lower case (a fixed value of the vocabulary).
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit integers, of the words of texts by a tokenizer that drops white space.

    Texts are cut at ASCII white space and each word is encoded once.  That is exact because neither the normaliser nor the splitting
    pattern joins what white space parts.  Plain words are split here, and the library's merges are applied to each piece, which
    is kept; other words, and those that may hold an added token, go through the whole library.  MEMO_WORDS are kept in two generations: where the younger one is full it becomes
    the older one, from which words that come again return, so that frequent words stay however many rare ones pass."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        last = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.four = [i.to_bytes(4, "little") for i in range(last + 1)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO_WORDS // 2:
            self.older = dict(self)
            self.clear()
        got = self.older.get(word)
        if got is not None:
            self[word] = got
            return got
        text = word.decode("utf-8", "replace")
        pieces = self.pieces
        if text.isascii() and text.isalpha():
            text = text.lower()
            got = pieces.get(text) or self._piece(text)
        elif _PLAIN.fullmatch(text) and not ("<" in text and any(a in text for a in self.added)):
            got = b"".join([pieces.get(p) or self._piece(p) for p in _PIECE.findall(text.lower())])
        else:
            got = b"".join([self.four[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(_LETTER_OF.__getitem__, piece.encode()))  # printable ASCII stands for itself
        four = self.four
        got = self.pieces[piece] = b"".join([four[t.id] for t in self.tokenize(letters)])
        return got

    def encode(self, text: bytes) -> bytes:
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.split()))


class Packer:
    """Packs (key, tokens, loss-bearing tokens) one by one; emits (key, start, length, sequence, offset, segment)."""

    def __init__(self, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, pool: int = POOL):
        self.limits = np.array([capacity, max_segments, max_loss], np.float64)
        self.pool = pool
        self.keys: list = [None] * (pool + 1)
        self.start = np.zeros(pool + 1, np.int64)
        #: tokens, segments, loss of the waiting examples; rows from n on are free
        self.need = np.zeros((pool + 1, 3), np.int64)
        self.n = 0
        self.sequence = 0
        self.out: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.room = self.limits.astype(np.int64).copy()
        self.offset = self.segment = 0

    def _close(self) -> None:
        if self.offset:
            self.sequence += 1
            self._open()

    def add(self, key, tokens: int, loss: int) -> None:
        self.keys[self.n], self.start[self.n], self.need[self.n] = key, 0, (tokens, 1, loss)
        self.n += 1
        while self.n > self.pool:
            self._place()

    def finish(self) -> None:
        while self.n:
            self._place()
        self._close()

    def _place(self) -> None:
        need = self.need[: self.n]
        fits = (need <= self.room).all(axis=1)
        share = self.room / self.limits**2
        gain = need @ share
        if fits.any():
            self._put(int(np.where(fits, gain, -1.0).argmax()), None)
        else:
            self._put(int(gain.argmax()), min(int(self.room[0]), int(self.room[2])))

    def _put(self, i: int, cut: int | None) -> None:
        tokens, _, loss = self.need[i].tolist()
        # of a piece cut from the head: the tokens without loss come first
        take = tokens if cut is None else min(tokens, int(self.room[0]), (tokens - loss) + int(self.room[2]))
        paid = loss if take == tokens else max(0, take - (tokens - loss))
        self.out.append((self.keys[i], int(self.start[i]), take, self.sequence, self.offset, self.segment))
        self.offset += take
        self.segment += 1
        self.room -= (take, 1, paid)
        if take == tokens:
            self.n -= 1
            last = self.n
            self.keys[i], self.start[i], self.need[i] = self.keys[last], self.start[last], self.need[last]
            self.keys[last] = None
        else:
            self.start[i] += take
            self.need[i, 0] -= take
            self.need[i, 2] -= paid
        if self.room.min() <= 0:
            self._close()


def pack(rows: DataFrame, keys: list[str], text, bears_loss, tokenizer: str, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, end_id: int = END_ID, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row for each piece of an example: its keys (as longs), start, length, ids_crc32, doc_tokens, sequence_id, offset, segment.

    text, bears_loss: columns; all tokens but the first of an example that bears loss do so, as the first one has nothing to be predicted from.
    tokenizer: path of a tokenizers file, read on the driver and sent along.  Input partitions are merged until each has about
    partition_bytes of text, which bounds the padding: one sequence of each partition is padded."""
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    name = hashlib.sha256(content.encode()).hexdigest()
    spec = rows.sparkSession.sparkContext.broadcast(content)
    data = F.coalesce(text.cast("binary"), F.lit(b""))
    size = int(rows.agg(F.sum(F.octet_length(data)).alias("b")).first()["b"] or 0)
    rows = rows.select(*[F.col(f"`{k}`").cast("long").alias(k) for k in keys], data.alias("_text"), F.coalesce(bears_loss, F.lit(False)).alias("_loss"))
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([(k, pa.int64()) for k in [*keys, *_PIECES]])

    def run(batches):
        words = worker_model(f"word ids {name}", lambda: WordIds(spec.value))
        packer = Packer(capacity, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 36

        def rows_out():
            got, packer.out = packer.out, []
            examples, start, length, sequence, offset, segment = zip(*got)
            crc = [zlib.crc32(x[-1][4 * s : 4 * (s + n)]) for x, s, n in zip(examples, start, length)]
            named = [[x[i] for x in examples] for i in range(len(keys))]
            return batch_of(schema, *named, start, length, crc, [len(x[-1]) // 4 for x in examples], np.array(sequence) + base, offset, segment)

        for batch in batches:
            named = [batch.column(i).to_pylist() for i in range(len(keys))]
            for *key, value, loss in zip(*named, one_array(batch.column(len(keys))), batch.column(len(keys) + 1).to_pylist()):
                ids = words.encode(value.as_py()) + end
                n = len(ids) // 4
                packer.add((*key, ids), n, n - 1 if loss else 0)
                if len(packer.out) >= 20_000:
                    yield from rows_out().to_batches()
        packer.finish()
        if packer.out:
            yield from rows_out().to_batches()

    rows = rows.coalesce(max(1, -(-size // partition_bytes)))
    return rows.mapInArrow(run, ", ".join(f"`{k}` long" for k in [*keys, *_PIECES]))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", **limits) -> DataFrame:
    """pack() of documents by doc_id; all of them bear loss."""
    return pack(docs, ["doc_id"], F.col(f"`{text}`"), F.lit(True), tokenizer, **limits)


def pack_turns(conversations: DataFrame, tokenizer: str, max_segments: int = 24, max_loss: int = 2560, **limits) -> DataFrame:
    """pack() of the turns of conversations by conv_id and turn; only those of the assistant bear loss."""
    return pack(conversations, ["conv_id", "turn"], F.col("text"), F.col("role") == "assistant", tokenizer, max_segments=max_segments, max_loss=max_loss, **limits)
