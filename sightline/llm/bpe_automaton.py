"""Byte-pair encoding and decoding by a tokenisation automaton.

The automaton reads tokens.  It starts as one that accepts every sequence of bytes, and the merges are worked into it one by one, in
order.  The gadget for the merge of u and v into w takes the arc v away after u, and adds a state w that is entered from
where u is entered and goes on as v goes on.  A state is named by the token that leads to it, so the automaton is deterministic, and a
sequence is accepted exactly if it is the encoding of its bytes.  The gadgets copy whole rows of arcs; the rows are kept as
references to the row copied and the moment of the copy, and an arc is looked up along these references once and then kept in the table.

Encoding walks a pre-split word and keeps the state reached after each byte: exactly one token ends there that the state before it has an arc for.
Decoding follows the same arcs and emits their labels, the bytes of the tokens.

Defined results.  A null text is empty.  The strings of added tokens in a text become their ids.  Rows that repeat a doc_id, or have none, are encoded
each on its own.  An empty table gives no rows.  A text of any length is encoded whole, piece by piece.  Only doc_id and the text column
are read, so that other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batch_of, one_array, worker_model
from sightline.llm.token_counts import byte_letters

#: The published splitting pattern of byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_WORDS = 400_000
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TokenAutomaton:
    """tokens: bytes of each id; merges: (left id, right id, merged id) in order of priority."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.label = tokens
        #: of each merged token: left part, right part and the moment of its merge; bytes have moment -1
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.moment: dict[int, int] = {}
        #: when the arc of the second token after the first was taken away
        self.removed: dict[tuple[int, int], int] = {}
        made = {t for t, raw in tokens.items() if len(raw) == 1}
        for t in made:
            self.moment[t] = -1
        for when, (u, v, w) in enumerate(merges):
            self._gadget(when, u, v, w)
        self.merges = len(merges)
        self.arcs: dict[tuple[int, int], bool] = {}
        # tokens by their bytes from the last to the first
        self.ends: dict = {}
        for t in self.moment:
            node = self.ends
            for b in reversed(tokens[t]):
                node = node.setdefault(b, {})
            node[-1] = t

    def _gadget(self, when: int, u: int, v: int, w: int) -> None:
        if u in self.moment and v in self.moment and self._copied_arc(u, v, when):
            self.removed[u, v] = when
            if w in self.moment:
                raise ValueError("two merges make the same token")
            self.left[w], self.right[w], self.moment[w] = u, v, when

    def arc(self, state: int, token: int) -> bool:
        """Whether the finished automaton has an arc for token in this state."""
        key = (state, token)
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._copied_arc(state, token, self.merges)
        return known

    def _copied_arc(self, state: int, token: int, until: int) -> bool:
        """Whether there is the arc before the moment `until`."""
        moment, removed = self.moment, self.removed
        while True:
            gone = removed.get((state, token))
            if gone is not None and gone < until:
                return False
            a, b = moment[state], moment[token]
            if a < 0 and b < 0:
                return True
            if b >= a:  # the token is the newer one: it is entered from where its left part was, after that merge took its arc away
                until, token = b + 1, self.left[token]
            else:  # the state is the newer one: it goes on as its right part did before that merge
                until, state = a, self.right[state]

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n = len(word)
        state: list[int] = [0] * (n + 1)
        arcs, ends = self.arcs, self.ends
        for i in range(1, n + 1):
            node, j = ends, i
            while j > 0:
                node = node.get(word[j - 1])
                if node is None:
                    raise ValueError("the vocabulary does not cover these bytes")
                j -= 1
                token = node.get(-1)
                if token is not None:
                    if j == 0:
                        ok = True  # each token of the automaton is the encoding of its own bytes
                    else:
                        ok = arcs.get((state[j], token))
                        if ok is None:
                            ok = self.arc(state[j], token)
                    if ok:
                        state[i] = token
                        break
        out, i = [], n
        while i > 0:
            out.append(state[i])
            i -= len(self.label[state[i]])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


def read_vocabulary(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Bytes of the ids, merges as ids, and added tokens of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    vocab = spec["model"]["vocab"]
    tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return tokens, merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}


class ByteLevelCodec:
    """Whole texts: splits at added tokens and by the pattern, and keeps what it has encoded."""

    def __init__(self, tokens, merges, added: dict[str, int]):
        import regex

        self.automaton = TokenAutomaton(tokens, merges)
        self.added = added
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memo: dict[str, tuple[str, int, bytes]] = {}

    def _word(self, word: str) -> tuple[str, int, bytes]:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        ids = self.automaton.encode(word.encode())
        got = self.memo[word] = (",".join(map(str, ids)), len(ids), self.automaton.decode(ids))
        return got

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the decoded bytes."""
        memo, new = self.memo, self._word
        ids, raw, n = [], [], 0
        for part in self.split.split(text) if self.split and any(a in text for a in self.added) else [text]:
            if part in self.added:
                ids.append(str(self.added[part]))
                raw.append(part.encode())
                n += 1
            elif part:
                got = [memo[w] if w in memo else new(w) for w in self.words(part)]
                a, b, c = zip(*got)
                ids.extend(a)
                n += sum(b)
                raw.extend(c)
        return n, ",".join(ids), b"".join(raw)


def _sent(spark, vocabulary: str):
    """What a worker calls for the codec of a vocabulary file, which is read on the driver and sent along."""
    spec = read_vocabulary(vocabulary)
    name = hashlib.sha256(repr(spec).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(spec)
    return lambda: worker_model(f"codec {name}", lambda: ByteLevelCodec(*sent.value))


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text.  vocabulary: path of a vocabulary file, read on the driver and sent along."""
    codec_of = _sent(docs.sparkSession, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        codec = codec_of()
        for batch in batches:
            count, ids, raw = [], [], []
            for value in one_array(batch.column(1)):
                n, listed, decoded = codec.round_trip(value.as_py())
                count.append(n)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                raw.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield from batch_of(_OUT, batch.column(0), count, ids, raw).to_batches()

    return rows.mapInArrow(run, _DDL)


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>)."""
    codec_of = _sent(docs.sparkSession, vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        codec = codec_of()
        for batch in batches:
            ids = [[int(x) for x in codec.round_trip(v.as_py())[1].split(",") if x] for v in one_array(batch.column(1))]
            yield from batch_of(schema, batch.column(0), ids).to_batches()

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows of ids."""
    codec_of = _sent(encoded.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        codec = codec_of()
        names = {i: t.encode() for t, i in codec.added.items()}
        label = codec.automaton.label | names
        for batch in batches:
            texts = [b"".join(label[i] for i in ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield from batch_of(schema, batch.column(0), texts).to_batches()

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
