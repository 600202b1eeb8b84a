"""Word-piece token counts by linear longest-match.

The vocabulary is a trie of initial pieces and, under a second root, of continuation pieces.  Each node has a failure link and the number of
tokens that following it pops; a text position is visited once, no piece is ever built, and no position is tried again.
When a node has no edge for the next byte, the longest pieces that the matched bytes start with are popped (counted), and the link leads to the
node for what is left, read as a continuation.

Words are what white space and ASCII punctuation part (a punctuation mark is a word).  A word that cannot be spelled out is one unknown token.

Defined results.  A null text is empty and has no tokens.  Rows that repeat a doc_id, or have none, are counted each on its own.  An
empty table gives no rows.  A text of any length is counted whole, word by word.  Of pieces that match at a place the longest is taken, so that
there are no ties.  Only doc_id and the text column are read, so that other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batch_of, one_array, worker_model

MEMO_WORDS = 600_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]|[\x00-\x08\x0e-\x1f\x7f]+")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def byte_letters() -> dict[str, int]:
    """The printable code point that stands for each byte in byte-level vocabularies: itself, or 256 and on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and continuation pieces of a byte-level vocabulary file: pieces with a leading blank start a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    initial, inner = [], []
    for token in vocab:
        raw = bytes(letters[c] for c in token)
        if raw[:1] == b" ":
            if raw.strip(b" ") == raw[1:] and len(raw) > 1:
                initial.append(raw[1:])
        else:
            inner.append(raw)
    return initial, inner


class LongestMatch:
    """Counts the word pieces of greedy longest-match-first tokenisation in time linear in the word."""

    def __init__(self, initial: list[bytes], inner: list[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0: start of a word; node 1: after a piece
        ends = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for b in piece:
                    to = self.edges[node].get(b)
                    if to is None:
                        to = self.edges[node][b] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    node = to
                if node != root:
                    ends[node] = True
        # failure link (-1: none) and popped tokens, breadth first
        n = len(self.edges)
        self.link, self.popped = [-1] * n, [0] * n
        queue = [(to, 0, b) for b, to in self.edges[0].items()] + [(to, 1, b) for b, to in self.edges[1].items()]
        for node, parent, b in queue:
            queue.extend((to, node, c) for c, to in self.edges[node].items())
            if ends[node]:
                self.link[node], self.popped[node] = 1, 1
                continue
            z, count = self.link[parent], self.popped[parent]
            while z >= 0 and b not in self.edges[z]:
                count += self.popped[z]
                z = self.link[z]
            if z >= 0:
                self.link[node], self.popped[node] = self.edges[z][b], count

    def count(self, word: bytes) -> int:
        """The number of pieces, or -1 if the word cannot be spelled out."""
        edges, link, popped = self.edges, self.link, self.popped
        node, total = 0, 0
        for b in word:
            to = edges[node].get(b)
            while to is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                to = edges[node].get(b)
            node = to
        while node != 1:
            if node == 0:
                return 0
            total += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return total


class _Memo(dict):
    """The count of each word met, computed once."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: bytes) -> int:
        n = self.matcher.count(word)
        self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown.  vocabulary: path of a vocabulary file, read on the driver; its pieces are sent along."""
    pieces = word_pieces(vocabulary)
    name = hashlib.sha256(repr(pieces).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        memo = worker_model(f"pieces {name}", lambda: _Memo(LongestMatch(*sent.value)))
        for batch in batches:
            words_of, tokens, unknown = [], [], []
            for value in one_array(batch.column(1)):
                words = _WORD.findall(value.as_buffer())
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                counts = list(map(memo.__getitem__, words))
                bad = counts.count(-1)
                words_of.append(len(words))
                unknown.append(bad)
                tokens.append(sum(counts) + 2 * bad)
            yield from batch_of(_OUT, batch.column(0), words_of, tokens, unknown).to_batches()

    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
