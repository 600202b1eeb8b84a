import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from sightline.llm.bpe_automaton import ByteLevelCodec, TokenAutomaton, decode, encode, encode_decode, read_vocabulary
from sightline.llm.packing import Packer, WordIds, pack_documents, pack_turns
from sightline.llm.token_counts import _WORD, LongestMatch, byte_letters, count_tokens, word_pieces
from tests.llm.helpers import sample_texts, table

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts(n=300, seed=1):
    r = random.Random(seed)
    letters = "aabcdehtnsXYZ'lvm<|>  0159!?-_\t\n\r\x0b\x1c\x85\xa0éÉßΣσİñ́漢😀\x00"
    return ["".join(r.choice(letters) for _ in range(120)) for _ in range(n)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "a" * 150, " " * 40 + "x", "-" * 300]


@pytest.fixture(scope="module")
def codec():
    return ByteLevelCodec(*read_vocabulary(BYTES))


def test_automaton_equals_library(codec):
    library = Tokenizer.from_file(BYTES)
    for text in odd_texts() + [t or "" for t in sample_texts()]:
        n, ids, raw = codec.round_trip(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), ",".join(map(str, want)))
        assert raw.decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_gadgets_with_repeated_letters():
    tokens = {0: b"a", 1: b"b", 2: b"aa", 3: b"ab", 4: b"aaab"}
    automaton = TokenAutomaton(tokens, [(0, 0, 2), (0, 1, 3), (2, 3, 4)])
    assert automaton.encode(b"aaaaa") == [2, 2, 0]
    assert automaton.encode(b"aaab") == [4]
    assert automaton.encode(b"aab") == [2, 1]


def test_encode_decode_query(spark):
    texts = sample_texts()
    library = Tokenizer.from_file(BYTES)
    for r in encode_decode(table(spark, texts), BYTES).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = decode(encode(table(spark, texts), BYTES), BYTES).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert encode_decode(table(spark, []).limit(0), BYTES).count() == 0


def test_longest_match_equals_word_piece(spark):
    initial, inner = word_pieces(BYTES)
    letter = {b: c for c, b in byte_letters().items()}
    spell = lambda raw: "".join(letter[b] for b in raw)
    vocab = {}
    for piece in initial:
        vocab.setdefault(spell(piece), len(vocab))
    for piece in inner:
        vocab.setdefault("##" + spell(piece), len(vocab))
    vocab["[UNK]"] = len(vocab)
    library = Tokenizer(WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9))
    matcher = LongestMatch(initial, inner)

    def brute(word):
        got = library.encode(spell(word)).tokens
        return -1 if got == ["[UNK]"] else len(got)

    texts = sample_texts() + odd_texts(60)
    for word in {w for t in texts for w in _WORD.findall((t or "").encode())}:
        assert matcher.count(word) == brute(word)
    for r in count_tokens(table(spark, texts), BYTES).collect():
        counts = [brute(w) for w in _WORD.findall((texts[r.doc_id] or "").encode())]
        assert (r.n_words, r.n_unknown, r.n_tokens) == (len(counts), counts.count(-1), sum(abs(c) for c in counts))
    assert count_tokens(table(spark, []).limit(0), BYTES).count() == 0


def test_longest_match_pops_and_fails():
    m = LongestMatch([b"a", b"abc"], [b"b", b"bd", b"cc"])
    assert m.count(b"abc") == 1 and m.count(b"abd") == 2 and m.count(b"ab") == 2
    assert m.count(b"abcb") == 2 and m.count(b"abb") == 3 and m.count(b"ac") == -1 and m.count(b"x") == -1


def test_word_ids_equal_library():
    with open(WORDS, encoding="utf-8") as f:
        words = WordIds(f.read())
    library = Tokenizer.from_file(WORDS)
    for text in odd_texts() + [t or "" for t in sample_texts()]:
        assert words.encode(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_covers_every_id_once(spark):
    texts = sample_texts() + ["word " * 6000]
    library = Tokenizer.from_file(WORDS)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = pack_documents(table(spark, texts), WORDS).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack_documents(table(spark, []).limit(0), WORDS).count() == 0


def test_packing_of_turns_holds_three_limits_with_little_padding(spark):
    r = random.Random(3)
    turns = [(c, t, "assistant" if t % 2 else "user", " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(1, 160)))) for c in range(250) for t in range(4)]
    turns += [(None, 0, "user", None), (7, None, None, "word " * 9000), (7, 1, "assistant", "again"), (7, 1, "assistant", "again")]
    docs = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(2)
    rows = pack_turns(docs, WORDS, max_segments=24, max_loss=1800).collect()
    loss = {(c, t): role == "assistant" for c, t, role, _ in turns}
    used = {}
    for x in rows:
        tokens, segments, paid = used.get(x.sequence_id, (0, 0, 0))
        bears = x.length - (x.start == 0) if loss[(x.conv_id, x.turn)] else 0
        used[x.sequence_id] = (tokens + x.length, segments + 1, paid + bears)
    assert all(a <= 4096 and b <= 24 and c <= 1800 for a, b, c in used.values())
    full = sum(a == 4096 or b == 24 or c == 1800 for a, b, c in used.values())
    assert full >= len(used) - 2 and {a == 4096 for a, _, _ in used.values()} == {True, False}
    assert any(c == 1800 for _, _, c in used.values()) and any(b == 24 for _, b, _ in used.values())
    assert len({(x.conv_id, x.turn) for x in rows}) == len({(c, t) for c, t, _, _ in turns})


def test_documents_leave_little_padding(spark):
    r = random.Random(1)
    texts = ["word " * r.randrange(1, 2500) for _ in range(120)]
    rows = pack_documents(table(spark, texts), WORDS).collect()
    used = {}
    for x in rows:
        used[x.sequence_id] = used.get(x.sequence_id, 0) + x.length
    assert sum(v < 4096 for v in used.values()) <= 1  # one partition


def test_packer_holds_all_limits():
    r = random.Random(9)
    packer = Packer(capacity=100, max_segments=4, max_loss=60, pool=16)
    items = [(i, n := r.randrange(1, 250), r.randrange(0, n + 1)) for i in range(400)]
    for item in items:
        packer.add(*item)
    packer.finish()
    got, used = {}, {}
    for key, start, length, sequence, offset, segment in packer.out:
        got.setdefault(key, []).append((start, length))
        used.setdefault(sequence, []).append((key, start, length))
    for key, tokens, _ in items:
        at = 0
        for start, length in sorted(got[key]):
            assert start == at
            at += length
        assert at == tokens
    for parts in used.values():
        assert sum(n for _, _, n in parts) <= 100 and len(parts) <= 4
        # tokens without loss come first in an example
        assert sum(max(0, s + n - max(s, items[k][1] - items[k][2])) for k, s, n in parts) <= 60


def loss_by_sequence(examples, max_loss):
    """Tokens and loss-bearing tokens of each sequence; of (tokens, loss) the last ones bear loss."""
    packer = Packer(max_loss=max_loss, pool=32)
    for i, (tokens, loss) in enumerate(examples):
        packer.add(i, tokens, loss)
    packer.finish()
    out = {}
    for i, start, length, sequence, _, _ in packer.out:
        tokens, loss = examples[i]
        paid = max(0, start + length - max(start, tokens - loss))
        a, b = out.get(sequence, (0, 0))
        out[sequence] = (a + length, b + paid)
    assert sum(a for a, _ in out.values()) == sum(a for a, _ in examples) and sum(b for _, b in out.values()) == sum(b for _, b in examples)
    return list(out.values())


def test_loss_limit_binds_on_instruction_data_and_not_on_documents():
    r = random.Random(6)
    prompts = [(p + a, a) for p, a in ((r.randrange(20, 300), r.randrange(100, 400)) for _ in range(300))]
    held, free = loss_by_sequence(prompts, 1500), loss_by_sequence(prompts, 4096)
    assert max(b for _, b in held) <= 1500 < max(b for _, b in free) and len(held) > len(free)
    assert sum(b == 1500 and a < 4096 for a, b in held) > 0
    documents = [(n, n - 1) for n in (r.randrange(2, 9000) for _ in range(300))]
    assert all(b <= a <= 4096 for a, b in loss_by_sequence(documents, 4096))


def test_frequent_words_stay_while_rare_ones_pass(monkeypatch):
    import public_tokenizers

    from sightline.llm import packing

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    words, whole = packing.WordIds(spec), packing.WordIds(spec)
    for i in range(100):
        text = f"often rare{i} thing".encode()
        assert words.encode(text) == b"".join(np.array(whole.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes() for _ in range(1))
        assert len(words) + len(words.older) <= 21 and (b"often" in words or b"often" in words.older)
