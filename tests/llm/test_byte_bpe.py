import hashlib
import random

import pytest
import tiktoken

from quarrymill.llm.byte_bpe import Codec, decode_documents, encode_documents, load_codec, public_vocabulary, round_trip_digests

RANKS, PATTERN = public_vocabulary()


@pytest.fixture(scope="module")
def plain():
    codec = load_codec(RANKS, PATTERN)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    some = ["", " ", "\n \n  x", "The quick brown fox's don't 12345 ###  é𝄞日本語", "a" * 3001, "ab" * 2000, "=-" * 999, "<|endoftext|>", "\x00\x7f  \xa0"]
    some += ["".join(rng.choice("abceinorst") for _ in range(n)) for n in (5, 50, 500, 5000)]
    some += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(400)) for _ in range(20)]
    return some


def test_same_ids_as_tiktoken(plain):
    codec = load_codec(RANKS, PATTERN)
    for text in texts():
        ids = codec.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert not any(codec.words) and not codec.more


def plain_merge(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found or piece in ranks:
            return (ranks[piece],) if piece in ranks else tuple(ranks[p] for p in parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_lowest_rank_then_leftmost_in_odd_vocabularies(seed):
    """Vocabularies whose parts may rank above the whole, over few letters, so that ties abound."""
    rng = random.Random(seed)
    tokens = [bytes((b,)) for b in range(256)]
    tokens += list({bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(rng.choice([5, 40, 90]))})
    rng.shuffle(tokens)
    codec = Codec({token: rank for rank, token in enumerate(tokens)}, ".+")
    for n in (1, 2, 3, 7, 30, 200):
        piece = bytes(rng.choice(b"ab") for _ in range(n))
        assert codec.merge(piece) == plain_merge(codec.ranks, piece)
    assert not any(codec.words) and not codec.more and max(codec.slots) < 0


def test_documents(docs_of, plain):
    rows = list(enumerate(texts())) + [(900, None), (None, "x y"), (3, texts()[3])]
    got = round_trip_digests(docs_of(rows), RANKS, PATTERN).collect()
    want = []
    for doc, text in rows:
        ids = plain.encode_ordinary(text or "")
        listed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((doc, len(ids), listed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_encode_then_decode_tables(docs_of):
    rows = list(enumerate(texts())) + [(900, None)]
    back = decode_documents(encode_documents(docs_of(rows), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes).decode() for r in back} == {d: t or "" for d, t in rows}


def test_empty_table_and_clashing_columns(docs_of):
    assert round_trip_digests(docs_of([]), RANKS, PATTERN).count() == 0
    assert encode_documents(docs_of([(1, "x")]).selectExpr("*", "1 AS ids"), RANKS, PATTERN).count() == 1
