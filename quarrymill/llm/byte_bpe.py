"""Byte-level BPE encoding and decoding with a rank queue.

Merging one pre-token: its bytes form a linked list; each adjacent pair whose concatenation is
in the vocabulary puts its position into the bucket of that rank. A bitmap of two levels of
256-bit words marks the ranks that have positions, so find-first-set gives the next rank in two
steps whatever the length. Entries that an earlier merge made stale are skipped when they come
up. The work is near-linear in the pre-token, which matters for those of thousands of bytes.

Pre-tokens repeat, so each task keeps the ids of those it has seen, up to a fixed number.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarrymill.llm.common import KeptPieces, by_slices, text_or_empty

#: Bits of a bitmap word.
WORD = 256
BITS = [1 << i for i in range(WORD)]


class Codec:
    """Encoder and decoder of one rank file.

    The rank queue lives in ``slots`` (a waiting position by rank), ``more`` (a heap of further
    positions by rank) and a bitmap of two levels: ``words`` has a bit for each rank with a
    position, the top word a bit for each word that is not zero. All are empty between merges.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        most = max(ranks.values(), default=0)
        if most >= WORD * WORD:
            raise ValueError("the two bitmap levels hold 65,536 ranks")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in ranks.values()}
        self.single = [ranks.get(bytes((a,)), -1) for a in range(256)]
        self.double = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.slots, self.more, self.words = [-1] * (most + 1), {}, [0] * (WORD + 1)
        self.kept = KeptPieces(lambda piece: array("I", self.merge(piece.encode())).tobytes())

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        find, n, double = self.ranks.get, len(piece), self.double
        slots, more, words, bit, top = self.slots, self.more, self.words, BITS, 0
        after, before = list(range(1, n + 2)), list(range(-1, n))  # neighbours of the part that starts at i
        part = [self.single[byte] for byte in piece]  # id of the part that starts at i
        # Rank of the part at i joined with the next one; -1 where there is none or no part starts.
        pair = [double[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
        pair.append(-1)
        waiting = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        while waiting or top:
            for rank, i in waiting:  # push
                if slots[rank] < 0:
                    slots[rank] = i
                    high = rank >> 8
                    words[high] |= bit[rank & 255]
                    top |= bit[high]
                else:
                    heappush(more.setdefault(rank, []), i)
            high = (top & -top).bit_length() - 1  # pop: the first bit of the first word
            word = words[high]
            low = word & -word
            rank = (high << 8) + low.bit_length() - 1
            i = slots[rank]
            if more and rank in more:
                others = more[rank]
                i = heappushpop(others, i)
                slots[rank] = heappop(others)
                if not others:
                    del more[rank]
            else:
                slots[rank] = -1
                words[high] = word = word ^ low
                if not word:
                    top &= top - 1
            waiting = []
            if pair[i] != rank:
                continue  # stale: one of the two parts has changed since
            gone = after[i]
            after[i] = end = after[gone]
            part[i], pair[gone], pair[i] = rank, -1, -1
            if end < n:
                before[end] = i
                pair[i] = joined = find(piece[i : after[end]], -1)
                if joined >= 0:
                    waiting.append((joined, i))
            left = before[i]
            if left >= 0:
                pair[left] = joined = find(piece[left:end], -1)
                if joined >= 0:
                    waiting.append((joined, left))
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return array("I", self.kept.join(self.split(text))).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load_codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file (base64 bytes and rank on each line), once in each process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row; narrow, without a shuffle.

    Each match of ``pattern`` is encoded by itself, without special tokens. Null text counts as
    empty, which has no ids. Repeated rows and null ids each keep their row; other columns are
    left out, so clashing names do no harm. Texts have no length limit.
    """

    def work(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    return source.mapInArrow(by_slices(work, lambda: load_codec(rank_file, pattern)), f"doc_id {_kind(docs)}, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes). Null ids decode to no bytes; an unknown id is an error."""

    def work(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        found = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(by_slices(work, lambda: load_codec(rank_file, pattern)), f"doc_id {_kind(encoded)}, bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass, only digests leave Python."""

    def digests(text: str, codec: Codec) -> tuple[int, str, str]:
        ids = codec.encode(text)
        listed = " ".join(map(codec.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    def work(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        found = [digests(text, codec) for text in batch.column(1).to_pylist()]
        n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
        arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(by_slices(work, lambda: load_codec(rank_file, pattern)), schema)


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def public_vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
