"""Best-fit-decreasing packing of tokenized documents into sequences.

The packing depends only on how many pieces have each length, and lengths are at most the
sequence size. So the driver gets one count per length, packs those with a segment tree over
remaining capacities, many equal pieces at a step, and sends back a plan: which ranks of a
length go to which run of sequences at which offset. Its size depends on the sequence size and
not on the number of documents. Pieces then find their place from their rank in their length.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from dataclasses import dataclass
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import KeptPieces, by_slices, staged, text_or_empty

SEQUENCE_TOKENS = 2048
END_ID = 0


class PieceTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the tokenizers library.

    The library's model works on each pre-token by itself, so a pre-token goes to it once, in
    the byte alphabet that it expects, and its ids are kept. A text that holds the string of an
    added token goes to the library as a whole, which gives that token's id.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(vocabulary)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.tokenize = self.whole.model.tokenize
        self.split = regex.compile(pattern).findall
        self.kept = KeptPieces(self.encode_piece)
        # Printable bytes stand for themselves, the others for the code points from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (b for b in range(256) if b not in shown)
        self.alphabet = {b: 256 + n for n, b in enumerate(hidden)}

    def encode_piece(self, piece: str) -> bytes:
        tokens = self.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return pack(f"<{len(tokens)}I", *[token.id for token in tokens])

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.kept.join(self.split(text))


@lru_cache(maxsize=2)
def load_tokenizer(vocabulary: str, pattern: str) -> PieceTokenizer:
    return PieceTokenizer(vocabulary, pattern)


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a shorter first."""
    first = length % size or size
    return [(0, min(length, first))] + [(at, size) for at in range(first, length, size)]


def tokenized_pieces(docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every row."""

    def work(batch: pa.RecordBatch, tokenizer: PieceTokenizer) -> pa.RecordBatch:
        end = np.array([END_ID], "<u4").tobytes()
        rows: list[list] = [[] for _ in range(6)]
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = tokenizer.encode(text) + end
            for number, (start, length) in enumerate(cut(len(ids) // 4, size)):
                own = ids[4 * start : 4 * (start + length)]
                values = (row, number, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        arrays = [pa.array(column, kind) for column, kind in zip(rows, kinds, strict=True)]
        arrays[0] = batch.column(0).take(arrays[0])
        return pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    source = docs.select("doc_id", text_or_empty().alias("text"))
    return source.mapInArrow(by_slices(work, lambda: load_tokenizer(vocabulary, pattern)), schema)


class CapacityTree:
    """Segment tree over remaining capacities; finds the smallest one in use that is large enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = [False] * (2 * self.leaves)

    def mark(self, capacity: int, used: bool) -> None:
        node = capacity + self.leaves
        self.used[node] = used
        while node > 1:
            node >>= 1
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.leaves
        while not self.used[node]:  # up and to the right, to the next subtree of larger capacities
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass(frozen=True)
class Plan:
    """Arrays of steps sorted by (length, rank): ranks from ``rank`` on go to sequences from ``first`` on."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_packing(counts: dict[int, int], size: int = SEQUENCE_TOKENS) -> Plan:
    """Best fit decreasing of ``counts[length]`` pieces of each length.

    Sequences of equal remaining capacity are runs of consecutive numbers. Best fit stays with
    the sequence just used while it holds another piece of the length, as nothing is tighter, so
    each sequence of a run gets as many as it holds before the next gets one. A step is one such
    layer: one piece in each sequence, all at one offset. Only a length's last pieces split a
    run, so runs stay under three times the number of lengths.
    """
    tree, runs, steps, opened = CapacityTree(size), {}, [], 0

    def keep(capacity: int, first: int, n: int) -> None:
        runs.setdefault(capacity, deque()).append((first, n))
        tree.mark(capacity, True)

    for length in sorted((n for n, count in counts.items() if count), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                n = -(-left // (size // length))  # as many as hold what is left of this length
                keep(size, opened, n)
                opened += n
                continue
            first, n = runs[capacity].popleft()
            if not runs[capacity]:
                tree.mark(capacity, False)
            full = min(n, left // (capacity // length))
            each, taken = (capacity // length, full) if full else (left, 1)  # else one sequence takes all that is left
            if taken < n:
                keep(capacity, first + taken, n - taken)
            for layer in range(each):
                steps.append((length, rank, first, size - capacity + layer * length))
                rank, left = rank + taken, left - taken
            keep(capacity - each * length, first, taken)
    columns = np.array(sorted(steps), np.int64).reshape(-1, 4).T
    return Plan(*columns, opened)


def _placed(batch: pa.RecordBatch, plan: Plan) -> pa.RecordBatch:
    length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
    low, high = np.searchsorted(plan.length, length, "left"), np.searchsorted(plan.length, length, "right")
    step = np.empty(len(length), np.int64)
    for one in np.unique(length):
        rows = length == one
        start, stop = low[rows][0], high[rows][0]
        step[rows] = start + np.searchsorted(plan.rank[start:stop], rank[rows], "right") - 1
    sequence = plan.first[step] + rank - plan.rank[step]
    kept = [name for name in batch.schema.names if name not in ("rank", "bucket")]
    arrays = [batch.column(name) for name in kept] + [pa.array(sequence), pa.array(plan.offset[step])]
    return pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, size: int = SEQUENCE_TOKENS, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its ids and a closing id 0; documents over ``size`` ids are cut into full
    pieces after a shorter first one. Every sequence holds at most ``size`` ids without gaps.
    Full pieces have a sequence of their own, numbered below zero.

    Null or empty text is the closing id alone. Repeated rows and null ids are packed row by
    row. Texts have no length limit; an empty table gives an empty result. Other columns are
    left out, so clashing names do no harm.
    """
    pieces = tokenized_pieces(docs, vocabulary, pattern, size, with_ids).withColumn("row", F.monotonically_increasing_id())
    pieces = staged(pieces, "pieces")
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    parts = pieces.where(F.col("length") < size)

    # Ranks within a length, in buckets so that no length has to meet in one task.
    buckets = max(256, math.isqrt(pieces.count()))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = staged(parts.groupBy("length", "bucket").count(), "piece-counts")
    counts = {row["length"]: row["n"] for row in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_packing(counts, size)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = parts.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place")).select(*pieces.columns, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = ranked.mapInArrow(by_slices(lambda batch: _placed(batch, plan)), schema)
    return packed.unionByName(full).drop("row")


def public_vocabulary() -> tuple[str, str]:
    """Vocabulary file and pattern of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
