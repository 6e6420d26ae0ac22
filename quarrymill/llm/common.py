"""Shared helpers: Arrow batches in bounded slices, kept results of pre-tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.staging import shared_folder, staged

__all__ = ["SPACES", "KeptPieces", "by_slices", "shared_folder", "staged", "text_or_empty"]

#: Characters that separate words, as the contracts list them: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows and text bytes that a Python function holds at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def by_slices(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]], prepare: Callable[[], object] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands ``work`` slices of bounded rows and bytes.

    ``prepare`` runs once in each task and its value is passed to ``work`` as second argument.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = (prepare(),) if prepare else ()
        for batch in batches:
            step = max(1, min(SLICE_ROWS, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                out = work(batch.slice(start, step), *extra)
                yield from out if isinstance(out, list) else [out]

    return run


class KeptPieces(dict):
    """Pre-token -> its ids as bytes; computes what it has not and keeps a bounded number.

    Pre-tokens longer than ``longest`` are kept for one document only, and all are dropped
    once there are more than ``most``.
    """

    def __init__(self, compute: Callable[[str], bytes], most: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.passing = compute, most, longest, []

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.compute(piece)
        if len(piece) > self.longest:
            self.passing.append(piece)
        return ids

    def join(self, pieces: list[str]) -> bytes:
        """The ids of a document's pre-tokens, then back within the bounds."""
        ids = b"".join(map(self.__getitem__, pieces))
        if len(self) > self.most:
            self.clear()
        else:
            for piece in self.passing:
                del self[piece]
        self.passing.clear()
        return ids
