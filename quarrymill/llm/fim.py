"""Fill-in-the-middle transformation over UTF-8 bytes with a sparse index of multibyte characters.

A text is cut twice and its parts are put in another order between markers, so that a model
learns to fill a gap. Cuts fall between units: words of ASCII letters and single other
characters (`[A-Za-z]+|[^A-Za-z]`), or code points. Everything is computed on the bytes of the
Arrow buffer; no text is decoded. The index records only where multibyte characters are and how
many bytes each has beyond one, so an ASCII text needs no index at all and any span of ASCII
is plain arithmetic.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, text_or_empty

#: Markers of prefix, suffix and middle; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts this many are transformed, and of 100 transformed ones this many start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1
#: Bytes of one step when a unit's place is looked for.
BLOCK = 1 << 16

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
LEAD = np.arange(256) & 0xC0 != 0x80  # bytes that start a character
EXCESS = np.zeros(256, np.int64)  # bytes beyond the first, by lead byte
EXCESS[0xC0:0xE0], EXCESS[0xE0:0xF0], EXCESS[0xF0:] = 1, 2, 3


class SparseIndex:
    """Converts between byte and code-point cuts of one UTF-8 text.

    ``at`` holds the byte place of each multibyte character, ``chars`` its code-point place and
    ``excess`` the bytes beyond one of all of them before each (with the total at the end).
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        self.excess = np.concatenate([[0], np.cumsum(EXCESS[data[self.at]])])
        self.chars = self.at - self.excess[:-1]

    def to_chars(self, byte: int) -> int:
        """Code points before a byte place that starts a character or ends the text."""
        return int(byte - self.excess[np.searchsorted(self.at, byte)]) if len(self.at) else byte

    def to_bytes(self, char: int) -> int:
        """Bytes before the given number of code points."""
        return int(char + self.excess[np.searchsorted(self.chars, char)]) if len(self.at) else char


class Units:
    """The words and single characters of one text: how many, and where the n-th starts."""

    def __init__(self, data: np.ndarray):
        letter = LETTER[data]
        self.starts = LEAD[data]
        self.starts[1:] &= ~(letter[1:] & letter[:-1])
        edges = np.arange(0, len(data), BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.starts, edges, dtype=np.int64))]) if len(data) else np.zeros(1, np.int64)
        self.n = int(self.before[-1])

    def to_bytes(self, unit: int) -> int:
        """The byte place where a unit starts; that of unit n is the end of the text."""
        if unit >= self.n:
            return len(self.starts)
        block = int(np.searchsorted(self.before, unit, side="right")) - 1
        within = self.starts[block * BLOCK : (block + 1) * BLOCK]
        return block * BLOCK + int(np.flatnonzero(within)[unit - self.before[block]])


@dataclass(frozen=True)
class Settings:
    """How texts are cut: ``unit`` is ``token`` (words and single characters) or ``char`` (code points)."""

    unit: str = "token"
    seed: int = SEED
    transformed: int = TRANSFORMED
    suffix_first: int = SUFFIX_FIRST

    def __post_init__(self):
        if self.unit not in ("token", "char"):
            raise ValueError(f"unknown unit {self.unit!r}")


def transform(raw: bytes | memoryview, name: str, how: Settings = Settings()) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text.

    ``name`` is the document's id as text; with the seed it decides cuts and form.
    """
    data = np.frombuffer(raw, np.uint8)
    raw = bytes(raw)
    units, index = Units(data) if how.unit == "token" else None, None
    if units is None:
        index = SparseIndex(data)
        n = len(data) - int(index.excess[-1])
    else:
        n = units.n
    digest = hashlib.sha256(f"{how.seed}:{name}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4))
    if not raw or h3 % 100 >= how.transformed or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    index = index or SparseIndex(data)
    start, end = ((units or index).to_bytes(cut) for cut in (first, last))
    prefix, middle, suffix = PREFIX.encode() + raw[:start], MIDDLE.encode() + raw[start:end], SUFFIX.encode() + raw[end:]
    chars = index.to_chars(start)
    if h4 % 100 < how.suffix_first:
        return n, "spm", chars, index.to_chars(end) - chars, suffix + prefix + middle
    return n, "psm", chars, index.to_chars(end) - chars, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    Null text counts as empty; an empty text, or one that holds a marker, stays plain. Texts
    are cut whole, whatever their length; memory is a few bytes for each byte of one text.
    A null doc_id draws as an empty one. Rows stand alone: repeated rows give repeated results,
    and rows of one doc_id draw the same numbers. Other columns are left out, so clashing names
    do no harm. An empty table gives an empty result. Nothing is shuffled.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), text_or_empty().alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [transform(text.as_buffer() or b"", name, how) for name, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[4] = arrays[4].cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(by_slices(work), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text as it was, from output and form alone.

    No marker can begin inside a part and end in the next marker, so the first three are the own ones.
    """
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
