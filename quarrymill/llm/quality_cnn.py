"""Quality classifier: a byte-level convolutional network in numpy.

Input symbols are the text's bytes, each with a flag that its eight bytes occurred within the
last 32: a filter is linear, so without the flag no filter can see that a word is said again
and again (the README has figures for both). Learned filters run over chunks that overlap and
cover the whole document; each filter's maximum in a chunk, its mean and its maximum over the
chunks give one probability. A filter is a table of weights by (offset, symbol), so a
convolution is a sum of row look-ups.

Training takes a bounded sample of labelled documents, with all chunks of each; scoring takes
every chunk of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, staged, text_or_empty

#: Bounds of the training sample: labelled documents, and bytes of all of them.
TRAIN_ROWS, TRAIN_BYTES = 2000, 32 << 20
CHUNK, OVERLAP, WIDTH, FILTERS = 512, 64, 6, 16
SYMBOLS, GRAM, LAGS = 512, 8, range(2, 33)
#: Chunks that go through the filters together.
SLICE = 64
#: Passes over the sample, more where they are fewer than STEPS steps; batch, rate of learning, decay of weights.
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 192, 64, 0.01, 1e-5
THRESHOLD = 0.7


def symbols(raw: bytes) -> np.ndarray:
    """Bytes, plus 256 where the eight bytes from there on also start up to 32 bytes earlier; U+0000 fills up texts shorter than a filter."""
    held = np.frombuffer(raw.ljust(WIDTH, b"\0"), np.uint8)
    out = held.astype(np.int16)
    if len(held) > GRAM:
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(held, GRAM)).view(np.uint64)[:, 0]
        again = np.zeros(len(grams), bool)
        for lag in LAGS:
            if lag < len(grams):
                again[lag:] |= grams[lag:] == grams[:-lag]
        out[: len(grams)][again] += 256
    return out


def chunk_starts(n: int) -> np.ndarray:
    """Starts of chunks that cover n symbols; the last one is moved back to end with the text."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK, CHUNK - OVERLAP)
    return np.append(starts, n - CHUNK)


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x SYMBOLS x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 x FILTERS: for the mean and the maximum over chunks
    offset: float

    def responses(self, syms: np.ndarray) -> np.ndarray:
        """Filter responses at each place of the last axis where a filter fits."""
        places = syms.shape[-1] - WIDTH + 1
        out = self.filters[0][syms[..., :places]]
        for j in range(1, WIDTH):
            out += self.filters[j][syms[..., j : j + places]]
        return out

    def score(self, text: str) -> float:
        syms = symbols(text.encode())
        starts, total, most = chunk_starts(len(syms)), np.zeros(FILTERS), np.full(FILTERS, -np.inf)
        for at in range(0, len(starts), SLICE):
            own = starts[at : at + SLICE]
            part = self.responses(syms[own[0] : own[-1] + CHUNK])
            edges = np.stack([own - own[0], np.minimum(own - own[0] + CHUNK - WIDTH + 1, len(part))], axis=1).ravel()
            if edges[-1] == len(part):
                edges = edges[:-1]
            pooled = np.maximum(np.maximum.reduceat(part, edges, axis=0)[::2] + self.bias, 0)
            total, most = total + pooled.sum(axis=0), np.maximum(most, pooled.max(axis=0))
        logit = self.offset + self.weights[0] @ (total / len(starts)) + self.weights[1] @ most
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def best_places(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter in each chunk, and where it is."""
    found = []
    for at in range(0, len(chunks), SLICE):
        z = net.responses(chunks[at : at + SLICE])
        best = z.argmax(axis=1)
        found.append((np.take_along_axis(z, best[:, None], axis=1)[:, 0], best))
    most, best = zip(*found, strict=True)
    return np.concatenate(most), np.concatenate(best)


def train(texts: list[bytes], labels: list[int], seed: int = 0) -> Network | None:
    """A network fitted to whole documents; None if there is not one of each label."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    whole = [symbols(raw) for raw in texts]
    starts = [chunk_starts(len(syms)) for syms in whole]
    chunks = np.stack([np.resize(syms[s : s + CHUNK], CHUNK) for syms, own in zip(whole, starts, strict=True) for s in own])  # shorter texts start again
    y = np.array(labels, np.float32)
    number = np.array([len(own) for own in starts])
    first = np.cumsum(number) - number
    net = Network(
        (rng.normal(size=(WIDTH, SYMBOLS, FILTERS)) * 0.1).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        (rng.normal(size=(2, FILTERS)) * 0.1).astype(np.float32),
        float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))),
    )
    values = [net.filters, net.bias, net.weights, np.array([net.offset], np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(texts) // BATCH)))):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            docs, step = order[at : at + BATCH], step + 1
            rows = np.concatenate([np.arange(first[d], first[d] + number[d]) for d in docs])
            part = np.repeat(np.arange(len(docs)), number[docs])
            seen = chunks[rows]
            pooled, best = best_places(net, seen)
            pooled = pooled + net.bias
            active = pooled > 0
            pooled *= active
            share = 1 / number[docs].astype(np.float32)
            mean = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(mean, part, pooled)
            mean *= share[:, None]
            most = np.full((len(docs), FILTERS), -1, np.float32)
            np.maximum.at(most, part, pooled)
            p = 1 / (1 + np.exp(-np.clip(values[3][0] + mean @ net.weights[0] + most @ net.weights[1], -30, 30)))
            slope = ((p - y[docs]) / len(docs)).astype(np.float32)
            back = slope[part][:, None] * (net.weights[0] * share[part][:, None] + net.weights[1] * (pooled == most[part]))
            back *= active
            grads = [np.zeros_like(v) for v in values]
            columns = np.broadcast_to(np.arange(FILTERS), best.shape)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (np.take_along_axis(seen, best + j, axis=1), columns), back)
            grads[1] = back.sum(axis=0)
            grads[2] = np.stack([slope @ mean, slope @ most])
            grads[3] = slope.sum(keepdims=True)
            for value, grad, (m, v) in zip(values, grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * value)
    net.offset = float(values[3][0])
    return net


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """Whole text and quality of at most ``rows`` labelled documents with at most ``most`` bytes in all.

    The documents are the first in the order of their ids' hashes, without any that would go
    over the bytes; held-out ones never take part. Of several rows of one doc_id one is taken.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    order = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order).limit(rows)
    # At most ``rows`` rows of two numbers are broadcast.
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = staged(found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled-texts")
    sizes = one.select("doc_id", F.octet_length("text").alias("n"), order.alias("order")).collect()
    ids, total = [], 0
    for row in sorted(sizes, key=lambda r: r["order"]):
        if total + row["n"] <= most:
            ids.append(row["doc_id"])
            total += row["n"]
    texts = one.where(F.col("doc_id").isin(ids)).select("doc_id", "text", "quality").collect()
    return [(r["text"].encode(), r["quality"]) for r in sorted(texts, key=lambda r: r["doc_id"])]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Network | None:
    sample = training_rows(docs, labels, rows, most)
    return train([raw for raw, _ in sample], [quality for _, quality in sample])


def score_documents(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; narrow, without a shuffle.

    Null text counts as empty, which has a score like any other. Without a network, for want of
    labels, every score is 0.5. Repeated rows and null ids (not held out) are scored row by row.
    Texts have no length limit and are scored whole; an empty table gives an empty result. Other
    columns are left out, so clashing names do no harm.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [0.5 if network is None else network.score(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(by_slices(work), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
