import math
import random
import zlib

import numpy as np

import pytest

from quarrymill.llm.quality_cnn import CHUNK, FILTERS, SYMBOLS, WIDTH, Network, chunk_starts, fit, score_documents, symbols, training_rows


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return prose(rng, n).replace(" ", "&&& ")
    if kind == 1:
        return prose(rng, n).upper().replace(" ", "!! ")
    return " ".join(w for w in prose(rng, max(1, n // 12)).split() for _ in range(12))


def corpus(n, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for doc in range(n):
        good = rng.random() < 0.7
        rows.append((doc, (prose if good else junk)(rng, rng.choice([20, 90, 700]))))
        labels.append((doc, int(good), 0))
    return rows, labels


def test_symbols_flag_repeats_only():
    rng = random.Random(1)
    flags = symbols(b"The The The The The The The ") >= 256
    assert not flags[:4].any() and flags[4:20].all()
    assert (symbols(prose(rng, 200).encode()) < 256).mean() > 0.99 and symbols(b"ab").tolist() == [97, 98, 0, 0, 0, 0]


def plain_score(net, text):
    """The network written out: every filter at every place of every chunk."""
    raw = symbols(text.encode())
    pooled = []
    for start in chunk_starts(len(raw)).tolist():
        chunk = raw[start : start + CHUNK]
        responses = [sum(net.filters[j, chunk[at + j]].astype(float) for j in range(WIDTH)) + net.bias for at in range(len(chunk) - WIDTH + 1)]
        pooled.append(np.maximum(np.max(responses, axis=0), 0))
    logit = net.offset + net.weights[0] @ np.mean(pooled, axis=0) + net.weights[1] @ np.max(pooled, axis=0)
    return 1 / (1 + math.exp(-logit))


def test_score_against_plain_convolution():
    rng = np.random.default_rng(5)
    net = Network(rng.normal(size=(WIDTH, SYMBOLS, FILTERS)).astype(np.float32), rng.normal(size=FILTERS).astype(np.float32), rng.normal(size=(2, FILTERS)).astype(np.float32) * 0.1, 0.3)
    words = random.Random(5)
    for text in ("", "é", "abcdef", prose(words, 90), "x" * CHUNK, "x" * (CHUNK + 1), prose(words, 600), prose(words, 9000)):
        assert net.score(text) == pytest.approx(plain_score(net, text), abs=1e-4)


def test_training_sample_is_bounded_and_whole(docs_of, spark):
    rows, labels = corpus(60)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = {t.encode() for _, t in rows}
    every = training_rows(docs_of(rows), table)
    assert {raw for raw, _ in every} <= texts and len(every) == sum(zlib.crc32(str(d).encode()) % 4 != 2 for d, _ in rows)
    some = training_rows(docs_of(rows), table, most=20_000)
    assert 0 < sum(len(raw) for raw, _ in some) <= 20_000 and {raw for raw, _ in some} <= texts
    assert len(training_rows(docs_of(rows), table, rows=7)) == 7


def test_chunks_cover_the_text():
    for n in (0, 1, CHUNK, CHUNK + 1, 5000, 66_000):
        starts = chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + CHUNK >= n and (np.diff(starts) < CHUNK).all()
        assert n <= CHUNK or starts[-1] + CHUNK == n


def test_junk_far_inside_a_long_text_counts(docs_of, spark):
    rows, labels = corpus(500)
    network = fit(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rng = random.Random(8)
    text = prose(rng, 9000)
    assert network.score(text) > network.score(text[:30_000] + junk(rng, 3000) + text[30_000:])


def test_held_out_accuracy_and_cases(docs_of, spark):
    rows, labels = corpus(800)
    table = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (2, labels[2][1], 0)], "doc_id long, quality int, toxic int")
    network = fit(docs_of(rows), table)
    more = [(9001, None), (9002, ""), (9003, "é"), (9004, prose(random.Random(3), 40_000)), (None, rows[0][1]), (0, rows[0][1])]
    got = score_documents(docs_of(rows + more), network).collect()
    assert len(got) == 806 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {doc: quality for doc, quality, _ in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert {r.score for r in got if r.doc_id in (9001, 9002)} == {network.score("")}


def test_held_out_labels_never_matter(docs_of, spark):
    rows, labels = corpus(120)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (fit(docs_of(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert np.array_equal(a.filters, b.filters) and a.offset == b.offset


def test_no_labels_and_empty_table(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit(docs_of([(1, "x")]), none) is None
    assert [(r.score, r.predicted) for r in score_documents(docs_of([(1, "x")]), None).collect()] == [(0.5, 0)]
    assert score_documents(docs_of([]), None).count() == 0
    clash = docs_of([(1, "x")]).selectExpr("*", "1 AS score", "2 AS quality", "3 AS chunks")
    assert score_documents(clash, fit(clash, none)).count() == 1
