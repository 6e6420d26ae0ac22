import random
import re

import numpy as np
import pytest
import xxhash

from quarrymill.llm.simhash import (
    SHORT_RUN, components, count_planes, fingerprint, forest, link_edges, links_of_long_run, links_of_short_runs, majority, near_duplicates,
    within_radius,
)

MASK = 2**64 - 1


def plain_fingerprint(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_pairs(fps):
    return [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 3]


def clustered(rng, n, centres, flips):
    out = []
    for _ in range(n):
        value = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return list(dict.fromkeys(out))


TEXTS = [None, "", "One", "one two", "ONE two", "one two three four", "É é Été ÉTÉ x", "a\xa0b c\x85d e", "x " * 5000]


def test_fingerprint():
    rng = random.Random(5)
    for text in TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (3, 4, 200)]:
        assert fingerprint(text) & MASK == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(5))
def test_links(seed):
    rng = random.Random(seed)
    fps = clustered(rng, 150, [rng.getrandbits(64) for _ in range(5)], 4)
    array, want = np.array(fps, np.uint64)[:, None], classes(near_pairs(fps), range(len(fps)))
    assert classes(links_of_long_run(array), range(len(fps))) == want
    run = np.sort(np.array([rng.randrange(12) for _ in fps]))
    assert sorted(links_of_short_runs(array, run)) == [(a, b) for a, b in near_pairs(fps) if run[a] == run[b]]
    edges = forest(links_of_long_run(array))
    assert classes(edges, range(len(fps))) == want and len(edges) == len(fps) - len(set(want.values()))


@pytest.mark.parametrize(("n", "centres"), [(400, 30), (6000, 2)])
def test_edges_lose_no_link(spark, n, centres):
    rng = random.Random(n)
    fps = clustered(rng, n, [rng.getrandbits(64) for _ in range(centres)] + [0], 3)
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    label = {r.node: r.component for r in components(link_edges(reps)).collect()}
    array = np.array(fps, np.uint64)[:, None]
    want = classes(links_of_long_run(array), range(len(fps))) if n > 1000 else classes(near_pairs(fps), range(len(fps)))
    assert {i: label.get(i, i) for i in range(len(fps))} == want
    assert n < 1000 or len(fps) > 2048 > SHORT_RUN  # dealt out in sub-blocks


def test_counters_against_plain_counts():
    rng = np.random.default_rng(3)
    for n, lanes in ((1, 1), (2, 3), (7, 2), (500, 2), (5000, 1)):
        rows = rng.integers(0, 2**64, (n, lanes), np.uint64)
        bits = np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(n, -1), axis=1).sum(axis=0, dtype=np.int64)
        planes = count_planes([rows])
        told = sum(np.unpackbits(p.astype(">u8").view(np.uint8)).astype(np.int64) << k for k, p in enumerate(planes))
        assert np.array_equal(told, bits)
        assert np.array_equal(np.unpackbits(majority(rows).astype(">u8").view(np.uint8)), 2 * bits > n)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 36])
def test_within_radius(radius):
    rng = random.Random(radius)
    planes = [rng.getrandbits(200) & rng.getrandbits(200) if rng.random() < 0.5 else 0 for _ in range(128)]
    lanes = rng.getrandbits(200)
    want = sum(1 << i for i in range(200) if lanes >> i & 1 and sum(p >> i & 1 for p in planes) <= radius)
    assert within_radius(iter(planes), lanes, radius) == want


def chain(kind, n):
    order = list(range(n))
    if kind == "reversed":
        order.reverse()
    elif kind == "random":
        random.Random(1).shuffle(order)
    elif kind == "hub":  # every node but the hub is smaller than all its neighbours
        return [(k, n - 1) for k in range(n - 1)]
    elif kind == "zigzag":
        order = [k // 2 if k % 2 == 0 else n - 1 - k // 2 for k in range(n)]
    return [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("kind", ["sorted", "reversed", "random", "hub", "zigzag"])
def test_components_of_long_chains_in_few_rounds(spark, monkeypatch, kind):
    from quarrymill.llm import simhash

    names, plain = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: names.append(name) or plain(df, name))
    edges = spark.createDataFrame([*chain(kind, 1000), (9000, 9001)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {n: 0 for n in range(1000)} | {9000: 9000, 9001: 9000}
    assert names.count("nearest") <= 8 and names.count("labels") <= 30


def test_documents(docs_of):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)) for _ in range(6)]
    rows = [(n, rng.choice(base)) for n in range(60)]
    rows += [(100 + n, b.replace(b[:40], b[5:45], 1)) for n, b in enumerate(base)] + list(enumerate(TEXTS, 200))
    rows += [(None, base[0]), (3, rows[3][1]), (300, "")]
    got = near_duplicates(docs_of(rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    real = [i for i, (d, _) in enumerate(rows) if d is not None]
    pairs = [(a, b) for a, b in near_pairs(fps) if a in real and b in real]
    label = classes([(rows[a][0], rows[b][0]) for a, b in pairs], {rows[i][0] for i in real})
    want = [(d, f - (1 << 64) if f >> 63 else f, label.get(d)) for (d, _), f in zip(rows, fps)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table_and_clashing_columns(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    clash = docs_of([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS rep")
    assert {r.component_id for r in near_duplicates(clash).collect()} == {1}


def test_ids_of_other_types(spark):
    same, other = "one two three four five six", "quite another text with words of its own"
    rows = spark.createDataFrame([("b", same), ("a", same), ("c", other), (None, same), ("d", None)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(rows).collect()} == {("b", "a"), ("a", "a"), ("c", "c"), (None, None), ("d", "d")}
