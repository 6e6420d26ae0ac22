"""The pipeline's near-duplicate stage against all pairs' exact Jaccard similarity."""

import random
from collections import Counter

import corpus_pipeline
import pytest

import numpy as np

from quarrymill.llm import similar
from quarrymill.llm.similar import drop_similar, links_of_sets, shingle_set, similar_groups, simhash_words, table_keys, table_sizes
from tests.llm.test_simhash import classes, plain_fingerprint


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(texts):
    sets = [shingles(t) for t in texts]
    return [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, groups, copies, edits, length=200):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(length))
        rows += [base] + [edited(rng, base, rng.randint(0, edits)) for _ in range(copies)]
    rng.shuffle(rows)
    return rows + ["", "  ", "a b", "A  b", "a b c d e", "a b c d f"]


@pytest.mark.parametrize(("groups", "copies", "edits"), [(30, 3, 9), (2, 100, 6), (1, 150, 14)])
def test_stage_equals_brute_force(docs_of, spark, groups, copies, edits):
    texts = corpus(groups, groups, copies, edits)
    pairs = similar_pairs(texts)
    label = classes(pairs, range(len(texts)))
    left = corpus_pipeline.drop_near_duplicates(spark, docs_of(list(enumerate(texts))), "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted((d, texts[d]) for d in set(label.values()))
    far = [(a, b) for a, b in pairs if (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 3]
    assert len(far) > 10  # that the three bits of op5 miss


def test_repeated_ids_and_empty_table(docs_of):
    one, two = (" ".join(f"{c}{n}" for n in range(40)) for c in "xy")
    rows = [(1, one), (2, two), (2, one), (3, two), (3, "other words that nothing else has"), (4, None), (4, ""), (None, one), (None, one)]
    left = Counter((r.doc_id, r.text) for r in drop_similar(docs_of(rows)).collect())
    empty = left.pop((4, None), 0) + left.pop((4, ""), 0)
    assert empty == 1
    assert left == {(1, one): 1, (2, two): 1, (3, "other words that nothing else has"): 1, (None, one): 2}
    assert drop_similar(docs_of([])).count() == 0 == similar_groups(docs_of([])).count()


def test_tables_find_pairs_at_the_limit():
    """Recall of the tables for sets of every size at a similarity of 0.8, the lowest that counts."""
    rng = np.random.default_rng(2)
    bits, tables = table_sizes(10_000)
    words = similar.WORDS + -(-bits * tables // 64)
    found, beyond, pairs = 0, 0, 0
    for n in (9, 18, 45, 90, 450):
        for _ in range(60):
            common, own = rng.integers(0, 2**64, 8 * n // 9, np.uint64), rng.integers(0, 2**64, (2, n // 9), np.uint64)
            a, b = (simhash_words(np.concatenate([common, o]), words) for o in own)
            near = np.bitwise_count(a[: similar.WORDS] ^ b[: similar.WORDS]).sum() <= similar.RADIUS
            keys = [set(table_keys(x[similar.WORDS :], bits, tables).tolist()) for x in (a, b)]
            found, beyond, pairs = found + (near and bool(keys[0] & keys[1])), beyond + (not near), pairs + 1
    assert found / pairs >= 0.97 and beyond / pairs <= 0.01
    for rows in (1 << 20, 1 << 34):  # the recall stays as keys grow with the rows
        bits, tables = table_sizes(rows)
        assert (1 - similar.AGREE**bits) ** tables <= similar.MISS and rows / 2**bits <= 4.01


def test_links_of_sets_against_brute_force():
    rng = random.Random(3)
    texts = [t for t in corpus(5, 4, 12, 9) if t.strip()]
    labels = np.array([rng.randrange(6) for _ in texts])
    got = classes(links_of_sets([shingle_set(t) for t in texts], labels), range(len(texts)))
    assert got == classes([(a, b) for a, b in similar_pairs(texts) if labels[a] != labels[b]], range(len(texts)))


def test_large_family_is_dealt_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(similar, "PART_SETS", 20)
    texts = corpus(8, 1, 120, 12)
    label = classes(similar_pairs(texts), range(len(texts)))
    assert sorted(r.doc_id for r in drop_similar(docs_of(list(enumerate(texts)))).collect()) == sorted(set(label.values()))


def test_clashing_columns_and_long_text(docs_of):
    clash = docs_of([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x " * 300_000)]).selectExpr("*", "1 AS node", "2 AS words", "3 AS row", "4 AS component")
    assert sorted((r.doc_id, r.node, r.words, r.row, r.component) for r in drop_similar(clash).collect()) == [(1, 1, 2, 3, 4), (3, 1, 2, 3, 4)]
