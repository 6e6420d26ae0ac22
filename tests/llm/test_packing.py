import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
import tokenizers

from quarrymill.llm.packing import CapacityTree, cut, pack_documents, plan_packing, public_vocabulary

VOCABULARY, PATTERN = public_vocabulary()


def expand(plan, counts):
    """(length, sequence, offset) of each piece."""
    out = []
    for length, count in counts.items():
        rows = [i for i, n in enumerate(plan.length) if n == length]
        for rank in range(count):
            step = max(i for i in rows if plan.rank[i] <= rank)
            out.append((length, int(plan.first[step] + rank - plan.rank[step]), int(plan.offset[step])))
    return out


def best_fit(lengths, size):
    """Sequences that plain best fit decreasing opens."""
    open_bins, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(open_bins, length)
        if at == len(open_bins):
            n += 1
            insort(open_bins, size - length)
        else:
            insort(open_bins, open_bins.pop(at) - length)
    return n


def check_gapless(places, size):
    by = defaultdict(list)
    for length, sequence, offset in places:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [10, 50, 64, 100, 2048])
def test_plan_equals_best_fit_decreasing(size):
    for seed in range(120):
        rng = random.Random(seed)
        lengths = [min(size - 1, 1 + int(rng.expovariate(rng.choice([2, 4, 8]) / size))) for _ in range(rng.choice([1, 40, 300]))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = plan_packing(counts, size)
        places = expand(plan, counts)
        assert len(places) == len(lengths)
        assert check_gapless(places, size) == plan.sequences == best_fit(lengths, size), seed


@pytest.mark.parametrize(
    ("counts", "size", "sequences"),
    [({55: 2, 20: 2, 15: 3}, 100, 2), ({1126: 1000, 410: 1000, 307: 1500}, 2048, 1000), ({70: 3, 12: 4, 5: 5, 1: 9}, 100, 3)],
)
def test_plan_refills_the_sequence_just_used(counts, size, sequences):
    plan = plan_packing(counts, size)
    assert plan.sequences == sequences == best_fit([n for n, count in counts.items() for _ in range(count)], size)
    assert check_gapless(expand(plan, counts), size) == sequences


def test_plan_of_few_lengths_equals_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(300):
        size = rng.choice([50, 100, 2048])
        counts = {rng.randint(1, size - 1): rng.randint(1, 12) for _ in range(rng.randint(1, 6))}
        plan = plan_packing(counts, size)
        places = expand(plan, counts)
        want = best_fit([n for n, count in counts.items() for _ in range(count)], size)
        assert len(places) == sum(counts.values()) and check_gapless(places, size) == plan.sequences == want


def test_capacity_tree():
    tree = CapacityTree(8)
    assert tree.tightest(1) is None and tree.tightest(8) is None
    for capacity in (3, 6, 8):
        tree.mark(capacity, True)
    assert [tree.tightest(n) for n in range(9)] == [3, 3, 3, 3, 6, 6, 6, 8, 8]
    tree.mark(8, False)
    assert tree.tightest(7) is None


def test_cut():
    assert cut(5, 5) == [(0, 5)] and cut(1, 5) == [(0, 1)] and cut(12, 5) == [(0, 2), (2, 5), (7, 5)]


def test_documents(docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé ñ\n#1") for _ in range(rng.randint(1, 9)))
    rows = [(n, " ".join(word() for _ in range(rng.choice([3, 30, 300, 2500])))) for n in range(60)]
    rows += [(60, None), (61, ""), (62, "<|endoftext|> x"), (64, "ab<|endoftext|>" * 900 + "<|endoftext"), (65, "<|endoftext|>"), (63, "a" * 9000), (None, "one two"), (None, "one two"), (5, rows[5][1])]
    got = pack_documents(docs_of(rows), VOCABULARY, PATTERN, with_ids=True).collect()
    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    want = []
    for doc, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for number, (start, n) in enumerate(cut(len(ids), 2048)):
            own = np.array(ids[start : start + n], "<u4")
            want.append((doc, number, start, n, zlib.crc32(own.tobytes()), own.tolist()))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=str) == sorted(want, key=str)
    used = check_gapless([(r.length, r.sequence_id, r.offset) for r in got], 2048)
    assert used == best_fit([r.length for r in got], 2048)


def test_empty_table_and_clashing_columns(docs_of):
    assert pack_documents(docs_of([]), VOCABULARY, PATTERN).count() == 0
    clash = docs_of([(1, "x y")]).selectExpr("*", "1 AS rank", "2 AS length", "3 AS row", "4 AS bucket")
    assert pack_documents(clash, VOCABULARY, PATTERN).count() == 1
