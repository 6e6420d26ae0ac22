import random
import re

import numpy as np
import pytest

from quarrymill.llm import pii

PLAIN = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: 16 <= len(re.sub("[^0-9]", "", v)) <= 19 and pii.luhn(re.sub("[^0-9]", "", v))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
)


def brute(text):
    return [(k, *m.span()) for k, (pattern, good) in enumerate(PLAIN) for m in pattern.finditer(text or "") if good(m[0])]


@pytest.fixture(scope="module")
def tagger():
    return pii.trained_tagger()


def test_base_spans():
    rng = random.Random(6)
    bits = ["a@b.c", "@", ".", "x", "-", "+", " ", "1", "255", "256", "4111 1111 1111 1111", "@d-e.f_g@h.i", "+1 (017) 555-7713", "é", "0", "001.002.003.004", ") ", "((", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_base_spans_of_long_runs_are_quick():
    for text in ("a" * 300_000 + " @x", "1" * 300_000, "+1" + " (" * 150_000, "1 " * 150_000, "a@" * 100_000, "1.2.3." * 50_000):
        pii.base_spans(text)


def test_windows_cover_every_character():
    for n in (1, 2, pii.STEP, pii.WINDOW, pii.WINDOW + 1, pii.STEP + pii.WINDOW, 700, 5000, 100_000):
        starts = pii.windows(n)
        assert starts[0] == 0 and starts[-1] + pii.WINDOW >= n and len(set(starts)) == len(starts)
        assert all(0 < b - a <= pii.STEP for a, b in zip(starts, starts[1:])) and (n < pii.WINDOW or starts[-1] + pii.WINDOW == n)


def test_codes():
    text = "aZ0@ é漢٣𝄞\u2028\U000e0001"
    assert pii.codes(text).tolist() == [ord(c) if c < "\x80" else 128 if c.isalpha() else 129 if c.isdigit() else 130 for c in text]


def test_decoding_against_all_paths():
    """Viterbi, certainty and the proof that all is outside, against every path of short windows."""
    rng, n = np.random.default_rng(4), 4
    paths = np.array(np.meshgrid(*[range(pii.TAGS)] * n, indexing="ij")).reshape(n, -1)
    proven = 0
    for trial in range(40):
        tagger = pii.Tagger(trial)
        tagger.values["move"] = rng.normal(size=(pii.TAGS + 1, pii.TAGS)).astype(np.float32)
        e = rng.normal(size=(n, 1, pii.TAGS)).astype(np.float32) * 2
        e[:, :, 0] += rng.uniform(0, 8)
        move = tagger.values["move"] + pii.FORBIDDEN
        score = move[pii.TAGS, paths[0]] + sum(e[t, 0, paths[t]] for t in range(n)) + sum(move[paths[t - 1], paths[t]] for t in range(1, n))
        best = paths[:, score.argmax()]
        tags = tagger.viterbi(e)
        assert tags[0].tolist() == best.tolist()
        if tagger.surely_outside(e)[0]:
            proven += 1
            assert not best.any()
        odds = np.exp(score.astype(np.float64) - score.max())
        same = [odds[(paths[t] + 1) // 2 == (best[t] + 1) // 2].sum() / odds.sum() for t in range(n)]
        assert tagger.certainty(e, tags)[0] == pytest.approx(same, abs=1e-4)
    assert 5 < proven < 40


def test_short_windows_beside_long_ones(tagger):
    """Padding changes nothing: each text decodes as by itself."""
    rng = random.Random(12)
    texts = [pii.sample_sentence(rng, n)[0][:n] for n in (3, 40, 41, 200, 200)]
    lengths = np.array([len(t) for t in texts])
    x = np.zeros((len(texts), lengths.max()), np.uint8)
    for row, text in enumerate(texts):
        x[row, : len(text)] = pii.codes(text)
    tags, sure = tagger.decode(x, lengths)
    for row, text in enumerate(texts):
        own, certain = tagger.decode(x[row : row + 1, : len(text)], lengths[row : row + 1])
        assert np.array_equal(tags[row, : len(text)], own[0]) and not tags[row, len(text) :].any()
        spans = own[0] > 0
        assert sure[row, : len(text)][spans] == pytest.approx(certain[0][spans], abs=1e-3)


def test_gradients():
    tagger, rng = pii.Tagger(3), random.Random(1)
    tagger.values = {k: v.astype(np.float64) for k, v in tagger.values.items()}
    x, y = pii.labelled_batch(rng, 3, 40)
    _, grads = tagger.gradients(x, y)
    for name, value in tagger.values.items():
        flat, grad = value.reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(grad))[:3]:
            old, losses = flat[at], []
            for step in (1e-3, -1e-3):
                flat[at] = old + step
                losses.append(tagger.gradients(x, y)[0])
            flat[at] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[at], rel=0.05, abs=2e-3)


def test_held_out_spans(tagger):
    rng, right, wanted, given = random.Random(99), 0, 0, 0
    for _ in range(120):
        text, tags = pii.sample_sentence(rng, 150)
        tags = np.array(tags)
        want = {s[:3] for s in pii.tagged_spans(tags, np.ones(len(tags)))}
        found, sure = tagger.decode(pii.codes(text)[None], np.array([len(text)]))
        got = {s[:3] for s in pii.tagged_spans(found[0], sure[0])}
        right, wanted, given = right + len(want & got), wanted + len(want), given + len(got)
    assert right / wanted >= 0.85 and right / given >= 0.85


NAMES = ["maria", "jorge", "liesel", "o-brien", "chen", "fatima"]


def other_value(rng, kind):
    """Personal data in forms of a second generator, whose shapes the training has only in part."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        return f"{rng.choice(NAMES)}.{rng.choice(NAMES)}{rng.choice(['', d(1), d(4)])}@{rng.choice(['acme-tools.io', 'uni.example.edu', 'post.example.net', 'web.de'])}"
    if kind == 1:
        return f"{rng.choice([10, 172, 192])}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}"
    if kind == 2:
        return f"{rng.choice(['5100', '4929', '6011'])} {d(4)} {d(4)} {d(4)}"
    return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.randint(30, 49)} {d(3)} {d(3)} {d(4)}"])


OTHER_TEXT = "The parcel went out on Monday; please write to {} before noon. Our records of 2019 list room 14, item 7731 and {} as well. Nothing else was found in chapter 3."


def recall_on_other_forms(tagger):
    rng, found, wanted = random.Random(31), [0] * 4, [0] * 4
    for _ in range(300):
        kinds = rng.randrange(4), rng.randrange(4)
        values = [other_value(rng, k) for k in kinds]
        text = OTHER_TEXT.format(*values)
        tags, sure = tagger.decode(pii.codes(text)[None], np.array([len(text)]))
        got = {(k, a, b) for k, a, b, c in pii.tagged_spans(tags[0], sure[0])}
        for kind, value in zip(kinds, values):
            wanted[kind] += 1
            found[kind] += (kind, text.index(value), text.index(value) + len(value)) in got
    return [f / w for f, w in zip(found, wanted)]


def test_recall_on_a_second_generator(tagger):
    """By the network alone, without the base patterns; exact spans only."""
    assert min(recall_on_other_forms(tagger)) >= 0.5 and sum(recall_on_other_forms(tagger)) / 4 >= 0.75


def test_model_adds_spans_and_keeps_the_base(tagger):
    text = "abc " * 500 + "call (017) 555-7713 today or mail jo.doe@mail7.example.com, see +1 (017) 555-7713. " + "xyz " * 300
    [(base, spans)] = pii.find_all([text], tagger)
    assert base == brute(text) and set(base) < set(spans)
    assert [text[a:b] for k, a, b in spans if (k, a, b) not in base] == ["(017) 555-7713"]
    rng = random.Random(5)
    clean = " ".join("".join(rng.choice("etaoinshrdlubmp") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    assert pii.find_all([clean, "", "x"], tagger) == [([], [])] * 3


def test_card_numbers_need_their_check_digit():
    good, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    found = [(2, 0, 19, 0.99), (2, 20, 39, 0.99)]
    assert pii.reconcile(f"{good} {bad}", found, []) == [(2, 0, 19)]


def test_model_emails_need_an_at_sign_and_short_cards_their_first_digits():
    assert pii.reconcile("the.*** a@b", [(0, 0, 7, 0.99), (0, 8, 11, 0.99)], []) == [(0, 8, 11)]
    timestamp, diners = "20231105123456", "30569309025904"
    assert pii.luhn(timestamp) and pii.luhn(diners)
    assert pii.reconcile(f"{timestamp} {diners}", [(2, 0, 14, 0.99), (2, 15, 29, 0.99)], []) == [(2, 15, 29)]


def test_reconcile_over_windows():
    text = "x" * 400 + "a" * 30 + "@b.co" + "x" * 400
    halves = [(0, 400, 420, 0.95), (0, 410, 435, 0.99), (0, 400, 435, 0.97), (3, 405, 415, 0.91), (2, 600, 610, 0.5)]
    assert pii.reconcile(text, halves, []) == [(0, 400, 435)]
    assert pii.reconcile(text, halves, [(0, 430, 440)]) == [(3, 405, 415)]


def test_documents(docs_of, tagger):
    rows = [(1, "mail a@b.co 𝄞 1.2.3.4"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (1, "mail a@b.co 𝄞 1.2.3.4"), (4, "z " * 100_000 + "1.2.3.4")]
    got = pii.find_personal_data(docs_of(rows), tagger).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in got), key=str) == sorted(((d, brute(t)) for d, t in rows), key=str)
    assert pii.find_personal_data(docs_of([]), tagger).count() == 0
    assert pii.find_personal_data(docs_of([(1, "x")]).selectExpr("*", "1 AS base", "2 AS spans"), tagger).count() == 1
