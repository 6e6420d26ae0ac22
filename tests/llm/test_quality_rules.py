import random
import re
from collections import Counter

import pytest

from quarrymill.llm.quality_rules import keep_good, measure_text, quality_verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(lines),
    )


TEXTS = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n  \n", "é\xa0ü z #*<| 𝄞", "a\x1cb \x85c\x0bd\x0ce"]


@pytest.mark.parametrize("seed", range(4))
def test_measures(seed):
    rng = random.Random(seed)
    some = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 60, 2000]))) for _ in range(20)]
    some += ["\n".join(rng.choice(["one line", "two | lines", " ", "é#"]) for _ in range(40))]
    for text in TEXTS + some:
        assert measure_text(text) == brute(text)


def clean(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def junk(n):
    return clean(80, n).replace(" ", "&&& ")


def test_host_verdicts_reject_soft_failures_on_bad_hosts_only(docs_of):
    rows = [(n, junk(n), "bad") for n in range(40)] + [(100 + n, clean(80, n), "bad") for n in range(5)]
    rows += [(200 + n, clean(80, n), f"good{n % 4}") for n in range(80)] + [(300, junk(300), "good1"), (301, junk(301), "tiny")]
    rows += [(400, None, "good1"), (401, "short", None), (402, clean(60, 402), None), (None, clean(60, 1), "good2"), (200, clean(80, 0), "good0")]
    got = quality_verdicts(docs_of(rows)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.kept}
    # These hosts differ so much that the prior weighs little: even the host of one junk document is flagged.
    assert kept == {d for d, _, _ in rows} - set(range(40)) - {301, 400, 401}
    assert {r.doc_id for r in got if r.base_failed} == {400, 401}
    good = keep_good(docs_of(rows))
    assert good.columns == docs_of(rows).columns
    assert {r.doc_id for r in good.collect()} == kept


def test_host_with_several_times_the_usual_rate_is_flagged(docs_of):
    """Rates as they are met: most hosts fail about 4 % by chance, one 20 %."""
    rows, bad = [], set()
    for host in range(12):
        for n in range(100):
            doc = 1000 * host + n
            failing = n < (20 if host == 0 else 3 + host % 3)
            bad |= {doc} if failing and host == 0 else set()
            rows.append((doc, junk(doc) if failing else clean(80, doc), f"host{host}"))
    assert {r.doc_id for r in quality_verdicts(docs_of(rows)).collect() if not r.kept} == bad
    alike = [(d, t, s) for d, t, s in rows if s != "host0"]  # what is left differs by chance only
    assert all(r.kept for r in quality_verdicts(docs_of(alike)).collect())


def test_empty_table_and_clashing_columns(docs_of):
    assert quality_verdicts(docs_of([])).count() == 0 and keep_good(docs_of([])).count() == 0
    clash = docs_of([(1, clean(80, 1))]).selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS flags", "4 AS docs")
    row = keep_good(clash).first()
    assert (row.n_words, row.kept, row.flags, row.docs) == (1, 2, 3, 4)
