import time

import pytest

from quarrymill.llm.line_dedup import dedup_lines


def brute(rows, least=10):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    owner = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                owner[key(line)] = min(owner.get(key(line), doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or owner[key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


CASES = [
    (1, "a shared line here\nown words of one\nshort\nshort"),
    (2, "  A SHARED line here\t\nshort\nown words of two\nown words of two"),
    (3, None),
    (4, ""),
    (5, "own words of two\na shared line here"),
    (5, "own words of two\na shared line here"),
    (None, "a shared line here"),
    (6, "Était une ligne longue\n\n\n"),
    (7, "était une ligne longue\nÉTAIT UNE LIGNE LONGUE"),
    (8, "a shared line here\n" * 3000 + "x" * 200_000),
    (9, "x" * 200_000),
]


def test_against_brute_force(docs_of):
    got = dedup_lines(docs_of(CASES)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES)


def test_empty_table_and_clashing_columns(docs_of):
    assert dedup_lines(docs_of([])).count() == 0
    clash = docs_of(CASES[:2]).selectExpr("*", "7 AS n_lines", "7 AS pos", "7 AS block", "7 AS dropped")
    assert {(r.n_lines, r.pos, r.block, r.dropped) for r in dedup_lines(clash).collect()} == {(4, 7, 7, 7)}


def test_keep_runs_rebuild_the_text(docs_of):
    for row in dedup_lines(docs_of(CASES[:3])).collect():
        assert sum(r.length for r in row.keep_runs) == row.n_lines - row.n_dropped


@pytest.mark.parametrize("least", [1, 40])
def test_other_minimum(docs_of, least):
    got = dedup_lines(docs_of(CASES), least).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == brute(CASES, least)


def test_text_of_many_separate_runs_takes_linear_time(docs_of):
    def seconds(n):
        rows = [(1, "a line that both documents share"), (2, "\n".join(f"own line number {k}" if k % 2 else "a line that both documents share" for k in range(n)))]
        began = time.perf_counter()
        got = {r.doc_id: r.n_dropped for r in dedup_lines(docs_of(rows)).collect()}
        assert got == {1: 0, 2: n // 2}
        return time.perf_counter() - began

    seconds(10)
    small, large = seconds(16_000), seconds(128_000)
    assert large < 8 * small + 5
