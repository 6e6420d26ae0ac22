"""The pipeline's stages against brute-force versions of each on its own input."""

import random

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality_rules import brute as brute_measures
from tests.llm.test_quality_rules import clean
from tests.llm.test_simhash import classes, near_pairs, plain_fingerprint

KEY = "0123456789abcdef" * 2


def corpus():
    rng = random.Random(4)
    rows = []
    for n in range(60):
        lines = [clean(30, 100 * n + k) for k in range(4)] + ["A licence line that many documents share."] * (n % 3 == 0)
        rng.shuffle(lines)
        rows.append((n, "\n".join(lines), f"src{n % 5}"))
    rows += [(100 + n, rows[n][1], "src1") for n in range(8)]
    rows += [(200 + n, rows[n][1].replace(" ", "  ").upper(), "src2") for n in range(4)]
    rows += [(300 + n, clean(80, 900 + n) + f'\ntoken = "{KEY}{n}"', "src3") for n in range(5)]
    rows += [(400, None, "src0"), (401, "", "src0"), (402, "too short", "src0"), (403, "again and again " * 40, "src0")]
    return rows


def test_stages(docs_of, spark):
    rows = corpus()
    docs, seen = docs_of(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(seen[name], docs.schema)

    def texts(name):
        return sorted((r.doc_id, r.text) for r in seen[name])

    failing = {d for d, t, _ in rows if (m := brute_measures(t))[0] < 50 or 100 * m[4] > 50 * m[0]}
    assert texts("quality_rules") == sorted((d, t) for d, t, _ in rows if d not in failing) and failing == {400, 401, 402, 403}
    lines = [(d, t) for d, t, _, _ in brute_lines(texts("quality_rules"))]
    assert texts("line_dedup") == sorted(lines)
    fps = [plain_fingerprint(t) for _, t in lines]
    label = classes([(lines[a][0], lines[b][0]) for a, b in near_pairs(fps)], [d for d, _ in lines])
    assert texts("simhash_near_dedup") == sorted((d, t) for d, t in lines if label[d] == d)
    assert len(texts("simhash_near_dedup")) < len(lines)
    told = dict(texts("secret_scan"))
    assert all(told[300 + n].endswith('[SECRET]"') and KEY not in told[300 + n] for n in range(5))
    assert all(t == told[d] for d, t in texts("simhash_near_dedup") if KEY not in t)
    assert all(r.n_chars == len(r.text) for r in seen["secret_scan"])
    assert {r.doc_id for r in seen["best_fit_packing"]} == told.keys()


def test_run(spark, small_dir):
    packed = corpus_pipeline.run(spark, small_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() > 0


def test_odd_rows_pass_all_stages(docs_of, spark):
    rows = [(1, clean(60, 1), "a"), (1, clean(60, 1), "a"), (1, clean(60, 2), "a"), (None, clean(60, 1), None), (None, clean(60, 1), None), (2, None, "a"), (3, "", None)]
    docs = docs_of(rows).selectExpr("*", "1 AS n_words", "2 AS findings", "3 AS _row", "4 AS row", "5 AS n_lines", "6 AS kept", "7 AS words", "8 AS length")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = docs.collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, clean(60, 1)), (1, clean(60, 2)), (None, clean(60, 1)), (None, clean(60, 1))], key=str)
    assert {tuple(r)[5:] for r in left} == {(1, 2, 3, 4, 5, 6, 7, 8)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 4


def test_empty_table_passes_all_stages(docs_of, spark):
    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)
