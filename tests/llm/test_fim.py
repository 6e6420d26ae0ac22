import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.llm.fim import BLOCK, Settings, SparseIndex, Units, fill_in_middle, restored, transform

import numpy as np

TEXT = st.text(st.sampled_from("abZ 9.\n\x00éß𝄞漢<PSM>"), max_size=40)


def plain_version(text, name, seed=1):
    """Contract, word by word."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(-5, 10**12))
def test_equals_the_plain_version(text, doc):
    n, form, pre, mid, out = transform(text.encode(), str(doc))
    assert (n, form, pre, mid, out.decode()) == plain_version(text, doc)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_converts_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = SparseIndex(data)
    for chars in range(len(text) + 1):
        place = len(text[:chars].encode())
        assert index.to_bytes(chars) == place and index.to_chars(place) == chars


def test_units_across_blocks():
    text = ("a" * (BLOCK - 1) + "é" + "bc " * 40_000 + "漢") * 2
    units = Units(np.frombuffer(text.encode(), np.uint8))
    found = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    assert units.n == len(found)
    for n in [0, 1, 2, 3, 30_000, len(found) // 2, len(found) - 1, len(found)]:
        assert units.to_bytes(n) == len(text[: found[n] if n < len(found) else len(text)].encode())


def test_cuts_between_code_points():
    seen = set()
    for doc in range(200):
        n, form, pre, mid, out = transform("añ𝄞漢bc".encode(), str(doc), Settings(unit="char"))
        assert n == 6
        if form == "psm":
            text = out.decode()
            assert text.index("<S>") == 3 + pre and len(text) - text.index("<M>") - 3 == mid
            seen.add((pre, mid))
    assert len(seen) > 10


def test_odd_rows(spark):
    schema = "doc_id long, text string, n string, form int, output array<int>"
    long = "añ " * 300_000
    texts = [None, "", "<P>", "a<M>b", "<", "<<", "x<P", "\x00\x00", long, "same", "same"]
    rows = [(n // 2 if text == "same" else n, text, "x", 1, [1]) for n, text in enumerate(texts)] + [(None, "no id here", None, None, None)]
    got = fill_in_middle(spark.createDataFrame(rows, schema)).withColumn("back", restored()).collect()
    want = [(doc, *plain_version(text or "", "" if doc is None else doc)) for doc, text, *_ in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.back for r in got) == sorted(text or "" for _, text, *_ in rows)
    empty = fill_in_middle(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_other_id_types_and_forms(spark):
    rows = spark.createDataFrame([(f"d{n}", "word, word; word é 1.") for n in range(400)], "doc_id string, text string")
    got = fill_in_middle(rows).withColumn("back", restored())
    assert got.where(F.col("back") != "word, word; word é 1.").count() == 0
    forms = {r.form: r["count"] for r in got.groupBy("form").count().collect()}
    assert 20 < forms["plain"] < 70 and 40 < forms["spm"] < 110 and forms["psm"] > 200
