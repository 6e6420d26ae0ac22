import hashlib
import random

import pytest

from quarrymill.llm.chat import (
    TEMPLATE, Const, Output, TemplateError, compile_template, digests, escape, fold_block, format_conversations, parse, read_back, unescape,
)

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "###", "\\###", "</turn>", r"\### Assistant: </turn> ok", "#### x", "## # </turn", "\\\\</turn>\n### user: hi</turn>\n", "a: b", "é𝄞"]


def test_escape_round_trip():
    rng = random.Random(2)
    for text in NASTY + ["".join(rng.choice(["\\", "#", "###", "</turn>", "<", "/turn>", "x", "\n", ": "]) for _ in range(12)) for _ in range(500)]:
        assert unescape(escape(text)) == text
        turns = [{"role": "user", "text": text}, {"role": "assistant", "text": text + "!"}]
        formatted, masked = compile_template(TEMPLATE)(turns)
        assert read_back(formatted) == [("user", text), ("assistant", text + "!")]
        assert [unescape(formatted[a:b]) for a, b in masked] == [text + "!"]


def test_roles_that_hold_control_strings():
    rng = random.Random(5)
    for role in ["a: b", ": ", ":", "a:", "\\: ", "x:: y", "###: "] + ["".join(rng.choice(["\\", "#", "###", "</turn>", "<", ":", " ", ": ", "x"]) for _ in range(8)) for _ in range(500)]:
        formatted, _ = compile_template(TEMPLATE)([{"role": role, "text": " : x: y"}, {"role": "assistant", "text": role}])
        assert read_back(formatted) == [(role, " : x: y"), ("assistant", role)]


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, 1, "user", "z"), (None, 2, "a: b", "y"), (None, 2, "a: b", "y"), (3, 0, "a: b", "w")]
    got = digests(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(c, 1, sha(f"{role}\n{text}\n")) for c, _, role, text in rows]
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256) for r in got), key=str) == sorted(want, key=str)


def test_other_id_types(spark):
    rows = spark.createDataFrame([("c1", 0, "user", "x")], "conv_id string, turn long, role string, text string")
    assert digests(format_conversations(rows)).first().conv_id == "c1"


def test_language():
    run = lambda source, turns=(): compile_template(source)(list(turns))[0]
    assert run("a{{ 'b' + \"c\" | upper }}{{ 1 + 2 }}{{ none }}{{ [1, 2] | length }}") == "abC32"
    assert run("{% for t in turns %}{% if t.role == 'a' %}A{% elif t.role != 'b' and not (t.x or false) %}C{% else %}B{% endif %}{% endfor %}", [{"role": r} for r in "abc"]) == "ABC"
    assert run("{% for t in turns %}{{ t.text | trim | lower }};{% endfor %}", [{"text": " X "}]) == "x;"
    assert compile_template("x{% generation %}y{{ 'z' }}{% endgeneration %}w")([]) == ("xyzw", [(1, 3)])


def test_constants_fold():
    assert fold_block(parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ nothing.x }}{% endif %}")) == (Output(Const("abcd")),)


@pytest.mark.parametrize(
    "bad",
    ["{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ }}", "{{ a b }}", "{{ a | nosuch }}", "{{ a.__class__ }}", "{% import os %}",
     "{{ open('x') }}", "{% else %}", "{{ 'a }}", "{% for t in turns %}{% endif %}"],
)
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


@pytest.mark.parametrize("bad", ["{{ turns.append }}", "{{ 'a' + 1 }}", "{% for x in 'abc' %}{% endfor %}", "{{ turns }}"])
def test_sandbox_at_run_time(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)([{"role": "user"}])


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(NASTY) * rng.randint(1, 3)) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(100, 1, "assistant", None), (100, 0, None, "x"), (101, 0, "user", "b"), (101, 0, "user", "a"), (101, 0, "user", "a"), (None, 0, "user", "z")]
    rows += [(102, None, "assistant", "y" * 300_000), (102, 1, "user", "###" * 50_000)]
    got = {r.conv_id: r for r in digests(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    assert got.keys() == by.keys()


def test_empty_table_and_clashing_columns(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA).selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS t")
    assert digests(format_conversations(clash)).count() == 1
