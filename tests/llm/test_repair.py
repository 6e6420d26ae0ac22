import hashlib
import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import queries, repair
from quarrymill.llm.repair import applied, cheapest, damaged, repair_conversations

SYMBOLS = [(initial, doomed, cut) for initial in ("s", "u", "a", "") for doomed, cut in ((False, False), (False, True), (True, False))]
SCHEMA = "conv_id long, turn long, role string, text string"


def is_legal(roles):
    left = roles[1:] if roles[:1] == "s" else roles
    return not roles or (left != "" and left == "ua" * (len(left) // 2))


def by_trying_all(symbols):
    """Every edit of every row with up to three inserts before each and at the end."""
    best = None
    options = []
    for initial, doomed, cut in symbols:
        row = [("D", "", 2)]
        if not doomed:
            extra = 5 if cut else 0
            row += [("K", initial or "?", extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(row)
    inserts = ["", "u", "a", "ua", "au", "uau", "aua"]
    for gaps in product(inserts, repeat=len(symbols) + 1):
        if sum(map(len, gaps)) > 3:
            continue
        for edits in product(*options):
            roles = "".join(g + e[1] for g, e in zip(gaps, edits)) + gaps[-1]
            if is_legal(roles):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                found = (sum(e[2] for e in edits) + 5 * sum(map(len, gaps)), audit)
                best = min(best or found, found)
    return best


@pytest.mark.parametrize("length", [0, 1, 2])
def test_equals_trying_all_edits(length):
    for symbols in product(SYMBOLS, repeat=length):
        assert cheapest(list(symbols)) == by_trying_all(symbols)


def test_equals_trying_all_edits_of_longer_ones():
    rng = random.Random(3)
    for _ in range(60):
        symbols = [rng.choice(SYMBOLS) for _ in range(rng.choice([3, 3, 3, 4]))]
        assert cheapest(symbols) == by_trying_all(symbols)


def row_by_row(symbols):
    """One pass that carries whole audits, in place of divide and conquer."""
    best = {0: (0, "")}
    for symbol in symbols:
        after = {}
        for state, to, price, letters in repair.edges(symbol):
            if state in best:
                found = (best[state][0] + price, best[state][1] + letters)
                after[to] = min(after.get(to, found), found)
        best = after
    return min((cost + 5 * len(repair.TAILS[state]), audit + repair.TAILS[state]) for state, (cost, audit) in best.items())


def test_halves_meet_where_one_pass_goes():
    rng = random.Random(4)
    for _ in range(300):
        symbols = [rng.choice(SYMBOLS) for _ in range(rng.randrange(1, 90))]
        cost, audit = cheapest(symbols)
        assert (cost, audit) == row_by_row(symbols)
        rows = [(initial or "tool", str(n)) for n, (initial, _, _) in enumerate(symbols)]
        assert is_legal("".join(role[0] for role, _ in applied(audit, rows)))


def test_long_conversation():
    rng = random.Random(5)
    symbols = [rng.choice(SYMBOLS) for _ in range(20_000)]
    assert cheapest(symbols) == row_by_row(symbols)


def whole_contract(rows):
    """The contract on plain lists: damage, faults, and the edits by one pass."""
    talks = {}
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        talk = talks.setdefault(conv, [])
        if part == 0:
            continue
        text = "" if part == 1 else "".join(c for c in text if c not in ".!?") if part == 2 else text
        talk += [(turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    for conv, talk in talks.items():
        talk.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults, symbols, turns = [], [], [t[0] for t in talk if t[0] is not None]
        for n, (_, role, text) in enumerate(talk):
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if any(t[1:] == (role, text) for t in talk[:n]) else "truncated" if said[-1] not in ".!?" else ""
            faults.append(fault)
            symbols.append((role[:1] if role[:1] in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit = row_by_row(symbols)
        out = "\n".join(f"{r}:{t}" for r, t in applied(audit, [t[1:] for t in talk]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(out.encode()).hexdigest()


def digests(found):
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return sorted(map(tuple, found.withColumn("sha", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired").collect()), key=str)


def test_odd_rows_against_the_contract(spark):
    rng = random.Random(6)
    texts = [None, "", "  \n", "Yes.", "No", "No?", "cut off", "Done! ", "é.\x0b", "nb ", "long " * 50_000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ünder"]
    rows = [(rng.choice([None, 1, 2, 3, *range(100, 130)]), rng.choice([None, *range(9)]), rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts)) for _ in range(500)]
    rows += [(7, t, "user", "same.") for t in range(40)] + [(8, 5, "user", "a"), (8, 5, "user", "a"), (-3, -4, "assistant", "b.")]
    rows += [(10_000 + n, n % 3, "user", "alone.") for n in range(60)]  # some lose their only row
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", cost int, dropped_text string").repartition(7)
    got = digests(repair_conversations(damaged(table)))
    assert got == sorted(whole_contract(rows), key=str)
    assert any(row[-1] == hashlib.sha256(b"").hexdigest() and row[7] == "" for row in got)
    assert len(got) == len({r[0] for r in rows})


def test_empty_table_other_ids_and_clashing_columns(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair_conversations(damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = spark.createDataFrame([("c", 0, "user", "Hi.", [1]), ("c", 1, "user", "Hello.", [2])], "conv_id string, turn int, role string, text string, audit array<int>")
    row = repair_conversations(rows).first()
    assert (row.conv_id, row.audit, row.cost, [tuple(t) for t in row.repaired]) == ("c", "KR", 1, [("user", "Hi."), ("assistant", "Hello.")])


def test_query_gives_every_conversation(spark, small_dir):
    got = queries.queries()["op13_conversation_repair"](spark, small_dir)
    assert got.count() == spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id").distinct().count()
