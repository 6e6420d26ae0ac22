"""Repair of conversations to the structure `(s?(ua)+)?` at least cost, by Hirschberg's method.

Rows of a conversation are kept, given another role, or deleted, and empty turns are inserted,
so that role initials read: an optional system turn, then turns of user and assistant in pairs.
Only four states matter: nothing yet, after system, after user, after assistant. The cheapest
edits are found by divide and conquer: cost vectors over the four states run forward over the
first half and backward over the second, meet in the middle, and both halves are solved
between known states. Nothing else is kept, so the space is linear in the rows.

Among edits of equal cost the audit (the edits' initials in order) that is least in ASCII wins.
Inserts are written before the row that they precede, so of two audits over the same rows
neither is a prefix of the other, and the order of the four best forward audits is all that a
crossing needs to know of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import SLICE_BYTES, SLICE_ROWS, SPACES

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST = 0, 1, 2, 5
TRUNCATED_COST = 5
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant turn put in at each state, and what may be kept where.
TURN_FROM = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEP_FROM = {(NOTHING, "s"): SYSTEM} | {(state, "ua"[turn - USER]): turn for state, turn in TURN_FROM.items()}
FAR = 1 << 60

#: What matters of a row: its role's initial if that is s, u or a; doomed (blank or repeated); truncated.
Symbol = tuple[str, bool, bool]
Edge = tuple[int, int, int, str]


@lru_cache(maxsize=64)
def edges(symbol: Symbol) -> tuple[Edge, ...]:
    """(state, next state, cost, letters) of a row, at most one, the best, for each pair of states."""
    initial, doomed, truncated = symbol
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(state: int, after: int, cost: int, letters: str) -> None:
        best[state, after] = min(best.get((state, after), (FAR, "")), (cost, letters))

    for state in STATES:
        offer(state, state, DELETE_COST, DELETE)  # inserts before it come later instead, which reads less
        at, inserts = state, 0
        while not doomed and inserts < 3:
            more = INSERT_COST * inserts + (TRUNCATED_COST if truncated else 0)
            offer(state, TURN_FROM[at], more + REROLE_COST, INSERT * inserts + REROLE)
            if (at, initial) in KEEP_FROM:
                offer(state, KEEP_FROM[at, initial], more + KEEP_COST, INSERT * inserts + KEEP)
            at, inserts = TURN_FROM[at], inserts + 1
    return tuple((state, after, *found) for (state, after), found in best.items())


#: Inserts that complete a conversation after its last row.
TAILS = {NOTHING: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}


def forward(symbols: list[Symbol], low: int, high: int, start: int) -> tuple[list[int], list[int]]:
    """Least cost to each state after rows ``low`` to ``high``, and the rank of its least audit."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for row in range(low, high):
        best: list[tuple] = [(FAR,)] * 4
        for state, after, price, letters in edges(symbols[row]):
            if cost[state] < FAR:
                best[after] = min(best[after], (cost[state] + price, rank[state], letters))
        cost = [found[0] for found in best]
        order = sorted((found[1:], state) for state, found in enumerate(best) if found[0] < FAR)
        for place, (_, state) in enumerate(order):
            rank[state] = place
    return cost, rank


def backward(symbols: list[Symbol], low: int, high: int, end: int) -> list[int]:
    """Least cost from each state before rows ``low`` to ``high`` to the state ``end``."""
    cost = [FAR] * 4
    cost[end] = 0
    for row in range(high - 1, low - 1, -1):
        before = [FAR] * 4
        for state, after, price, _ in edges(symbols[row]):
            before[state] = min(before[state], cost[after] + price)
        cost = before
    return cost


def between(symbols: list[Symbol], low: int, high: int, start: int, end: int) -> Iterator[str]:
    """Letters of the cheapest, then least, edits of some rows from state ``start`` to ``end``."""
    if high - low == 1:
        yield next(letters for state, after, _, letters in edges(symbols[low]) if (state, after) == (start, end))
        return
    middle = (low + high) // 2
    (ahead, rank), behind = forward(symbols, low, middle, start), backward(symbols, middle, high, end)
    crossing = min(STATES, key=lambda state: (ahead[state] + behind[state], rank[state]))
    yield from between(symbols, low, middle, start, crossing)
    yield from between(symbols, middle, high, crossing, end)


def cheapest(symbols: list[Symbol]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; the least audit of equal ones."""
    cost, rank = forward(symbols, 0, len(symbols), NOTHING)
    total = [cost[state] + INSERT_COST * len(TAILS[state]) for state in STATES]
    end = min(STATES, key=lambda state: (total[state], rank[state]))
    return total[end], ("".join(between(symbols, 0, len(symbols), NOTHING, end)) if symbols else "") + TAILS[end]


@lru_cache(maxsize=1 << 16)
def _cheapest_short(symbols: tuple[Symbol, ...]) -> tuple[int, str]:
    return cheapest(list(symbols))


def applied(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    out, at, row = [], NOTHING, 0
    for letter in audit:
        if letter == DELETE:
            row += 1
            continue
        turn = TURN_FROM[at]
        if letter == INSERT:
            out.append((ROLES[turn], ""))
        else:
            role, text = rows[row]
            row += 1
            if letter == REROLE:
                role = ROLES[turn]
            else:
                turn = KEEP_FROM[at, role[:1]]
            out.append((role, text))
        at = turn
    return out


class Conversation:
    """What is gathered of one conversation while its rows pass by in order."""

    def __init__(self, name: object):
        self.name, self.rows, self.symbols, self.seen, self.turns = name, [], [], set(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.size = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        said = text.strip(SPACES)
        blank, repeated, cut = not said, (role, text) in self.seen, bool(said) and said[-1] not in ENDS
        self.seen.add((role, text))
        if turn is not None:
            self.turns.add(turn)
        self.blank += blank
        self.duplicate += not blank and repeated
        self.truncated += cut and not repeated
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        doomed = blank or repeated
        self.rows.append(("", "") if doomed else (role, text))
        self.symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "", doomed, cut and not doomed))
        self.size += len(role) + len(text)

    def result(self) -> tuple:
        short = len(self.symbols) <= 16
        cost, audit = _cheapest_short(tuple(self.symbols)) if short else cheapest(self.symbols)
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        repaired = [{"role": role, "text": text} for role, text in applied(audit, self.rows)]
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, repaired


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Faults, least cost, audit and repaired turns of each conversation.

    Rows are (conv_id, turn, role, text[, dropped]), ordered by turn (nulls first) and, in ties,
    by role and text. Null role or text counts as one space; rows without conv_id are one
    conversation. Rows whose ``dropped`` is true only keep their conversation in the result: one
    without other rows gives zeros, an empty audit and no turns. Each row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (no end mark). Roles other than
    s..., u... and a... can't be kept. Texts have no length limit. Rows pass by in sorted
    batches; of a conversation a task holds the texts that may stay, as one repaired
    conversation is one row of the result, and four-state vectors beside them. Other columns
    are left out, so clashing names do no harm. An empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    dropped = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    known = [F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")]
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *known, dropped.alias("dropped"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, current, schema = [], 0, None, None

        def batch_of(results: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, field.type) for c, field in zip(zip(*results, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *RESULT_FIELDS])
            for name, turn, role, text, gone in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if current is None or name != current.name:
                    if current is not None:
                        done.append(current.result())
                        size += current.size
                    current = Conversation(name)
                    if len(done) >= SLICE_ROWS or size >= SLICE_BYTES:
                        yield batch_of(done)
                        done, size = [], 0
                if not gone:
                    current.add(turn, role, text)
        if current is not None:
            yield batch_of([*done, current.result()])

    return ordered.mapInArrow(work, f"conv_id {kind}, {RESULT}")


RESULT_FIELDS = [
    *((name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()),
    ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
]

#: Of 20 hash values of `conv_id:turn`, those that damage a row.
PARTS, DROPPED, EMPTIED, CUT, REPEATED, TAKEN = 20, 0, 1, 2, 3, 4


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with made faults, by the CRC-32 of `conv_id:turn`; nulls in these, role or text are one space.

    A dropped row stays as one whose ``dropped`` is true, so that its conversation isn't lost.
    """
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % PARTS
    own = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), part.alias("part"))
    is_ = lambda kind: F.col("part") == kind
    text = F.when(is_(EMPTIED) | is_(DROPPED), "").when(is_(CUT), F.regexp_replace("text", f"[{ENDS}]", "")).otherwise(F.col("text"))
    role = F.when(is_(DROPPED), "").when(is_(TAKEN), "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(is_(DROPPED), F.when(is_(REPEATED), 2).otherwise(1))).alias("dropped")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)
