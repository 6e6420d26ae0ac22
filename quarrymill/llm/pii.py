"""Personal data: exact base patterns, and more spans from a character-level BiLSTM-CRF.

The network is trained in numpy on sentences with labelled spans that a seeded generator makes,
with shapes the patterns miss (such as phone numbers without a country sign) and look-alikes
that are no personal data. A text is cut into overlapping windows that cover it, and every one
goes through the network and is decoded: where the emissions and transitions prove that the
best path lies outside any span throughout, that is the decoding, elsewhere Viterbi finds it.
The windows' spans are reconciled over the whole text: spans of one kind that overlap become
one, of different kinds the surer one stays. Base spans always stay, and a model span that
overlaps one is dropped.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import by_slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Window length and step in code points; a span of up to the difference lies whole in a window.
WINDOW, STEP = 512, 448
#: Windows that go through the network together.
BATCH = 512
#: Mean certainty from which a model span counts.
CERTAIN = 0.9
HIDDEN, TRAIN_STEPS, TRAIN_BATCH, TRAIN_CHARS, RATE = 12, 600, 48, 96, 0.012

# --- base patterns -------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; goes from at sign to at sign, so that long words cost nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37:  # 19 digits and the signs between them
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# --- network -------------------------------------------------------------------------------

#: Characters: ASCII by code, then other letters, other digits and all else; 0 also fills up short windows.
CHARS, TAGS = 131, 1 + 2 * len(KINDS)


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    """Code of each code point; those beyond the last plane of letters are all else."""
    table = np.full(0x110000, 130, np.uint8)
    table[:128] = np.arange(128)
    for point in range(128, 0x33480):
        char = chr(point)
        table[point] = 128 if char.isalpha() else 129 if char.isdigit() else 130
    return table


def codes(text: str) -> np.ndarray:
    return _code_table()[np.frombuffer(text.encode("utf-32-le"), "<u4")]


def allowed() -> np.ndarray:
    """Transitions: inside a kind only after its beginning or inside; inside never starts."""
    ok = np.ones((TAGS + 1, TAGS), bool)  # the last row is the start
    for tag in range(2, TAGS, 2):
        ok[:, tag] = False
        ok[[tag - 1, tag], tag] = True
    return ok


FORBIDDEN = np.where(allowed(), 0.0, -1e4).astype(np.float32)


#: Emissions of what is outside any span for certain.
OUTSIDE = np.where(np.arange(TAGS) == 0, 0, -1e4).astype(np.float32)


def log_total(a: np.ndarray) -> np.ndarray:
    """log of the summed exponentials over the second axis."""
    most = a.max(axis=1)
    return most + np.log(np.exp(a - np.expand_dims(most, 1)).sum(axis=1))


def forward_backward(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of all paths up to, and from, each tag; e is time x batch x tags."""
    ahead, behind = np.empty_like(e), np.zeros_like(e)
    ahead[0] = e[0] + move[TAGS]
    for t in range(1, len(e)):
        ahead[t] = log_total(ahead[t - 1][:, :, None] + move[:TAGS]) + e[t]
    for t in range(len(e) - 2, -1, -1):
        behind[t] = log_total((move[:TAGS] + (e[t + 1] + behind[t + 1])[:, None, :]).transpose(0, 2, 1))
    return ahead, behind


def both_ways(x: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Codes (batch x time) -> directions x time x batch; the second reads each row backwards from its own end.

    Where rows have lengths, what is beyond them comes last both ways, so it changes no state within.
    """
    back = x[:, ::-1] if lengths is None else np.take_along_axis(x, turned(lengths, x.shape[1]), axis=1)
    return np.stack([x.T, back.T])


def turned(lengths: np.ndarray, n: int) -> np.ndarray:
    """For each row and time the place that reading backwards from the row's end comes to; its own inverse."""
    at = np.arange(n)
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


class Tagger:
    """Two LSTMs over characters, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
        self.values = {
            "emit": normal(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS + 1, TAGS), np.float32),
            "in": normal(2, CHARS, 4 * HIDDEN), "own": normal(2, HIDDEN, 4 * HIDDEN),
        }
        self.values["in"][:, :, HIDDEN : 2 * HIDDEN] += 1  # the forget gate starts open

    def lstm(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """time x directions x hidden x batch: states after each character of x (directions x time x batch)."""
        scale = np.repeat([0.5, 1], [3 * HIDDEN, HIDDEN]).astype(self.values["own"].dtype)  # sigmoid(z) is tanh(z / 2) / 2 + 1/2
        given, own = (np.ascontiguousarray((self.values[name] * scale).transpose(0, 2, 1)) for name in ("in", "own"))
        h = c = np.zeros((2, HIDDEN, x.shape[2]), own.dtype)
        out = np.empty((x.shape[1], *h.shape), own.dtype)
        for t in range(x.shape[1]):
            z = own @ h
            for way in (0, 1):
                z[way] += given[way].take(x[way, t], axis=1, mode="clip")
            np.tanh(z, out=z)
            gates = z[:, : 3 * HIDDEN]
            gates *= 0.5
            gates += 0.5
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            before = c
            c = f * before
            c += i * g
            squashed = np.tanh(c)
            if keep is not None:
                keep.append((t, i, f, o, g, before, squashed, h))
            h = out[t]
            np.multiply(o, squashed, out=h)
        return out

    def emissions(self, x: np.ndarray, lengths: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """time x batch x tags of x (batch x time)."""
        out = self.lstm(both_ways(x, lengths), None if keep is None else keep.setdefault("steps", []))
        ahead, behind = out[:, 0], out[::-1, 1]
        if lengths is not None:
            behind = np.take_along_axis(out[:, 1], turned(lengths, x.shape[1]).T[:, None, :], axis=0)
        if keep is not None:
            keep["states"] = np.concatenate([ahead, behind], axis=1)
        emit = np.ascontiguousarray(self.values["emit"].T)
        e = emit[:, :HIDDEN] @ ahead
        e += emit[:, HIDDEN:] @ behind
        return e.transpose(0, 2, 1) + self.values["bias"]

    def surely_outside(self, e: np.ndarray) -> np.ndarray:
        """Rows whose best path is proven to be outside any span throughout.

        A path gains or loses against that one span by span, and ``most`` is the most that any
        span can gain, with the best transition into it and out of it: the gain up to its end
        less that before its inside, a running sum and a running maximum. If no span gains, no
        path does.
        """
        move = self.values["move"] + FORBIDDEN
        most = np.full(e.shape[1], -np.inf, e.dtype)
        for begin in range(1, TAGS, 2):
            inside = begin + 1
            into = max(float((move[:TAGS, begin] - move[0, 0]).max()), float(move[TAGS, begin] - move[TAGS, 0]))
            out = [max(float(move[tag, 0] - move[0, 0]), 0.0) for tag in (begin, inside)]
            first, further = (float(move[tag, inside] - move[0, 0]) for tag in (begin, inside))
            begun = e[:, :, begin] - e[:, :, 0] + into
            most = np.maximum(most, begun.max(axis=0) + out[0])
            so_far = np.cumsum(e[:, :, inside] - e[:, :, 0] + further, axis=0)
            opened = np.maximum.accumulate(begun[:-1] - so_far[:-1], axis=0)
            ended = (opened + so_far[1:]).max(axis=0, initial=-np.inf)
            most = np.maximum(most, ended + first - further + out[1])
        return most < -1e-3  # sums in another order than the decoder's

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (batch x time) for emissions (time x batch x tags)."""
        move = self.values["move"] + FORBIDDEN
        score, back = e[0] + move[TAGS], []
        for t in range(1, len(e)):
            every = score[:, :, None] + move[:TAGS]
            best = every.argmax(axis=1)
            score = np.take_along_axis(every, best[:, None], axis=1)[:, 0] + e[t]
            back.append(best)
        tags = np.empty((e.shape[1], len(e)), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = np.take_along_axis(back[t], tags[:, t + 1 : t + 2], axis=1)[:, 0]
        return tags

    def certainty(self, e: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability (batch x time) of each tag's kind given the window."""
        ahead, behind = forward_backward(e, self.values["move"] + FORBIDDEN)
        odds = np.exp(np.minimum(ahead + behind - log_total(ahead[-1])[:, None], 0))
        # Beginning and inside of a kind count together.
        kinds = np.concatenate([odds[:, :, :1], odds[:, :, 1::2] + odds[:, :, 2::2]], axis=2)
        return np.take_along_axis(kinds, ((tags + 1) // 2).T[:, :, None], axis=2)[:, :, 0].T

    def open_windows(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x (batch x time) that are not proven to be outside any span, and their emissions."""
        whole = lengths.min(initial=x.shape[1]) == x.shape[1]
        e = self.emissions(x, None if whole else lengths)
        if not whole:  # what is beyond a row's length is outside any span
            e = np.where((np.arange(x.shape[1])[:, None] < lengths)[:, :, None], e, OUTSIDE)
        rows = np.flatnonzero(~self.surely_outside(e))
        return rows, e[:, rows]

    def read(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch x time) for emissions, and how sure each is."""
        tags = self.viterbi(e)
        sure, told = np.ones(tags.shape, np.float32), np.flatnonzero(tags.any(axis=1))
        if len(told):
            sure[told] = self.certainty(e[:, told], tags[told])
        return tags, sure

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch x time) of x and how sure each is."""
        tags, sure = np.zeros(x.shape, np.int64), np.ones(x.shape, np.float32)
        rows, e = self.open_windows(x, lengths)
        if len(rows):
            tags[rows], sure[rows] = self.read(e)
        return tags, sure

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (batch x time) and its gradients."""
        keep: dict = {}
        e = self.emissions(x, keep=keep)
        n, rows = len(e), np.arange(len(x))
        move = self.values["move"] + FORBIDDEN
        ahead, behind = forward_backward(e, move)
        norm = log_total(ahead[-1])
        seen = e[np.arange(n)[:, None], rows, y.T].sum(axis=0) + move[TAGS, y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        slope = np.exp(ahead + behind - norm[:, None])
        grad_move = np.zeros_like(move)
        grad_move[TAGS] = slope[0].sum(axis=0)
        for t in range(1, n):
            pair = ahead[t - 1][:, :, None] + move[:TAGS] + (e[t] + behind[t])[:, None, :] - norm[:, None, None]
            grad_move[:TAGS] += np.exp(pair).sum(axis=0)
        np.subtract.at(grad_move, (y[:, :-1], y[:, 1:]), 1)
        np.subtract.at(grad_move, (np.full(len(y), TAGS), y[:, 0]), 1)
        slope[np.arange(n)[:, None], rows, y.T] -= 1
        slope /= len(x)
        grads = {"emit": np.einsum("thb,tbk->hk", keep["states"], slope), "bias": slope.sum(axis=(0, 1)), "move": grad_move / len(x)}
        back = slope @ self.values["emit"].T
        ways = np.stack([back[:, :, :HIDDEN], back[::-1, :, HIDDEN:]], axis=1).transpose(0, 1, 3, 2)
        return float((norm - seen).mean()), grads | self._lstm_gradients(both_ways(x), ways, keep["steps"])

    def _lstm_gradients(self, x: np.ndarray, slope: np.ndarray, steps: list) -> dict[str, np.ndarray]:
        own = self.values["own"]
        every, grad_own = np.empty((2, x.shape[1], x.shape[2], 4 * HIDDEN), own.dtype), np.zeros_like(own)
        dh = dc = np.zeros(slope.shape[1:], own.dtype)
        for t, i, f, o, g, c, squashed, h in reversed(steps):
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            every[:, t] = dz.transpose(0, 2, 1)
            grad_own += h @ every[:, t]
            dh, dc = own @ dz, dc * f
        marks = (x.reshape(2, 1, -1) == np.arange(CHARS)[:, None]).astype(own.dtype)  # by direction and code, where it stands
        return {"in": marks @ every.reshape(2, -1, 4 * HIDDEN), "own": grad_own}


# --- labelled spans ------------------------------------------------------------------------


def sample_value(rng: random.Random, kind: int) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    if kind == 0:
        local = rng.choice([word(2, 9), f"{word(1, 7)}.{word(2, 7)}", f"{word(2, 8)}{digits(2)}", f"{word(2, 6)}.{digits(2)}", f"{word(2, 6)}_{word(2, 5)}"])
        return f"{local}@{rng.choice([word(3, 9), f'mail{digits(1)}.{word(3, 8)}', word(2, 5) + '-' + word(2, 5)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk'])}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        bare = rng.choice("3456") + digits(14)
        number = next(bare + d for d in "0123456789" if luhn(bare + d))
        return rng.choice(["", "", " ", "-"]).join(number[k : k + 4] for k in range(0, 16, 4))
    area, a, b = digits(3), digits(3), digits(4)
    return rng.choice([f"+{rng.randint(1, 99)} ({area}) {a}-{b}", f"+{rng.randint(1, 99)} {area} {a} {b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"0{digits(2)} {digits(4)} {b}", f"+{digits(11)}"])


def sample_other(rng: random.Random) -> str:
    """Look-alikes that are no personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            digits(rng.randint(1, 6)), f"{rng.randint(1900, 2099)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
            f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{digits(2)}:{digits(2)}", f"{digits(3)}.{digits(2)}", f"${digits(3)},{digits(3)}",
            f"v{digits(1)}.{digits(1)}.{digits(2)}", f"#{digits(5)}", f"{digits(2)}%", "@" + "".join(rng.choice("abcdefgh") for _ in range(5)), f"{digits(4)}-{digits(4)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([12, 32, 40]))), f"ISBN {digits(3)}-{digits(10)}", f"{digits(1)} {digits(2)} {digits(1)}",
        ]
    )


def sample_word(rng: random.Random) -> str:
    """A word that is in no span: any letters, so that only its surroundings tell it from a part of an address."""
    letters = rng.choice(["abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu", "aeioulmnrstdqu", "abcdefghijklmnopqrstuvwxyzéüñçßãôж漢"])
    value = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
    return rng.choice([value, value, value, value, value.capitalize(), value.upper(), f"{value}-{value[:4]}", f"{value}.{value[:3]}", f"{value}_{value[:3]}", f"{value}/{value}"])


def sample_sentence(rng: random.Random, n: int) -> tuple[str, list[int]]:
    """At least n characters of words, values and look-alikes, and the tag of each character; one in three has words only."""
    text, tags, plain = "", [], rng.random() < 0.33
    while len(text) < n:
        draw, kind = 1.0 if plain else rng.random(), rng.randrange(len(KINDS))
        value = sample_value(rng, kind) if draw < 0.15 else sample_other(rng) if draw < 0.3 else sample_word(rng)
        tags += [2 * kind + 1] + [2 * kind + 2] * (len(value) - 1) if draw < 0.15 else [0] * len(value)
        gap = rng.choice([" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n", "\n", " | ", "&&& ", "!! ", ": ", "%%% ", "; ", "? "])
        text, tags = text + value + gap, tags + [0] * len(gap)
    return text, tags


def labelled_batch(rng: random.Random, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = [sample_sentence(rng, n) for _ in range(rows)]
    return np.stack([codes(text[:n]) for text, _ in found]), np.array([tags[:n] for _, tags in found])


@lru_cache(maxsize=1)
def trained_tagger(seed: int = 0, steps: int = TRAIN_STEPS) -> Tagger:
    """Fitted once in a process; the same for the same seed."""
    rng, tagger = random.Random(seed), Tagger(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.values.items()}
    for step in range(1, steps + 1):
        _, grads = tagger.gradients(*labelled_batch(rng, TRAIN_BATCH, TRAIN_CHARS))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 - 2 * step / steps)
        for k, value in tagger.values.items():
            m, v = moments[k]
            grad = grads[k] * min(1.0, 5 / (size + 1e-6))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return tagger


# --- whole texts ---------------------------------------------------------------------------

def windows(n: int) -> list[int]:
    """Starts of windows that cover n characters; the last is moved back to end with the text."""
    return [*range(0, max(1, n - WINDOW), STEP), *([n - WINDOW] if n > WINDOW else [])]


def tagged_spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, certainty) of one decoded window."""
    starts = np.flatnonzero(tags % 2 == 1)
    out = []
    for start in starts:
        end = start + 1
        while end < len(tags) and tags[end] == tags[start] + 1:
            end += 1
        out.append((int(tags[start]) // 2, int(start), end, float(sure[start:end].mean())))
    return out


#: First digits of card numbers by their length, where few are given out; longer ones start with any.
ISSUED = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37")}


def checked(kind: int, value: str) -> bool:
    """What no such network learns: an e-mail has an at sign; a card number has 13 to 19 digits, begins as those of its length do, and passes Luhn."""
    if KINDS[kind] == "email":
        return "@" in value
    digits = "".join(c for c in value if "0" <= c <= "9")
    return KINDS[kind] != "card" or (13 <= len(digits) <= 19 and digits.startswith(ISSUED.get(len(digits), "")) and luhn(digits))


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Model spans of a whole text that stand beside the base spans."""
    merged: list[list] = []
    for kind, start, end, sure in sorted(found):
        if merged and merged[-1][0] == kind and start < merged[-1][2]:
            merged[-1][2], merged[-1][3] = max(merged[-1][2], end), max(merged[-1][3], sure)
        else:
            merged.append([kind, start, end, sure])
    taken = sorted((start, end) for _, start, end in base)
    out: list[tuple[int, int, int]] = []
    for kind, start, end, sure in sorted(merged, key=lambda s: (-s[3], s[1], s[0])):
        if sure >= CERTAIN and checked(kind, text[start:end]) and all(end <= a or b <= start for a, b in taken):
            out.append((kind, start, end))
            taken.append((start, end))
    return out


def find_all(texts: list[str], tagger: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all spans, each by kind, then start."""
    base = [base_spans(text) for text in texts]
    coded = [codes(text) for text in texts]
    places = [(min(len(own), WINDOW), row, start) for row, own in enumerate(coded) for start in windows(len(own))]
    places.sort(reverse=True)  # windows of like lengths together
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[tuple[int, int, int], np.ndarray]] = []

    def read_waiting() -> None:
        e = np.broadcast_to(OUTSIDE, (waiting[0][1].shape[0], len(waiting), TAGS)).copy()
        for number, (_, own) in enumerate(waiting):
            e[: len(own), number] = own
        tags, sure = tagger.read(e)
        for number, ((n, row, start), _) in enumerate(waiting):
            found[row] += [(kind, start + a, start + b, c) for kind, a, b, c in tagged_spans(tags[number, :n], sure[number, :n])]
        waiting.clear()

    for at in range(0, len(places), BATCH):
        part = places[at : at + BATCH]
        lengths = np.array([n for n, _, _ in part])
        if not lengths[0]:
            break  # only empty texts are left
        x = np.zeros((len(part), lengths[0]), np.uint8)
        for number, (n, row, start) in enumerate(part):
            x[number, :n] = coded[row][start : start + n]
        rows, e = tagger.open_windows(x, lengths)
        waiting += [(part[row], e[:, number]) for number, row in enumerate(rows)]
        if len(waiting) >= BATCH:
            read_waiting()
    if waiting:
        read_waiting()
    return [(b, sorted(b + reconcile(text, own, b))) for text, own, b in zip(texts, found, base, strict=True)]


def find_personal_data(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base, spans of every row: arrays of (kind, start, end) by kind, then start; narrow.

    ``kind`` is an index into KINDS; places count code points, the end is exclusive. Null text is
    empty and has no spans. Repeated rows and null ids each keep their row. Texts have no length
    limit and are searched whole; an empty table gives an empty result. Other columns are left
    out, so clashing names do no harm.
    """
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_all(batch.column(1).to_pylist(), tagger)
        lists = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row[n]] for row in found], shape) for n in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: int, start: int, end: int>>"
    source = docs.select("doc_id", text_or_empty().alias("text"))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(by_slices(work), f"doc_id {id_kind}, base {kind}, spans {kind}")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
