r"""Personal data in whole texts: fixed patterns, and a character BiLSTM with a CRF beside them.

Base spans come from four patterns, leftmost and non-overlapping for each kind, matches that
fail their check being dropped: email, ip (parts up to 255), card (14 to 19 digits passing
Luhn) and phone (10 to 15 digits after a plus sign).  They always stay.

The network adds spans of the same kinds in other spellings (phones without a plus sign,
cards with dots, addresses in brackets or spelt out).  It labels each character B or I of a
kind, or O, under CRF transitions.  It is trained in numpy on windows of WINDOW characters
with labelled spans: base spans of a bounded sample of the corpus (SAMPLE_DOCS
documents chosen by a hash) in their context, and generated spellings put into other
stretches of it.  Its labels decide; a span is dropped only if it lacks what any spelling of
its kind has (plausible()): the number of digits, parts up to 255, Luhn, an at sign.

Every character of every text is run, in windows of WIDE characters that share LAP with the
next.  They are decoded one by one and reconciled over the whole document: a span that a
window's inner edge cuts is joined to what the next window cuts of it and run again in a
wider window, until both its ends lie inside, however long it is; the rest are taken by score
(mean log-odds of their labels), then length, then place, unless they touch a base span or
one taken before.

Null text is an empty text without spans.  Runs of digits of any length take linear time.
Repeated rows each give theirs.  An empty table gives no rows.  find() drops other columns,
whatever their names; redacted() keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])  # 1 + 2 k is B of kind k, 2 + 2 k is I
WINDOW, STRIDE, EDGE = 64, 32, 3
#: Rows of WIDE that are run at once (OpenBLAS has a faster way for products up to that size), and how many times as many are decoded together.
WIDE, LAP, ROWS, PORTIONS = 512, 40, 256, 32
#: Characters of batches that are taken together, about: few windows left over, and few short runs.
TOGETHER = 5_000_000
SAMPLE_DOCS, EXAMPLES, HIDDEN, EMBED, STEPS, BATCH, RATE = 600, 6000, 24, 12, 650, 64, 0.012

#: Fixed patterns of the base.
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # what starts within a run of digits ends as what starts before it does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile("[0-9@]")
#: What examples of plain text are free of: those, and a full stop that is spelt out.
_HINT = re.compile(r"[0-9@]|[ \[(]dot[ \])]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _octet(digits: str) -> bool:
    """At most 255, however many zeros stand before."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _emails(text: str) -> list[Span]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _TAIL.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            after = m.end()
        at = text.find("@", max(after, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out = _emails(text)
    first = _ANCHOR.search(text)
    if first:
        at = max(0, first.start() - 1)
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for m in pattern.finditer(text, at):
                own = m.group()
                if kind == 1:
                    fit = all(map(_octet, own.split(".")))
                else:
                    d = _digits(own)
                    fit = (14 <= len(d) <= 19 and luhn(d)) if kind == 2 else 10 <= len(d) <= 15
                if fit:
                    out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _symbols() -> np.ndarray:
    """Code point -> symbol: digits are one, letters regardless of case, the rest of ASCII each its own."""
    table = np.zeros(128, np.uint8)
    for c in range(32, 127):
        ch = chr(c)
        table[c] = 2 if ch.isdigit() else 3 + ord(ch.lower()) - 97 if ch.isalpha() else 0
    rest = [c for c in range(32, 127) if not chr(c).isalnum()]
    table[rest] = 29 + np.arange(len(rest))
    table[[9, 10, 13]] = 1
    return table


_TABLE = _symbols()
OTHER_LETTER, OTHER, SYMBOLS = int(_TABLE.max()) + 1, int(_TABLE.max()) + 2, int(_TABLE.max()) + 4
PADDING = SYMBOLS - 1


def encode(text: str) -> np.ndarray:
    if text.isascii():
        return _TABLE[np.frombuffer(text.encode(), np.uint8)]
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(raw), OTHER_LETTER, np.uint8)
    small = raw < 128
    out[small] = _TABLE[raw[small]]
    return out


def allowed() -> np.ndarray:
    """Scores of transitions by rule: I follows B or I of its kind only."""
    rule = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for k in range(len(KINDS)):
        rule[:, 2 + 2 * k] = -1e4
        rule[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return rule


class Tagger:
    """An LSTM each way over characters, emissions, and CRF transitions.  Arrays are (time, unit, batch)."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(TAGS)
        self.w = {"embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, 0.2, (k, 2 * h)), "bias": np.zeros((k, 1)), "move": np.zeros((k, k))}
        for way in "fb":
            self.w[f"in_{way}"] = rng.normal(0, EMBED**-0.5, (4 * h, EMBED))
            self.w[f"gate_{way}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])[:, None]  # the forget gate begins open
            self.w[f"own_{way}"] = rng.normal(0, h**-0.5, (4 * h, h))
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}
        self.rule = allowed()

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """x (time, batch) symbols -> states (time, HIDDEN, batch)."""
        h, own = HIDDEN, self.w[f"own_{way}"].copy()
        fed = self.w[f"in_{way}"] @ self.w["embed"].T + self.w[f"gate_{way}"]
        for part in (own, fed):  # a sigmoid is a tanh of half its argument
            part[: 3 * h] *= 0.5
        fed = np.ascontiguousarray(fed.T)
        state = np.zeros((h, x.shape[1]), own.dtype)
        cell, out = state, np.empty((len(x), *state.shape), own.dtype)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a = own @ state
            a += fed[x[t]].T
            np.tanh(a, out=a)
            gates = a[: 3 * h]
            gates *= 0.5
            gates += 0.5
            i, f, o, g = a[:h], a[h : 2 * h], a[2 * h : 3 * h], a[3 * h :]
            new = f * cell
            new += i * g
            flat = np.tanh(new)
            if keep is not None:
                keep.append((t, state, cell, i, f, o, g, flat))
            cell = new
            state = np.multiply(o, flat, out=out[t])
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x (time, batch) symbols -> (time, tag, batch): _run() of both ways at once.

        A step's state, embedding and a 1 are one matrix, so its gates and the tags' scores by the
        state before are one product.  The matrix holds twice the state, and gates are twice
        themselves: halving is exact, and is left to fewer places.  The left matrix lies by columns,
        as OpenBLAS takes it faster.
        """
        h, (n, b), kind = HIDDEN, x.shape, self.w["embed"].dtype
        half, one, embed = kind.type(0.5), kind.type(1), np.ascontiguousarray(self.w["embed"].T)
        all_in = np.zeros((2, 4 * h + len(TAGS), h + EMBED + 1), kind)
        for k, way in enumerate("fb"):
            all_in[k, : 4 * h] = np.concatenate([self.w[f"{p}_{way}"] for p in ("own", "in", "gate")], axis=1)
            all_in[k, 4 * h :, :h] = self.w["out"][:, k * h : k * h + h]
        all_in[:, : 3 * h] *= half  # a sigmoid is a tanh of half its argument
        all_in[:, :, :h] *= half
        all_in[0, 4 * h :, -1:] = self.w["bias"]
        all_in = np.ascontiguousarray(all_in.transpose(0, 2, 1)).transpose(0, 2, 1)
        held, a = np.zeros((2, h + EMBED + 1, b), kind), np.empty((2, 4 * h + len(TAGS), b), kind)
        held[:, -1] = 1
        state, both, fed = held[:, :h], np.concatenate([x, x[::-1]], axis=1), np.empty((EMBED, 2 * b), kind)
        by_way, place = fed.reshape(EMBED, 2, b).transpose(1, 0, 2), held[:, h:-1]
        cell, by_step = np.zeros((2, h, b), kind), np.empty((n + 1, 2, len(TAGS), b), kind)
        bent, gates, i, f, o, g, new = a[:, : 4 * h], a[:, : 3 * h], a[:, :h], a[:, h : 2 * h], a[:, 2 * h : 3 * h], a[:, 3 * h : 4 * h], np.empty_like(cell)
        scores = a[:, 4 * h :]
        for symbols, to in zip(both, by_step[:n], strict=True):
            embed.take(symbols, axis=1, out=fed, mode="clip")
            place[:] = by_way
            np.matmul(all_in, held, out=a)
            to[:] = scores
            np.tanh(bent, out=bent)
            gates += one
            cell *= f
            cell += np.multiply(i, g, out=new)
            cell *= half
            np.multiply(o, np.tanh(cell, out=new), out=state)
        by_step[n] = np.matmul(all_in, held, out=a)[:, 4 * h :]
        return by_step[1:, 0] + by_step[:0:-1, 1]

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of tags (time, tag, batch), of transitions summed over time and batch, and the log of the partition function, summed."""
        move, top = np.exp(self.w["move"] + self.rule), e.max(axis=1, keepdims=True)
        held = np.exp(e - top)
        forth, back, scale = np.empty_like(held), np.ones_like(held), float(top.sum())
        for t in range(len(e)):
            forth[t] = held[t] if t == 0 else (move.T @ forth[t - 1]) * held[t]
            n = forth[t].sum(axis=0)
            forth[t] /= n
            scale += float(np.log(n).sum())
        for t in range(len(e) - 2, -1, -1):
            back[t] = move @ (held[t + 1] * back[t + 1])
            back[t] /= back[t].sum(axis=0)
        single = forth * back
        single /= single.sum(axis=1, keepdims=True)
        after = held[1:] * back[1:]
        n = (np.matmul(move.T, forth[:-1]) * after).sum(axis=1, keepdims=True)
        return single, np.matmul(forth[:-1] / n, after.transpose(0, 2, 1)).sum(0) * move, scale

    def learn(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the CRF's negative log-likelihood of tags y (time, batch), by position."""
        h, (n, b) = HIDDEN, x.shape
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, w, kept[w]) for w in "fb"], axis=1)
        de, dmove, _ = self.marginals(np.matmul(self.w["out"], both) + self.w["bias"])
        de[np.arange(n)[:, None], y, np.arange(b)] -= 1
        np.subtract.at(dmove, (y[:-1], y[1:]), 1)
        de /= x.size
        g = {"out": np.matmul(de, both.transpose(0, 2, 1)).sum(0), "bias": de.sum((0, 2))[:, None], "move": dmove / x.size, "embed": np.zeros_like(self.w["embed"])}
        dboth = np.matmul(self.w["out"].T, de)
        order = np.argsort(x.ravel(), kind="stable")
        met, starts = np.unique(x.ravel()[order], return_index=True)
        for k, way in enumerate("fb"):
            own, dstate = self.w[f"own_{way}"], np.zeros((h, b), both.dtype)
            dcell, din, down = np.zeros_like(dstate), np.empty((4 * h, n, b), both.dtype), np.zeros_like(own)
            for t, state, cell, i, f, o, new, flat in reversed(kept[way]):
                d = dboth[t, k * h : (k + 1) * h] + dstate
                dc = dcell + d * o * (1 - flat**2)
                da = np.concatenate([dc * new * i * (1 - i), dc * cell * f * (1 - f), d * flat * o * (1 - o), dc * i * (1 - new**2)])
                din[:, t] = da
                down += da @ state.T
                dstate, dcell = own.T @ da, dc * f
            dfed = np.zeros((4 * h, SYMBOLS), both.dtype)
            dfed[:, met] = np.add.reduceat(din.reshape(4 * h, -1)[:, order], starts, axis=1)
            g[f"own_{way}"], g[f"gate_{way}"], g[f"in_{way}"] = down, dfed.sum(1, keepdims=True), dfed @ self.w["embed"]
            g["embed"] += dfed.T @ self.w[f"in_{way}"]
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """x, y (examples, WINDOW)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, STEPS + 1):
            at = rng.choice(len(x), min(BATCH, len(x)), replace=False)
            g = self.learn(x[at].T, y[at].T)
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, w in self.w.items():
                d = np.clip(g[k], -0.5, 0.5)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d**2
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def _plain(self, e: np.ndarray) -> np.ndarray:
        """Of each of a batch, whether O throughout is best for sure.

        A path is O but for some spans.  What a span that ends by a position gains over O is bounded
        by what it gained before, its I there and the best move to it, or its B there and the best
        move to that, and a move back to O.  Where no span gains anything, no path does.
        """
        move = (self.w["move"] + self.rule).astype(np.float64)
        own, b, i = move - move[0, 0], np.arange(1, len(move), 2), np.arange(2, len(move), 2)
        first = (e[:, 1::2] - e[:, :1]).astype(e.dtype, copy=False)
        gain = (e[:, 2::2] - e[:, :1]).astype(e.dtype, copy=False)
        np.maximum(gain[0], first[0], out=gain[0])
        first += own[:, b].max(axis=0).astype(e.dtype)[:, None]
        gain[1:] += np.maximum(own[b, i], own[i, i]).astype(e.dtype)[:, None]
        before = gain[0]
        for now, begun in zip(gain[1:], first[1:], strict=True):
            now += before
            before = np.maximum(now, begun, out=now)
        back = np.maximum(0, np.maximum(own[b, 0], own[i, 0]))
        return (gain.max(axis=0) + back[:, None] < -0.01).all(axis=0)  # where rounding counts, decode() tells

    def _best(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (time, tag, batch) -> best tags, and each position's score of its tag over O (time, batch)."""
        move = self.w["move"] + self.rule
        n, k, b = e.shape
        best, every, came = np.empty_like(e), np.empty((k, k, b), e.dtype), np.empty((n, b), np.int64)
        best[0] = e[0]
        for t in range(1, n):
            np.max(np.add(best[t - 1][:, None], move[:, :, None], out=every), axis=0, out=best[t])
            best[t] += e[t]
        came[-1] = best[-1].argmax(axis=0)
        for t in range(n - 1, 0, -1):
            came[t - 1] = (best[t - 1] + move[:, came[t]]).argmax(axis=0)
        return came, np.take_along_axis(e, came[:, None], 1)[:, 0] - e[:, 0]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x (batch, time) -> best tags, and each position's score of its tag over O."""
        tags, score = np.zeros(x.shape, np.int8), np.zeros(x.shape, self.w["move"].dtype)
        most = max(1, ROWS * WIDE // max(1, x.shape[1]))
        most = max(1, -(-len(x) // max(1, -(-len(x) // most))))  # as many in each run
        rows, kept = [], []  # those that need a search, some hundred together
        for c in range(0, len(x), most):
            e = self.emissions(np.ascontiguousarray(x[c : c + most].T, np.intp))
            own = np.flatnonzero(~self._plain(e))
            if len(own):
                rows.append(c + own)
                kept.append(e[:, :, own])
            if rows and (c + most >= len(x) or sum(map(len, rows)) >= most):
                at, (came, over) = np.concatenate(rows), self._best(np.concatenate(kept, axis=2))
                tags[at], score[at] = came.T, over.T
                rows, kept = [], []
        return tags, score


def _spelt(rng: np.random.Generator, kind: int) -> str:
    """A generated item of a kind, in a spelling that the base may not have."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuw"), rng.integers(3, 9)))
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == 0:
        end = pick("com", "org", "net", "de")
        return pick(
            f"{word()}.{n(2)}@{word()}.{word()}.{end}", f"{word()}@{word()}.{end}", f"{word()} @ {word()}.{end}", f"{word()}@{word()}[.]{end}",
            f"{word()} at {word()} dot {end}", f"{word()}.{word()} at {word()} dot {end}", f"{word()} (at) {word()} (dot) {end}", f"{word()}[at]{word()}[dot]{end}",
        )
    if kind == 1:
        p = [str(rng.integers(0, 256)) for _ in range(4)]
        return pick(".".join(p), "[.]".join(p), "(.)".join(p))
    if kind == 2:
        head = pick("4", "5", "37") + n(14)
        d = head[:15]
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), ".".join(d[i : i + 4] for i in range(0, 16, 4)))
    a, b, c = n(3), n(3), n(4)
    return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{n(2)} {a} {b} {c}", f"00{n(2)} {a} {b}{c}")


def examples(texts: list[str], most: int = EXAMPLES, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: base spans in their context, other windows with digits, and generated spellings in stretches of text."""
    rng = np.random.default_rng(seed)
    x, y = [], []

    def add(text: str, spans: list[Span]) -> None:
        tags = np.zeros(WINDOW, np.int64)
        for s, e, kind in spans:
            if 0 <= s < WINDOW:  # what a window's end cuts is labelled up to there
                tags[s:e] = 2 + 2 * kind
                tags[s] = 1 + 2 * kind
        symbols = np.full(WINDOW, PADDING)
        symbols[: len(text[:WINDOW])] = encode(text[:WINDOW])
        x.append(symbols)
        y.append(tags)

    for text in texts:
        spans = base_spans(text)
        for a in _ANCHOR.finditer(text):
            if len(x) >= most // 3:
                break
            if rng.random() < 0.3:
                start = max(0, a.start() - int(rng.integers(0, WINDOW - 4)))
                if not any(s < start < e or s < start + WINDOW < e for s, e, _ in spans):
                    add(text[start : start + WINDOW], [(s - start, e - start, k) for s, e, k in spans])
    plain = [t for t in texts if len(t) > 20] or ["some plain words that hold nothing of note, and a few more of them"]
    while len(x) < most:
        t = plain[rng.integers(len(plain))]
        at = int(rng.integers(max(1, len(t) - WINDOW)))
        stretch = t[at : at + WINDOW]
        gaps = [m.start() for m in re.finditer(r"\s", stretch)] or [len(stretch)]
        cut = gaps[rng.integers(len(gaps))]
        kind, before = int(rng.integers(6)), stretch[:cut] + " "
        if _HINT.search(stretch):
            continue
        if kind >= 4:  # numbers and codes that are nobody's
            n = "".join(rng.choice(list("0123456789abcdef" if kind == 5 else "0123456789"), rng.integers(1, 40 if kind == 5 else 8)))
            own, spans = [f'"{n}"', n, f"version {n[:1]}.{n[1:2] or 0}", f"{n[:3]}%"][rng.integers(4)], []
        else:
            own = _spelt(rng, kind)
            spans = [(len(before), len(before) + len(own), kind)]
        add(before + own + ["", " ", ". ", ", "][rng.integers(4)] + stretch[cut:], spans)
    return np.array(x), np.array(y)


def train(docs: DataFrame) -> Tagger:
    """A tagger from a bounded sample of docs (doc_id, text).

    The ids' hashes give the bound first, so texts outside the sample never leave their tasks.
    """
    hashed = docs.filter("text IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h"))
    bound = [r[0] for r in hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]
    sample = hashed.filter(F.col("h") <= (bound[-1] if bound else 0)).orderBy("h", "text").limit(SAMPLE_DOCS)
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - 4000)) + 1
    texts = [r[0] for r in sample.select(F.col("text").substr(start.cast("int"), F.lit(4000))).collect()]
    tagger = Tagger()
    tagger.fit(*examples(texts))
    return tagger


_AT = re.compile(r"@|\bat\b")


def plausible(text: str, start: int, end: int, kind: int) -> bool:
    """Whether a labelled span has what its kind must have, however it is spelt: digits, their check, whole words."""
    own = text[start:end]
    around = text[start - 1 : start] + text[end : end + 1]
    if "\n" in own or any(c.isalnum() or c in "@_" for c in around):
        return False
    d = _digits(own)
    if kind == 0:
        return bool(_AT.search(own)) and any(c.isalpha() for c in own)
    if kind == 1:
        parts = re.findall("[0-9]+", own)
        return len(parts) == 4 and all(map(_octet, parts))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15


def windows(text: str) -> list[int]:
    """Starts of windows that have all of the text."""
    return list(range(0, max(1, len(text) - LAP), WIDE - LAP)) if text else []


Place = tuple[int, int, Span | None]  # text, a window's start, the cut span that it is run for


def _labels(tagger: Tagger, texts: list[np.ndarray], places: list[Place], width: int) -> Iterator[tuple[int, Span, float, bool]]:
    """Of texts' symbols: text, labelled span, its score, and whether an inner edge cuts it; of windows run for a span, those that touch it."""
    most = max(1, ROWS * WIDE // width)
    size = lambda place: min(width, len(texts[place[0]]) - place[1])
    places, c = sorted(places, key=size), 0  # so that few are padded
    while c < len(places):
        own = places[c : c + most * (PORTIONS if size(places[c]) == width else 1)]
        c += len(own)
        x = np.full((len(own), size(own[-1])), PADDING, np.uint8)
        for r, (i, a, _) in enumerate(own):
            s = texts[i][a : a + width]
            x[r, : len(s)] = s
        tags, score = tagger.decode(x)
        for r in np.flatnonzero((tags > 0).any(1)):
            i, a, of = own[r]
            n, t = min(width, len(texts[i]) - a), 0
            while t < n:
                if tags[r, t] == 0 or tags[r, t] % 2 == 0 and t > 0:  # an I that opens a window goes on from before it
                    t += 1
                    continue
                kind, e = (int(tags[r, t]) - 1) // 2, t + 1
                while e < n and tags[r, e] == 2 + 2 * kind:
                    e += 1
                cut = (t < EDGE and a > 0) or (e > width - EDGE and a + width < len(texts[i]))
                if of is None or (a + t < of[1] and of[0] < a + e):
                    s, f = (min(a + t, of[0]), max(a + e, of[1])) if cut and of else (a + t, a + e)  # a cut span never shrinks
                    yield i, (s, f, kind), float(score[r, t:e].mean()), cut
                t = e


def _wider(texts: list[str], cuts: dict[int, list[Span]], whole: dict[int, list[Span]]) -> dict[int, list[Place]]:
    """Windows around cut spans that lie in no whole span, by width: overlapping cuts are one, with its length on either side."""
    out: dict[int, list[Place]] = {}
    for i, own in cuts.items():
        have: dict[int, list[tuple[int, int]]] = {}
        for a, b, kind in sorted(whole.get(i, ())):
            ends = have.setdefault(kind, [])
            ends.append((a, max(b, ends[-1][1] if ends else 0)))  # the furthest end of those that begin by then
        joined: dict[int, list[list[int]]] = {}
        for s, e, kind in sorted(own):
            k = bisect_right(have.get(kind, []), (s, len(texts[i]) + 1))
            if k and have[kind][k - 1][1] >= e and any(a <= s and e <= b for a, b, other in whole[i] if other == kind):
                continue
            last = joined.setdefault(kind, [])
            if last and s <= last[-1][1]:
                last[-1][1] = max(last[-1][1], e)
            else:
                last.append([s, e])
        for kind, spans in joined.items():
            for s, e in spans:
                width = 2 * WINDOW
                while width < 3 * (e - s):
                    width *= 2
                start = max(0, min((s + e - width) // 2, len(texts[i]) - width))
                out.setdefault(width, []).append((i, start, (s, e, kind)))
    return out


def add_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Base spans and those that the tagger adds, by start, then kind."""
    found: dict[int, dict[Span, float]] = {}
    whole: dict[int, list[Span]] = {i: list(b) for i, b in enumerate(base)}
    todo: dict[int, list[Place]] = {WIDE: [(i, a, None) for i, t in enumerate(texts) for a in windows(t)]}
    symbols = [encode(t) for t in texts]
    while todo:
        cuts: dict[int, list[Span]] = {}
        for width, places in todo.items():
            for i, span, score, cut in _labels(tagger, symbols, places, width):
                if cut:
                    cuts.setdefault(i, []).append(span)
                    continue
                whole[i].append(span)
                text, (s, f, kind) = texts[i], span
                while s < f and text[s] in " \n":
                    s += 1
                while s < f and text[f - 1] in " \n.,;:":
                    f -= 1
                if plausible(text, s, f, kind):
                    held = found.setdefault(i, {})
                    held[s, f, kind] = max(held.get((s, f, kind), -np.inf), score)
        todo = _wider(texts, cuts, whole)
    out = [list(b) for b in base]
    for i, held in found.items():
        taken = [(s, e) for s, e, _ in base[i]]
        for s, e, kind in sorted(held, key=lambda x: (-held[x], x[0] - x[1], x)):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                out[i].append((s, e, kind))
        out[i].sort(key=lambda x: (x[0], x[2]))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind; overlapping ones by that of the first."""
    out, after = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s < after:
            if e > after:
                after = e
            continue
        out += [text[after:s], f"<{KINDS[kind].upper()}>"]
        after = e
    return "".join(out) + text[after:]



def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with about TOGETHER characters of text, or one that has more."""
    own, size = [], 0
    for batch in batches:
        if batch.num_rows:
            own.append(batch)
            size += batch["text"].nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(own)
            own, size = [], 0
    if own:
        yield pa.concat_batches(own)


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs (doc_id, text) -> counts of base spans, their digest, and all spans."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        base = [base_spans(t) for t in texts]
        spans = add_spans(tagger, texts, base)
        counts = [pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64()) for kind in range(4)]
        digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
        number = pa.array([len(s) for s in spans], pa.int64())
        out = [batch["doc_id"], *counts, digest, pa.array([written(s) for s in spans], pa.string()), number]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"])

    return in_arrow(docs.select("doc_id", "text"), lambda batches: map(each, _gathered(batches)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with text -> the same columns, all spans of text replaced; null text stays null."""
    columns = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        whole = [t or "" for t in texts]
        spans = add_spans(tagger, whole, [base_spans(t) for t in whole])
        new = pa.array([None if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([new if c == "text" else batch[c] for c in columns], names=columns)

    return in_arrow(docs, lambda batches: map(each, _gathered(batches)), docs.schema)
