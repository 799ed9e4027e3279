"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of whole texts and labels every position; a document's
probabilities are the mean over all its positions.  A long text is read in windows: STRIDE
positions that count, and CONTEXT more on either side from which both ways of the network
warm up and which count for the neighbours.  A text of at most STRIDE bytes is one window.
Windows of about one length run together, so no text, and no word, is too long or cut
without its surroundings, whether it has spaces or not.

Training, in numpy by backpropagation through time, is on a bounded sample: at most
SAMPLE_DOCS documents, as many of each language, chosen by a hash of their id, and of each a
stretch of SAMPLE_CHARS characters.  Every position is labelled with its document's
language.  Labels, sources and ids are never an input of a prediction.

Null text, or text without a letter: `und`, score 0.  Documents without a label or an id,
and those held out (crc32 of the id modulo 5 is 0), aren't learned from; without any
labelled document all are `und`.  Of rows with equal id and label one is learned from.
Repeated rows get equal predictions.  An empty table gives no rows.  Other columns stay,
whatever their names, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, portions, schema_with

SAMPLE_DOCS, SAMPLE_CHARS = 1200, 3000
HIDDEN, EMBED, STEPS, BATCH, LENGTH, RATE = 24, 16, 300, 96, 48, 0.01
STRIDE, CONTEXT, TOGETHER = 464, 24, 256
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


class Network:
    """A GRU each way, and a softmax at every position.  Arrays are (time, unit, batch)."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, c = HIDDEN, len(labels)
        self.labels = labels
        self.w = {"embed": rng.normal(0, 0.3, (256, EMBED)), "out": rng.normal(0, 0.2, (c, 2 * h)), "bias": np.zeros((c, 1))}
        for way in "fb":
            self.w[f"in_{way}"] = rng.normal(0, EMBED**-0.5, (3 * h, EMBED))
            self.w[f"gate_{way}"] = np.zeros((3 * h, 1))
            self.w[f"own_{way}"] = rng.normal(0, h**-0.5, (3 * h, h))
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def _run(self, x: np.ndarray, way: str, ends: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """x (time, batch) bytes -> states (time, HIDDEN, batch); the backward way reads from the end, each column from its own."""
        h, own = HIDDEN, self.w[f"own_{way}"].copy()
        fed = self.w[f"in_{way}"] @ self.w["embed"].T + self.w[f"gate_{way}"]  # a column for each byte
        for part in (own, fed):  # a sigmoid is a tanh of half its argument
            part[: 2 * h] *= 0.5
        fed = np.ascontiguousarray(fed.T)
        state = np.zeros((h, x.shape[1]), own.dtype)
        out = np.empty((len(x), *state.shape), own.dtype)
        a, u = np.empty((3 * h, x.shape[1]), own.dtype), np.empty((3 * h, x.shape[1]), own.dtype)
        first = len(x) if ends is None or way == "f" else int(ends.min())
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            np.copyto(a, fed[x[t]].T)
            np.matmul(own, state, out=u)
            gates = a[: 2 * h]
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = gates[h:] * u[2 * h :]
            new += a[2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, gates[:h].copy(), gates[h:].copy(), new, u[2 * h :].copy()))
            after = out[t]
            np.subtract(state, new, out=after)
            after *= gates[:h]
            after += new
            if t >= first:
                after *= t < ends
            state = after
        return out

    def positions(self, x: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, label, batch); ends: how much of each column of x is text."""
        h = HIDDEN
        y = np.matmul(self.w["out"][:, :h], self._run(x, "f", ends))
        y += np.matmul(self.w["out"][:, h:], self._run(x, "b", ends))
        y += self.w["bias"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def learn(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross entropy over all positions of x (time, batch)."""
        h, (n, b) = HIDDEN, x.shape
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(x, w, keep=kept[w]) for w in "fb"], axis=1)
        y = np.matmul(self.w["out"], both) + self.w["bias"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        dy = y / y.sum(axis=1, keepdims=True)
        dy[:, label, np.arange(b)] -= 1
        dy /= x.size
        g = {"out": np.matmul(dy, both.transpose(0, 2, 1)).sum(0), "bias": dy.sum((0, 2))[:, None], "embed": np.zeros_like(self.w["embed"])}
        dboth = np.matmul(self.w["out"].T, dy)
        order = np.argsort(x.ravel(), kind="stable")
        met, starts = np.unique(x.ravel()[order], return_index=True)
        for k, way in enumerate("fb"):
            own, dstate = self.w[f"own_{way}"], np.zeros((h, b), both.dtype)
            din, down = np.empty((3 * h, n, b), both.dtype), np.zeros_like(own)
            for t, before, z, r, new, u in reversed(kept[way]):
                d = dboth[t, k * h : (k + 1) * h] + dstate
                dnew = d * (1 - z) * (1 - new**2)
                dz, dr = d * (before - new) * z * (1 - z), dnew * u * r * (1 - r)
                din[:, t] = np.concatenate([dz, dr, dnew])
                du = np.concatenate([dz, dr, dnew * r])
                down += du @ before.T
                dstate = d * z + own.T @ du
            dfed = np.zeros((3 * h, 256), both.dtype)
            dfed[:, met] = np.add.reduceat(din.reshape(3 * h, -1)[:, order], starts, axis=1)
            g[f"own_{way}"], g[f"gate_{way}"] = down, dfed.sum(1, keepdims=True)
            g[f"in_{way}"] = dfed @ self.w["embed"]
            g["embed"] += dfed.T @ self.w[f"in_{way}"]
        return g

    def fit(self, texts: list[bytes], label: np.ndarray, seed: int = 6) -> None:
        """Adam over batches of stretches of LENGTH bytes; a shorter text is repeated."""
        rng = np.random.default_rng(seed)
        texts = [np.frombuffer((t + b" ") * -(-LENGTH // (len(t) + 1)), np.uint8) for t in texts]
        m = {k: np.zeros_like(x) for k, x in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, STEPS + 1):
            at = rng.integers(len(texts), size=BATCH)
            starts = [int(rng.integers(len(texts[i]) - LENGTH + 1)) for i in at]
            x = np.stack([texts[i][a : a + LENGTH] for i, a in zip(at, starts, strict=True)], axis=1)
            g = self.learn(x, label[at])
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, w in self.w.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, label): mean probabilities over all positions of each text; zero where a text is empty."""
        places = [(i, a) for i, t in enumerate(texts) for a in range(0, len(t), STRIDE)]
        spans = [(max(0, a - CONTEXT), min(len(texts[i]), a + STRIDE + CONTEXT)) for i, a in places]
        sums = np.zeros((len(texts), len(self.labels)))
        order = sorted(range(len(places)), key=lambda k: spans[k][1] - spans[k][0])
        for c in range(0, len(order), TOGETHER):
            own = order[c : c + TOGETHER]
            ends = np.array([spans[k][1] - spans[k][0] for k in own])
            x = np.full((len(own), int(ends[-1])), 32, np.uint8)
            for row, k in enumerate(own):
                a, b = spans[k]
                x[row, : b - a] = np.frombuffer(texts[places[k][0]], np.uint8, b - a, a)
            p = self.positions(np.ascontiguousarray(x.T), ends)
            inner = p[CONTEXT : CONTEXT + STRIDE].sum(axis=0)
            for column, k in enumerate(own):
                i, a = places[k]
                low, high = a - spans[k][0], min(a + STRIDE, len(texts[i])) - spans[k][0]
                whole = low == CONTEXT and high == CONTEXT + STRIDE
                sums[i] += inner[:, column] if whole else p[low:high, :, column].sum(axis=0)
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        read = [t.encode("utf-8", "surrogatepass") if t and has_letter(t) else b"" for t in texts]
        p = self.pooled(read)
        label = [self.labels[k] if t else UNKNOWN for k, t in zip(p.argmax(axis=1), read, strict=True)]
        return label, np.minimum(1.0, p.max(axis=1, initial=0.0))


def train(docs: DataFrame) -> Network | None:
    """A network from labelled documents (doc_id, text, lang), without those held out."""
    learned = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    learned = learned.select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: r["count"] for r in learned.groupBy("lang").count().collect()}  # a label each, which the network has anyway
    if not counts:
        return None
    most = max(1, SAMPLE_DOCS // len(counts))
    # Hashes are even, so half as many again as wanted lie below this share of their range.
    low, span = -(2**63), 2**64 - 1
    bounds = [(k, low + min(span, int(span * 1.5 * most / n))) for k, n in counts.items()]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    learned = learned.join(bounds, "lang").filter("h <= bound")
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)) + 1
    learned = learned.select("lang", "h", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    sample = learned.groupBy("lang", "h").agg(F.min("text").alias("text")).collect()  # a row an id, however often it comes
    by: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        by.setdefault(r["lang"], []).append(r)
    sample = [r for own in by.values() for r in own[:most]]
    sample = [r for r in sample if r["text"]]
    labels = sorted({r["lang"] for r in sample})
    net = Network(labels)
    if len(labels) > 1:
        net.fit([r["text"].encode("utf-8", "surrogatepass") for r in sample], np.array([labels.index(r["lang"]) for r in sample]))
    return net if labels else None


def held_out():
    """A Column: whether the crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with text -> all their columns and lang_pred, score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        label, score = [], []
        if net is None:
            label, score = [UNKNOWN] * len(texts), [np.zeros(len(texts))]
        else:
            for a, b in portions([t or "" for t in texts]):
                own = net.predict(texts[a:b])
                label += own[0]
                score.append(own[1])
        score = np.concatenate(score) if score else np.zeros(0)
        return pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(label, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in columns])
    return arrow_pass(kept, each, schema_with(kept, "lang_pred string, score double"))
