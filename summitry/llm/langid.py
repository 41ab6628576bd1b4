"""Language id with a bidirectional gated recurrent network over bytes.

Texts become lower-cased letter bytes (runs of anything else are one blank), cut
into windows of ``WINDOW`` bytes.  Two gated recurrent layers read each window
from either end, a softmax labels every position, and the mean of the letter
positions' probabilities is the document's.  Weights are trained in numpy by
backpropagation through time, on the driver, from a bounded sample of rows.

Edge cases: null text and text without a letter give ``und`` with score 0; so does
everything where no row can be learned from; ties between languages go to the
first in sorted order; very long texts are read whole, block by block; repeated rows
get the same answer each; an empty table gives no rows; input columns other than
doc_id and text are never read for a prediction.  Learning takes ``PER_ROW`` windows
of each sampled row, spread over its whole text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops, common

UNDETERMINED = "und"
#: Bytes that the network sees at once when labelling, and when learning.
WINDOW, LEARN_WINDOW = 64, 32
HIDDEN = 8
#: The training sample: rows for each language, windows from each row.
PER_LANGUAGE, PER_ROW = 400, 16
STEPS, BATCH, RATE = 300, 512, 0.03
LANES = 2048

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _a in (65, 97):
    _FOLD[_a : _a + 26] = np.arange(97, 123)


def fold(text: bytes) -> np.ndarray:
    """Letter bytes in lower case, with single blanks between runs."""
    x = _FOLD[np.frombuffer(text, np.uint8)]
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    return x[keep]


def has_letter(text: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Network:
    """Arrays are (features, lanes), so that every gate is a contiguous block."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n, h = len(languages), hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, h**-0.5, (3 * h, h)).astype(np.float32)
        self.w["o"] = rng.normal(0, (2 * h) ** -0.5, (n, 2 * h)).astype(np.float32)
        self.w["c"] = np.zeros((n, 1), np.float32)

    def _direction(self, d: str, windows: np.ndarray, trace: list | None = None):
        """States (time, hidden, lanes) of one direction."""
        x_table, u, h = self.w["x" + d], self.w["u" + d], self.hidden
        t, lanes = windows.shape
        states = np.empty((t, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        for at in range(t) if d == "f" else range(t - 1, -1, -1):
            gates = np.take(x_table, windows[at], axis=1)
            inner = u @ state
            gates[: 2 * h] += inner[: 2 * h]
            both = gates[: 2 * h]
            both *= np.float32(0.5)
            np.tanh(both, out=both)
            both += np.float32(1)
            both *= np.float32(0.5)
            update, reset = gates[:h], gates[h : 2 * h]
            new = gates[2 * h :]
            new += reset * inner[2 * h :]
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((at, state, update, reset, new, inner[2 * h :]))
            state = new + update * (state - new)
            states[at] = state
        return states

    def positions(self, windows: np.ndarray, traces: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (time, languages, lanes) of every position, and the states under them."""
        states = np.concatenate([self._direction(d, windows, traces.setdefault(d, []) if traces is not None else None) for d in "fb"], axis=1)
        logits = np.matmul(self.w["o"], states)
        logits += self.w["c"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, states

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time; blanks at the end have no say."""
        traces: dict = {}
        p, states = self.positions(windows, traces)
        t, n, lanes = p.shape
        h = self.hidden
        counts = (windows != 32).astype(np.float32)
        total = max(1.0, float(counts.sum()))
        hit = p[:, target, np.arange(lanes)]
        loss = float(-(np.log(hit + 1e-9) * counts).sum() / total)
        delta = p.copy()
        delta[:, target, np.arange(lanes)] -= 1
        delta *= counts[:, None] / total
        g = {"o": np.einsum("tnl,thl->nh", delta, states, optimize=True), "c": delta.sum((0, 2))[:, None]}
        down = np.matmul(self.w["o"].T, delta)
        for k, d in enumerate("fb"):
            u = self.w["u" + d]
            gu, gx = np.zeros_like(u), np.zeros((3 * h, 256), np.float32)
            carry = np.zeros((h, lanes), np.float32)
            for at, before, update, reset, new, inner in reversed(traces[d]):
                ds = carry + down[at, k * h : (k + 1) * h]
                d_new = ds * (1 - update) * (1 - new * new)
                d_update = ds * (before - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                d_pre = np.concatenate((d_update, d_reset, d_new))
                d_inner = np.concatenate((d_update, d_reset, d_new * reset))
                gu += d_inner @ before.T
                order = windows[at].astype(np.int64)
                for row in range(3 * h):
                    gx[row] += np.bincount(order, d_pre[row], 256)
                carry = ds * update + u.T @ d_inner
            g["u" + d], g["x" + d] = gu, gx
        return loss, g

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam over batches in which every language has the same share."""
        rng = np.random.default_rng(seed)
        places = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = math.nan
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(x, max(1, batch // len(places))) for x in places])
            loss, g = self.gradients(np.ascontiguousarray(windows[pick].T), target[pick])
            norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps)) / max(1.0, norm / 5)
            for k, x in g.items():
                first[k] += 0.1 * (x - first[k])
                second[k] += 0.01 * (x * x - second[k])
                self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, languages); rows without letters are 0."""
        sums = np.zeros((len(texts), len(self.languages)))
        for a, b in bytesops.blocks(texts, LANES * WINDOW):
            folded = [fold(t) for t in texts[a:b]]
            n = [-(-len(x) // WINDOW) for x in folded]
            if not sum(n):
                continue
            flat = np.full(sum(n) * WINDOW, 32, np.uint8)
            at = 0
            for x, k in zip(folded, n):
                flat[at : at + len(x)] = x
                at += k * WINDOW
            windows, owner = flat.reshape(-1, WINDOW), np.repeat(np.arange(a, b), n)
            for i in range(0, len(windows), LANES):
                part = np.ascontiguousarray(windows[i : i + LANES].T)
                p, _ = self.positions(part)
                p *= (part != 32)[:, None]
                pooled = p.sum(0)
                for k in range(len(self.languages)):
                    sums[:, k] += np.bincount(owner[i : i + LANES], pooled[k], len(texts))
        total = sums.sum(1, keepdims=True)
        return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)

    def label(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        p = self.documents(texts) if self.languages else np.zeros((len(texts), 0))
        best = p.argmax(1) if p.shape[1] else np.zeros(len(texts), int)
        names, scores = [], []
        for i, t in enumerate(texts):
            known = bool(p.shape[1]) and has_letter(t) and p[i].sum() > 0
            names.append(self.languages[best[i]] if known else UNDETERMINED)
            scores.append(float(min(1.0, p[i, best[i]])) if known else 0.0)
        return names, scores


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of a bounded, evenly drawn sample of the rows that may be learned from."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out()
    counts = {r["lang"]: r["count"] for r in docs.where(usable).groupBy("lang").count().collect()}
    if not counts:
        return [], np.empty((0, LEARN_WINDOW), np.uint8), np.empty(0, int)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.5 * per_language / n) * (1 << 30)))])
    sample = docs.where(usable & (draw < share[F.col("lang")])).select("lang", "text", draw.alias("draw"))

    def cut(batches):
        for b in batches:
            langs, windows = [], []
            for lang, text in zip(b.column("lang").to_pylist(), bytesops.texts_of(b.column("text"))):
                x = fold(text)
                places = np.linspace(0, max(0, len(x) - LEARN_WINDOW), min(PER_ROW, 1 + len(x) // LEARN_WINDOW)).astype(int)
                for at in sorted(set(places.tolist())) if len(x) else ():
                    langs.append(lang)
                    windows.append(x[at : at + LEARN_WINDOW].tobytes().ljust(LEARN_WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    limited = sample.orderBy("draw", F.crc32(F.encode("text", "UTF-8"))).limit(2 * per_language * len(counts))
    rows = sorted(common.in_arrow(limited, cut, "lang string, window binary", "langid").collect(), key=lambda r: (r["lang"], bytes(r["window"])))
    languages = sorted({r["lang"] for r in rows})
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, LEARN_WINDOW)
    return languages, windows, np.array([languages.index(r["lang"]) for r in rows], int)


def train(docs: DataFrame) -> Network:
    languages, windows, target = training_windows(docs)
    network = Network(languages)
    if languages:
        network.fit(windows, target)
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches):
        for b in batches:
            names, scores = network.label(bytesops.texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return common.in_arrow(docs.select("doc_id", common.held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double", "langid")


def keep_identified(docs: DataFrame, network: Network, least: float = 0.35) -> DataFrame:
    """Rows whose language is known with a pooled probability of ``least``; all columns."""

    def run(batches):
        for b in batches:
            names, scores = network.label(bytesops.texts_of(b.column("text")))
            yield b.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return common.in_arrow(docs, run, docs.schema, "langid")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
