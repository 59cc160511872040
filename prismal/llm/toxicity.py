"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

Each word enters as a hashed word embedding beside the mean of its hashed character n-gram
embeddings, so forms never seen in training are read by their letters. A window of `WINDOW`
words runs through a gated recurrent layer in both directions; attention pools the states to one
logit. A document's score is the calibrated logistic of its largest window logit; windows start
every `STRIDE` words and cover the whole text.

The network is trained in numpy, in a task of its own, on a bounded sample of labelled documents (`PER_CLASS` toxic
and twice as many others, spread over all by a hash; all windows of each). A label holds for a
document, so each training step follows only one window: that with the largest logit of `LOOK` drawn ones. A fifth of the sample is held back to fit the calibration.

Defined cases: null, empty and wordless texts score the sample's calibrated score of an empty
window; without labels of both classes all score the share of toxic labels (0 without any);
repeated rows are scored one by one; null labels are not learnt from; other columns pass through
(those that an output name clashes with are replaced).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text
from .langid import held_out

WINDOW, STRIDE = 64, 48
HIDDEN, ATTENTION, DIM, BITS = 16, 8, 12, 15
PER_CLASS, LOOK = 1000, 4
EPOCHS, BATCH, RATE = 5, 48, 0.01
CUT = 0.7
OUTPUTS = ("score", "predicted", "n_windows")
_TEXT_BLOCK = 2 << 20
_SLICE = 4096  # windows that go through the network at once


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then start[1], ...: `size` indices from each start."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Vocabulary:
    """The distinct words of a block: hash buckets, and buckets of their character n-grams."""

    def __init__(self, data: np.ndarray, words: _text.Words):
        hashes, first, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        self.bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        start, size = words.start[first], words.end[first] - words.start[first]
        flat = np.full(int(size.sum()) + 2 * len(size), 32, np.uint32)
        edge = np.cumsum(size + 2) - (size + 2)
        flat[stretches(edge + 1, size)] = _text.LOWER[data[stretches(start, size)]]
        grams, owner = [], []
        for n in (3, 4):
            count = np.maximum(size + 2 - n + 1, 0)
            at = stretches(edge, count)
            code = flat[at] | flat[at + 1] << np.uint32(8) | flat[at + 2] << np.uint32(16)
            if n == 4:
                code |= flat[at + 3] << np.uint32(24)
            code = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(13)
            code *= np.uint32(0xC2B2AE35)
            grams.append((code >> np.uint32(32 - BITS)).astype(np.int64))
            owner.append(np.repeat(np.arange(len(size)), count))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.grams, self.bound = np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(size) + 1))

    def __len__(self) -> int:
        return len(self.bucket)


def window_starts(n_words: int) -> list[int]:
    """Starts of overlapping windows that cover a text; the last one ends with it."""
    last = max(0, n_words - WINDOW)
    return [*range(0, last, STRIDE), last]


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x):
    """tanh by way of exp, which numpy vectorises."""
    y = _sigmoid(x * np.float32(2))
    y *= 2
    y -= 1
    return y


class Network:
    def __init__(self, rng: np.random.Generator):
        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        d, h = 2 * DIM, HIDDEN
        self.p = {"word": normal(1 << BITS, DIM, scale=0.1), "char": normal(1 << BITS, DIM, scale=0.3)}
        for way in "fb":
            self.p |= {
                f"W{way}": normal(d, 3 * h, scale=d**-0.5), f"c{way}": np.zeros(3 * h, np.float32),
                f"U{way}": normal(h, 3 * h, scale=h**-0.5), f"u{way}": np.zeros(3 * h, np.float32),
            }
        self.p |= {"A": normal(2 * h, ATTENTION, scale=0.3), "a": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION, scale=0.5), "w": normal(2 * h, scale=0.3), "o": np.zeros(1, np.float32)}
        self.scale, self.shift, self.prior = 1.0, 0.0, None

    def inputs(self, vocab: Vocabulary, use: np.ndarray | None = None, keep: np.ndarray | None = None):
        """Inputs of the words `use` (all by default) and a last row of zeros for padding."""
        use = np.arange(len(vocab)) if use is None else use
        size = vocab.bound[use + 1] - vocab.bound[use]
        grams = vocab.grams[stretches(vocab.bound[use], size)]
        x = np.zeros((len(use) + 1, 2 * DIM), np.float32)
        x[:-1, :DIM] = self.p["word"][vocab.bucket[use]]
        if keep is not None:
            x[:-1, :DIM] *= keep[:, None]
        for at in range(0, len(use), 20_000):  # in pieces that stay in cache
            part = size[at : at + 20_000]
            lo = int(size[:at].sum())
            g = self.p["char"][grams[lo : lo + int(part.sum())]]
            if len(part):
                x[at : at + len(part), DIM:] = np.add.reduceat(g, np.cumsum(part) - part, axis=0) / part[:, None]
        return x, grams, size

    def _run(self, way: str, proj: np.ndarray, idx: np.ndarray, trace: list | None = None) -> np.ndarray:
        n, steps, h3 = len(idx), idx.shape[1], HIDDEN
        out = np.empty((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        U, u = self.p[f"U{way}"], self.p[f"u{way}"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = proj[idx[:, t]]
            hu = h @ U
            hu += u
            gate = g[:, : 2 * h3] + hu[:, : 2 * h3]
            gate = _sigmoid(gate)
            z, r = gate[:, :h3], gate[:, h3:]
            c = _tanh(g[:, 2 * h3 :] + r * hu[:, 2 * h3 :])
            if trace is not None:
                trace.append((t, h, z, r, c, hu[:, 2 * h3 :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, mask: np.ndarray):
        """Logits of windows; states are (steps, windows, 2 * HIDDEN)."""
        s = _tanh(states @ self.p["A"] + self.p["a"])
        e = np.where(mask.T, s @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, states)
        return pooled @ self.p["w"] + self.p["o"], (s, e, pooled)

    def logits(self, x: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """Logits of windows given as rows of x; the last row of x is padding."""
        proj = {way: x @ self.p[f"W{way}"] + self.p[f"c{way}"] for way in "fb"}
        out = np.empty(len(idx), np.float32)
        for at in range(0, len(idx), _SLICE):
            part = idx[at : at + _SLICE]
            states = np.concatenate([self._run(way, proj[way], part) for way in "fb"], axis=2)
            out[at : at + _SLICE] = self._pool(states, part < len(x) - 1)[0]
        return out

    def gradients(self, vocab: Vocabulary, idx: np.ndarray, y: np.ndarray, rng: np.random.Generator):
        """Gradients of the mean log loss; idx holds words of vocab, with len(vocab) for padding."""
        p, h3 = self.p, HIDDEN
        use, inverse = np.unique(idx, return_inverse=True)
        inverse = inverse.reshape(idx.shape)
        if use[-1] == len(vocab):
            use = use[:-1]
        keep = (rng.random(len(use)) < 0.5).astype(np.float32)  # words hide, so that letters are learnt too
        x, grams, size = self.inputs(vocab, use, keep)
        proj = {way: x @ p[f"W{way}"] + p[f"c{way}"] for way in "fb"}
        traces = {"f": [], "b": []}
        states = np.concatenate([self._run(way, proj[way], inverse, traces[way]) for way in "fb"], axis=2)
        z, (s, e, pooled) = self._pool(states, idx < len(vocab))
        prob = 1 / (1 + np.exp(-z))
        dz = ((prob - y) / len(y)).astype(np.float32)
        g = {"w": pooled.T @ dz, "o": dz.sum(keepdims=True)}
        dp = dz[:, None] * p["w"]
        de = np.einsum("tnh,nh->tn", states, dp)
        de = e * (de - (e * de).sum(axis=0))
        g["v"] = np.einsum("tnk,tn->k", s, de)
        ds = de[:, :, None] * p["v"] * (1 - s * s)
        g["A"], g["a"] = np.einsum("tnh,tnk->hk", states, ds), ds.sum(axis=(0, 1))
        dstates = e[:, :, None] * dp + ds @ p["A"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            dproj = np.empty((idx.shape[1], len(idx), 3 * h3), np.float32)
            dU, du, dh = np.zeros_like(p[f"U{way}"]), np.zeros_like(p[f"u{way}"]), np.zeros((len(idx), h3), np.float32)
            for t, h, zt, r, c, hu in reversed(traces[way]):
                dh = dh + dstates[t, :, k * h3 : (k + 1) * h3]
                dc = dh * (1 - zt) * (1 - c * c)
                dzt = dh * (h - c) * zt * (1 - zt)
                dr = dc * hu * r * (1 - r)
                back = np.concatenate([dzt, dr, dc * r], axis=1)
                dproj[t] = np.concatenate([dzt, dr, dc], axis=1)
                dU += h.T @ back
                du += back.sum(axis=0)
                dh = dh * zt + back @ p[f"U{way}"].T
            flat, order = dproj.transpose(1, 0, 2).reshape(-1, 3 * h3), np.argsort(inverse.ravel(), kind="stable")
            cuts = np.searchsorted(inverse.ravel()[order], np.arange(len(x)))
            total = np.zeros((len(x), 3 * h3), np.float32)
            some = np.flatnonzero(np.diff(np.append(cuts, len(order))))
            total[some] = np.add.reduceat(flat[order], cuts[some], axis=0)
            g[f"U{way}"], g[f"u{way}"] = dU, du
            g[f"W{way}"], g[f"c{way}"] = x.T @ total, total.sum(axis=0)
            dx += total @ p[f"W{way}"].T
        dx = dx[:-1]
        g["word"] = (vocab.bucket[use], dx[:, :DIM] * keep[:, None])
        g["char"] = (grams, np.repeat(dx[:, DIM:] / size[:, None], size, axis=0))
        return g


class Adam:
    """Adam; embedding tables get it on the rows that a step touches."""

    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in params.items()}
        self.v = {k: np.zeros_like(x) for k, x in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = slice(None)
            if isinstance(g, tuple):
                at, inverse = np.unique(g[0], return_inverse=True)
                g = np.stack([np.bincount(inverse, weights=c, minlength=len(at)) for c in g[1].T], axis=1).astype(np.float32)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.params[k][at] -= rate * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-6)


def train(rows: list[tuple[int, list[str]]], seed: int = 11) -> Network:
    """rows: (label, windows as words joined by spaces); at least one window each."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    y = np.array([label for label, _ in rows], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    flat = pa.array([w for _, windows in rows for w in windows], pa.string())
    data, offsets = _text.column_bytes(flat)
    words = _text.Words(data, offsets, _text.ALNUM)
    vocab = Vocabulary(data, words)
    idx = np.full((len(flat), WINDOW), len(vocab), dtype=np.int64)
    for i, (a, b) in enumerate(zip(words.bound[:-1].tolist(), words.bound[1:].tolist())):
        idx[i, : min(b - a, WINDOW)] = vocab.of[a : min(b, a + WINDOW)]
    first = np.concatenate([[0], np.cumsum([len(w) for _, w in rows])])
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    if len(set(y[used].tolist())) < 2:
        used = order
    adam = Adam(net.p, RATE)
    toxic, clean = used[y[used] == 1], used[y[used] == 0]
    for epoch in range(EPOCHS):
        for _ in range(max(60, -(-len(used) // BATCH))):
            pick = np.concatenate([rng.choice(toxic, BATCH // 2), rng.choice(clean, BATCH // 2)])
            windows = np.array([first[i] + rng.integers(0, first[i + 1] - first[i], LOOK) for i in pick])
            if epoch:  # the label need hold in one window only
                shown = idx[windows.ravel()]
                use, inverse = np.unique(shown, return_inverse=True)
                x, _, _ = net.inputs(vocab, use[use < len(vocab)])
                z = net.logits(x, inverse.reshape(shown.shape)).reshape(windows.shape)
                best = windows[np.arange(len(pick)), z.argmax(axis=1)]
            else:
                best = windows[:, 0]
            adam.step(net.gradients(vocab, idx[best], y[pick], rng))
        adam.rate *= 0.7
    check = held if len(held) and len(set(y[held].tolist())) == 2 else order
    every = np.concatenate([np.arange(first[i], first[i + 1]) for i in check])
    use, inverse = np.unique(idx[every], return_inverse=True)
    x, _, _ = net.inputs(vocab, use[use < len(vocab)])
    z = net.logits(x, inverse.reshape(-1, WINDOW))
    cut = np.cumsum([0] + [first[i + 1] - first[i] for i in check])[:-1]
    net.scale, net.shift = _platt(np.maximum.reduceat(z, cut), y[check])
    return net


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift of a logistic fit with smoothed targets, classes weighted alike."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    scale, shift = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
        d = weight * (p - target)
        scale, shift = max(1e-3, scale - 0.5 * float((d * z).sum())), shift - 0.5 * float(d.sum())
    return scale, shift


def _windows(batches):
    """All windows of each whole text."""
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, "text"):
            words = _text.Words(data, offsets, _text.ALNUM)
            lower, out = _text.LOWER[data], []
            for a, b in zip(words.bound[:-1].tolist(), words.bound[1:].tolist()):
                own = [lower[x:y].tobytes().decode() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
                out.append([" ".join(own[s : s + WINDOW]) for s in window_starts(b - a)])
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "windows"])


def _trained(batches):
    """The network of all rows, whatever their order."""
    rows = sorted(r for b in batches for r in zip(b.column("label").to_pylist(), b.column("windows").to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], ["net"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """A network from a sample of about `per_class` toxic documents and twice as many others.

    The labels are drawn first, by a hash, and only those few are sent to the documents' scan.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / counts.get(1, 1)))).otherwise(F.lit(min(1.0, 2 * per_class / counts.get(0, 1))))
    draw = F.xxhash64("id", F.lit("toxicity"))
    chosen = rows.where(F.pmod(draw, F.lit(1 << 30)) < share * float(1 << 30)).orderBy(draw, "id", "label").limit(6 * per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "id")
    sample = texts.select("text", "label").mapInArrow(_windows, "label int, windows array<string>")
    made = sample.repartition(1).mapInArrow(_trained, "net binary").collect()  # the sample is bounded; the driver gets parameters only
    net = pickle.loads(made[0]["net"]) if made else train([])
    if net.prior is not None:
        net.prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return net


def _scores(batches, net: Network, text_col: str, keep: list[str]):
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col, _TEXT_BLOCK):
            words = _text.Words(data, offsets, _text.ALNUM)
            starts = [window_starts(n) for n in np.diff(words.bound).tolist()]
            count = np.array([len(s) for s in starts])
            if net.prior is None:
                vocab = Vocabulary(data, words)
                x, _, _ = net.inputs(vocab)
                first = np.array([a + s for a, own in zip(words.bound[:-1].tolist(), starts) for s in own])
                end = np.repeat(words.bound[1:], count)
                at = first[:, None] + np.arange(WINDOW)
                of = np.append(vocab.of, len(vocab))
                idx = np.where(at < end[:, None], of[np.minimum(at, len(of) - 1)], len(vocab))
                z = np.maximum.reduceat(net.logits(x, idx), np.cumsum(count) - count)
                score = 1 / (1 + np.exp(-np.clip(net.scale * z.astype(np.float64) + net.shift, -30, 30)))
            else:
                score = np.full(len(rows), net.prior)
            arrays = [rows.column(c) for c in keep] + [pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *OUTPUTS])


def toxicity(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs plus score, predicted (score >= CUT) and n_windows; only the text is looked at."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    outs = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_windows", T.LongType())]
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lambda b: _scores(b, sent.value, text_col, keep), T.StructType([docs.schema[c] for c in keep] + outs))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole document's score, learnt from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(of=3, rest=1)
    net = fit(docs, labels.where(~out))
    return toxicity(docs.select("doc_id", out.alias("held_out"), "text"), net).select("doc_id", "held_out", "score", "predicted", "n_windows")
