"""LM scoring: masked pseudo-likelihood of whole documents under a bidirectional window network.

Each token is predicted from the `SIDE` tokens on either side of it: their embeddings, projected by
position, make a hidden layer; two levels of softmax, both fed by it, give the token's class and the
token among the words of its class. A document's score is the sum of its tokens' conditional
log-probabilities (its pseudo-log-likelihood).

* Vocabulary: all words of all documents are counted by Spark, exactly. The `VOCAB` commonest have an
  embedding and an output of their own; the others form one more class, in which a word has the share of its count
  bucket (2**RARE_BITS of them), and 2**ROW_BITS embeddings.
* Network: numpy with AdaGrad, started on a bounded sample (`WARM` documents, up to `WARM_TOKENS` targets
  drawn over the whole text of each). Then every token of every document is a target once: documents are
  dealt into shards by a hash of their columns (one for each `SHARD_TOKENS` tokens, `SHARDS` at least), the shards
  into `ROUNDS` rounds. In a round each shard goes over its documents, in the order of their hash, from the
  common start, and the changes are averaged by tokens, parameter by parameter, in an aggregation.

Shards and their order follow from the rows alone, so the scores do not depend on the table's partitions
(but for rounding). A shard streams through its task, whatever its size.

Defined cases: null, empty and wordless texts have no tokens, score 0 and a null mean; places beyond a
document's ends are a token of their own; an empty table gives no rows; repeated rows count and are
scored each; other columns pass through (those that an output name clashes with are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text

VOCAB, RARE_BITS, ROW_BITS = 8192, 16, 10
SIDE, DIM, HIDDEN = 3, 16, 24
WARM, WARM_TOKENS, WARM_EPOCHS = 1500, 128, 3
SHARD_TOKENS, SHARDS, ROUNDS = 4_000_000, 8, 2
BATCH, WARM_BATCH, RATE, SCORED = 16384, 512, 0.1, 16384
#: Rows whose logits are taken at once, so that they stay in a core's cache.
PIECE = 2048
OUTPUTS = ("n_tokens", "pll", "pll_mean")
_PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


class Model:
    """Vocabulary, shares of rare words and the network's parameters with the sums of their squared gradients.

    p: emb (an embedding for each word, rare row and the edge), w and b (hidden layer), u and c (classes),
    v and d (words of a class). Words are numbered by falling frequency; class k holds those of [k * size, (k + 1) * size).
    """

    def __init__(self, hashes: np.ndarray, rare: np.ndarray, seed: int = 5):
        self.n = len(hashes)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.size = max(1, int(np.ceil(np.sqrt(self.n))))
        self.classes = -(-self.n // self.size)
        smooth = rare + 0.5
        self.log_share = np.log(smooth / smooth.sum())
        rows = self.n + (1 << ROW_BITS) + 1
        shapes = {"emb": (rows, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "u": (HIDDEN, self.classes + 1), "c": (self.classes + 1,), "v": (self.n, HIDDEN), "d": (self.n,)}
        rng = np.random.default_rng(seed)
        scale = {"emb": 0.3, "w": (2 * SIDE * DIM) ** -0.5, "u": 0.1, "v": 0.1}
        self.p = {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.g = {k: np.full(s, 0.1, np.float32) for k, s in shapes.items()}

    def copy(self) -> "Model":
        other = Model.__new__(Model)
        other.__dict__ = {**self.__dict__, "p": {k: v.copy() for k, v in self.p.items()}, "g": {k: v.copy() for k, v in self.g.items()}}
        return other

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers: their place in the vocabulary, or behind it by bucket."""
        h = hashes.view(np.int64)
        rare = self.n + (hashes >> np.uint64(64 - RARE_BITS)).astype(np.int64)
        if not self.n:
            return rare
        at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
        return np.where(self.hashes[at] == h, self.by_hash[at], rare)

    def contexts(self, tokens: np.ndarray, bound: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Embedding rows around the tokens `at`: (tokens, 2 * SIDE)."""
        edge = len(self.p["emb"]) - 1
        inputs = np.where(tokens < self.n, tokens, self.n + ((tokens - self.n) >> (RARE_BITS - ROW_BITS)))
        doc = np.searchsorted(bound, at, "right") - 1
        lo, hi = bound[doc], bound[doc + 1]
        out = np.empty((len(at), 2 * SIDE), np.int64)
        for k, p in enumerate(_PLACES):
            q = at + p
            out[:, k] = np.where((q >= lo) & (q < hi), inputs[np.clip(q, 0, len(tokens) - 1)], edge)
        return out

    def by_class(self, y: np.ndarray):
        """The rows of each class of words among the targets, PIECE at a time: (rows, first word, end of words)."""
        of = np.minimum(y // self.size, self.classes) if self.n else np.zeros(len(y), np.int64)
        of[y >= self.n] = self.classes
        small = of.astype(np.uint16)  # short keys are sorted by radix
        order = np.argsort(small, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.classes + 1))])
        parts = [(order[at : min(b, at + PIECE)], k * self.size, min(self.n, (k + 1) * self.size)) for k, (a, b) in enumerate(zip(cuts[:-2].tolist(), cuts[1:-1].tolist())) for at in range(a, b, PIECE)]
        return of, parts

    def _embedded(self, ctx: np.ndarray) -> np.ndarray:
        return self.p["emb"].take(ctx.ravel(), axis=0).reshape(len(ctx), -1)

    def _move(self, name: str, at, grad: np.ndarray, rate: float) -> None:
        self.g[name][at] += grad * grad
        self.p[name][at] -= rate * grad / np.sqrt(self.g[name][at])

    def step(self, ctx: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One stochastic gradient step; the mean log loss before it."""
        p, n = self.p, len(y)
        of, parts = self.by_class(y)
        h, loss = np.empty((n, HIDDEN), p["w"].dtype), 0.0
        dh, grad = np.empty_like(h), {k: np.zeros_like(p[k]) for k in ("w", "b", "u", "c", "v", "d")}
        tame = _bounded(p["u"], p["c"])
        for lo in range(0, n, PIECE):
            x, mine = self._embedded(ctx[lo : lo + PIECE]), of[lo : lo + PIECE]
            own = h[lo : lo + PIECE] = np.tanh(x @ p["w"] + p["b"])
            e = own @ p["u"]
            e += p["c"]
            e, at = _softmax(e, tame), np.arange(len(own))
            loss -= np.log(e[at, mine] + 1e-30).sum()
            e[at, mine] -= 1
            dh[lo : lo + PIECE] = e @ p["u"].T
            grad["u"] += own.T @ e
            grad["c"] += _sums(e)
        tame = _bounded(p["v"].T, p["d"])
        for rows, a, b in parts:
            own = h[rows]
            s = own @ p["v"][a:b].T
            s += p["d"][a:b]
            s, mine, at = _softmax(s, tame), y[rows] - a, np.arange(len(rows))
            loss -= np.log(s[at, mine] + 1e-30).sum()
            s[at, mine] -= 1
            dh[rows] += s @ p["v"][a:b]
            grad["v"][a:b] += s.T @ own
            grad["d"][a:b] += _sums(s)
        dh *= 1 - h * h
        # gradients of the embeddings, one dimension at a time over all places: no sorting of the contexts
        each = np.zeros((DIM, len(p["emb"])))
        for lo in range(0, n, 4 * PIECE):
            own, near = dh[lo : lo + 4 * PIECE], ctx[lo : lo + 4 * PIECE]
            grad["w"] += self._embedded(near).T @ own
            grad["b"] += _sums(own)
            flat, dx = near.T.ravel(), (p["w"] @ own.T).reshape(2 * SIDE, DIM, len(own))
            for k in range(DIM):
                each[k] += np.bincount(flat, weights=dx[:, k].ravel(), minlength=each.shape[1])
        grad["emb"] = each.T.astype(p["emb"].dtype)
        for name, g in grad.items():
            self._move(name, ..., g, rate)
        return float(loss / n)

    def steps(self, ctx: np.ndarray, y: np.ndarray, batch: int, rate: float) -> None:
        order = np.random.default_rng(len(y)).permutation(len(y))
        for lo in range(0, len(y), batch):
            self.step(ctx[order[lo : lo + batch]], y[order[lo : lo + batch]], rate)

    def log_probabilities(self, tokens: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The conditional log-probability of every token of a block."""
        p = self.p
        parts = [p["emb"] @ p["w"][k * DIM : (k + 1) * DIM] for k in range(2 * SIDE)]
        tame = _bounded(p["u"], p["c"]), _bounded(p["v"].T, p["d"])
        out = np.empty(len(tokens))
        for lo in range(0, len(tokens), SCORED):
            at = np.arange(lo, min(len(tokens), lo + SCORED))
            ctx, y = self.contexts(tokens, bound, at), tokens[at]
            of, classes = self.by_class(y)
            h, score = np.empty((len(y), HIDDEN), p["w"].dtype), np.empty(len(y))
            for a in range(0, len(y), PIECE):
                x = p["b"] + parts[0].take(ctx[a : a + PIECE, 0], axis=0)
                for k in range(1, 2 * SIDE):
                    x += parts[k].take(ctx[a : a + PIECE, k], axis=0)
                x *= -2  # tanh by way of exp, which numpy vectorises
                np.exp(np.minimum(x, 60, out=x), out=x)
                x = h[a : a + PIECE] = 2 / (1 + x) - 1
                z = x @ p["u"]
                z += p["c"]
                score[a : a + PIECE] = _log_softmax_at(z, of[a : a + PIECE], tame[0])
            for rows, a, b in classes:
                z = h[rows] @ p["v"][a:b].T
                z += p["d"][a:b]
                score[rows] += _log_softmax_at(z, y[rows] - a, tame[1])
            rare = np.flatnonzero(of == self.classes)
            score[rare] += self.log_share[y[rare] - self.n]
            out[at] = score
        return out


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether logits of hidden values in (-1, 1) cannot overflow an exponential: then no maximum need be taken from them."""
    return bool(len(bias)) and float((np.abs(weights).sum(axis=0) + np.abs(bias)).max()) < 60


def _sums(z: np.ndarray) -> np.ndarray:
    """The sums of the columns."""
    return np.ones(len(z), z.dtype) @ z


def _exponentials(z: np.ndarray, bounded: bool) -> np.ndarray:
    """exp(z) in place, from each row's maximum unless bounded; the sums of the rows."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray, bounded: bool = False) -> np.ndarray:
    total = _exponentials(z, bounded)
    z *= (1 / total)[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray, bounded: bool = False) -> np.ndarray:
    own = z[np.arange(len(z)), at].copy()
    if not bounded:
        own -= z.max(axis=1)
    return own - np.log(_exponentials(z, bounded))


def _words(batch, text_col: str):
    for rows, data, offsets in _text.blocks(batch, text_col):
        yield rows, _text.Words(data, offsets, _text.ALNUM)


def _counts(batches, text_col: str):
    """Distinct words, as hashes, and their numbers; merged as long as they are few enough for a task."""
    have, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        for lo in range(0, len(have), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(have[lo : lo + 50_000].view(np.int64)), pa.array(n[lo : lo + 50_000])], ["word", "n"])

    for batch in batches:
        for _, words in _words(batch, text_col):
            new, count = np.unique(words.hash, return_counts=True)
            have, at = np.unique(np.concatenate([have, new]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, count]), minlength=len(have)).astype(np.int64)
            if len(have) > 500_000:
                yield from rows()
                have, n = have[:0], n[:0]
    yield from rows()


def _warm_rows(batches, text_col: str, model: Model):
    """Contexts and targets of tokens drawn over each whole text."""
    for batch in batches:
        for _, words in _words(batch, text_col):
            tokens, out = model.tokens(words.hash), []
            for a, b in zip(words.bound[:-1].tolist(), words.bound[1:].tolist()):
                rng = np.random.default_rng([b - a, *tokens[a : a + 4].tolist()])
                at = a + (rng.choice(b - a, WARM_TOKENS, replace=False) if b - a > WARM_TOKENS else np.arange(b - a))
                out.append(np.column_stack([model.contexts(tokens, words.bound, at), tokens[at]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["rows"])


def _changes(batches, start: Model, text_col: str):
    """What each shard's documents change in the network, times their tokens, by parameter; shards follow one another."""
    shard, model, n, ctx, y = None, None, 0, [], []

    def learn(least: int):
        """Steps over whole batches of what has gathered, so that they do not depend on how rows arrive."""
        nonlocal ctx, y
        if sum(map(len, y)) >= least:
            c, t = np.concatenate(ctx), np.concatenate(y)
            whole = len(t) if least == 1 else len(t) // (2 * BATCH) * 2 * BATCH
            for lo in range(0, whole, 2 * BATCH):
                model.steps(c[lo : min(whole, lo + 2 * BATCH)], t[lo : min(whole, lo + 2 * BATCH)], BATCH, RATE / 2)
            ctx, y = [c[whole:]], [t[whole:]]

    def done():
        learn(1)
        if n:
            flat = np.concatenate([(model.p[k] - start.p[k]).ravel() for k in start.p]).astype(np.float64) * n
            at = np.append(np.flatnonzero(flat), len(flat))
            value = np.append(flat, n)[at]
            for lo in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 50_000].astype(np.int32)), pa.array(value[lo : lo + 50_000])], ["i", "v"])

    for batch in batches:
        of = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a and of[a] != shard:
                if shard is not None:
                    yield from done()
                shard, model, n, ctx, y = of[a], start.copy(), 0, [], []
            for _, words in _words(batch.slice(a, b - a), text_col):
                tokens = model.tokens(words.hash)
                for lo in range(0, len(tokens), 2 * BATCH):
                    at = np.arange(lo, min(len(tokens), lo + 2 * BATCH))
                    ctx.append(model.contexts(tokens, words.bound, at))
                    y.append(tokens[at])
                    learn(2 * BATCH)
                n += len(tokens)
    if shard is not None:
        yield from done()


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Vocabulary and network from all documents."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(*_text.hashable(docs)).alias("draw")).where("text IS NOT NULL")
    found = texts.select("text").mapInArrow(lambda b: _counts(b, "text"), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(VOCAB).collect()
    hashes = np.array([r["word"] for r in top], np.int64)
    bucket = F.shiftrightunsigned("word", 64 - RARE_BITS)
    sums = found.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # 2**RARE_BITS rows at most
    rare, total = np.zeros(1 << RARE_BITS, np.int64), int(sum(sums.column("n").to_pylist()))
    rare[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    np.subtract.at(rare, (hashes.view(np.uint64) >> np.uint64(64 - RARE_BITS)).astype(np.int64), np.array([r["n"] for r in top], np.int64))
    model = Model(hashes, rare)

    n = texts.count()
    share = min(1.0, WARM / max(n, 1))
    drawn = texts.where(F.pmod("draw", F.lit(1 << 30)) < share * float(1 << 30)).select("text")
    sent = spark.sparkContext.broadcast(model)  # parameters of a fixed number of words and buckets
    warm = sorted(bytes(r["rows"]) for r in drawn.mapInArrow(lambda b: _warm_rows(b, "text", sent.value), "rows binary").limit(2 * WARM).collect())
    rows = np.concatenate([np.frombuffer(r, np.int32) for r in warm]).reshape(-1, 2 * SIDE + 1).astype(np.int64) if warm else np.zeros((0, 2 * SIDE + 1), np.int64)
    for epoch in range(WARM_EPOCHS):
        model.steps(rows[:, :-1], rows[:, -1], WARM_BATCH, RATE / (1 + epoch))

    shards = max(SHARDS, -(-total // SHARD_TOKENS))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("draw", F.lit("shard")), F.lit(shards)).cast("int"))
    for turn in range(ROUNDS):
        mine = dealt.where(F.col("shard") % ROUNDS == turn).repartition("shard").sortWithinPartitions("shard", "draw", "text")
        _average(model, mine.select("shard", "text"))
    return model


def _average(model: Model, shards: DataFrame) -> None:
    """Moves the model by the mean of what the shards change, weighed by tokens."""
    sent = shards.sparkSession.sparkContext.broadcast(model)
    sums = shards.mapInArrow(lambda b: _changes(b, sent.value, "text"), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(sum(v.size for v in model.p.values()) + 1)
    flat[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    if flat[-1]:
        at = 0
        for k, v in model.p.items():
            model.p[k] = (v + (flat[at : at + v.size] / flat[-1]).reshape(v.shape)).astype(np.float32)
            at += v.size


def _score(batches, model: Model, text_col: str, keep: list[str]):
    for batch in batches:
        for rows, words in _words(batch, text_col):
            total = np.concatenate([[0.0], np.cumsum(model.log_probabilities(model.tokens(words.hash), words.bound))])
            n, score = np.diff(words.bound), np.diff(total[words.bound])
            mean = pa.array(np.divide(score, n, out=np.zeros_like(score), where=n > 0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(n.astype(np.int64)), pa.array(score), mean], [*keep, *OUTPUTS])


def lm_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs plus n_tokens, pll (summed conditional log-probabilities) and pll_mean (by token)."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("pll", T.DoubleType()), T.StructField("pll_mean", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lambda b: _score(b, sent.value, text_col, keep), schema)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every whole document under a network of the same corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, fit(docs)).select("doc_id", *OUTPUTS)
