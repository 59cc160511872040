"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte 3- and 4-grams (within words, with the space
at a word's border, letters lower-cased), hashed to 2**BITS rows; a linear layer and a softmax
over the languages follow. Both are trained by mini-batch stochastic gradient descent in numpy, in a task of its own, on a
bounded sample of labelled documents (`PER_LANGUAGE` different texts for each label, or fewer where there are so many
labels that `MOST` would be exceeded, but at least `FEWEST`; drawn by a hash of the text alone, each text whole).
A fifth of the sample is held back to calibrate:

* a temperature, fitted to smoothed targets (as many right and one wrong), so that it stays finite;
* the probability below which a text is rejected: `REJECT_SHARE` of the held-back documents do not reach it;
* the share of a text's n-grams that its language showed in training, below which it is rejected. The
  share is drawn to the usual one by `PRIOR` n-grams, so that a word or two are not judged. The threshold lies
  midway between the held-back documents in their own language (all but `REJECT_SHARE`) and what should
  go: the same documents in the best of the other languages (each language left out in turn) and random
  n-grams. Where the two overlap, it is the value that loses `REJECT_SHARE` of the documents.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; without any
labelled row everything is `und`; rows with a null label only are scored; repeated rows are
predicted one by one; texts of any length are read whole; other columns pass through (those that
an output name clashes with are replaced).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _text

BITS, DIM = 18, 16
#: Bounds of the training sample: texts a language, texts of all languages together, and texts a language whatever their number.
PER_LANGUAGE, MOST, FEWEST = 500, 100_000, 8
#: N-grams at the usual share that a text's own are added to, before its share is compared.
PRIOR = 12
EPOCHS, BATCH, RATE = 4, 32, 0.5
REJECT_SHARE = 0.001
#: Never rejected from this calibrated probability on, whatever the held-back documents reach.
REJECT_MOST = 0.5
OUTPUTS = ("lang_pred", "score", "rejected")

_CODEC = pa.Codec("zstd", 3)
#: Bytes of text that are scored at once; the arrays over them take about fifty times as much.
_PREDICT_BLOCK = 1 << 18
_SPACE = _text.byte_table(lambda b: not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 3 and 4: the buckets of all n-grams of a block and their n + 1 bounds by document."""
    sizes = np.diff(offsets)
    n, docs = len(data), len(sizes)
    padded = np.full(n + 2 * docs, 32, dtype=np.uint8)
    letters = np.where(_SPACE[data], _text.LOWER[data], np.uint8(32))
    if n > 1:  # capital letters of Latin-1 in UTF-8
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        letters[1:][wide] += np.uint8(32)
    padded[np.arange(n) + 2 * np.repeat(np.arange(docs), sizes) + 1] = letters
    starts = offsets + 2 * np.arange(docs + 1)
    inside = padded != 32
    x = padded.astype(np.uint32)
    out = []
    for size in (3, 4):
        m = len(x) - size + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)))
            continue
        code = x[:m] | x[1 : m + 1] << np.uint32(8) | x[2 : m + 2] << np.uint32(16)
        ok = inside[1 : m + 1].copy()
        if size == 4:
            code |= x[3 : m + 3] << np.uint32(24)
            ok &= inside[2 : m + 2]
        at = np.flatnonzero(ok)
        code = code[at] * np.uint32(2654435761) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        out.append(((code >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(at, starts)))
    return out


def sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of the stretches between bounds; 0 for empty ones."""
    out = np.zeros(len(bound) - 1, dtype=np.float64)
    some = np.flatnonzero(np.diff(bound))
    if len(some):
        out[some] = np.add.reduceat(values, bound[some])
    return out


class Model:
    """Languages, embeddings and linear layer (as one weight for each n-gram and language), known n-grams and calibration."""

    def __init__(self, langs: list[str], table: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.bias, self.temperature, self.threshold = langs, bias, 1.0, 0.0
        self.factors = (table @ weights, np.eye(len(langs), dtype=np.float32)) if len(langs) <= DIM else (table, weights)
        self.per_lang = np.ascontiguousarray((table @ weights).T) if langs else table[:0]
        self.known = np.zeros((len(langs), 1 << BITS), dtype=bool)
        self.usual, self.least_known = 1.0, 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "factors"}

    def packed(self) -> bytes:
        """The model in few bytes: at most DIM numbers and a bit for each language a bucket."""
        rest = {k: v for k, v in self.__dict__.items() if k not in ("factors", "per_lang", "known")}
        return pickle.dumps((self.factors, np.packbits(self.known, axis=1), rest))

    @staticmethod
    def unpacked(data: bytes) -> Model:
        factors, known, rest = pickle.loads(data)
        model = Model(rest["langs"], *factors, rest["bias"])
        model.known = np.unpackbits(known, axis=1).astype(bool)
        model.__dict__.update(rest)
        return model

    def logits(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and numbers of n-grams of each document of a block."""
        count = sum(np.diff(b) for _, b in parts)
        total = np.stack([sum(sums(row[i], b) for i, b in parts) for row in self.per_lang], axis=1)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def shares(self, parts: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The share of each document's n-grams that its language showed in training, drawn to the usual one."""
        seen = sum(sums(self.known[np.repeat(best, np.diff(b)), i], b) for i, b in parts)
        return self.drawn(seen, count)

    def drawn(self, seen, count):
        return (seen + PRIOR * self.usual) / (count + PRIOR)

    def rejects(self, p: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (p < self.threshold) | (share < self.least_known)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: (language, buckets of a text's distinct n-grams, how often each occurs)."""
    langs = sorted({lang for lang, *_ in rows})
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weights += rng.normal(0, 0.3, weights.shape).astype(np.float32)
    y = np.array([langs.index(lang) for lang, *_ in rows])
    order = rng.permutation(len(rows))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    share = [(n / max(n.sum(), 1)).astype(np.float32) for *_, n in rows]
    steps, step = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        for at in range(0, len(used), BATCH):
            pick = used[at : at + BATCH]
            flat, part = np.concatenate([rows[i][1] for i in pick]), np.concatenate([share[i] for i in pick])
            size = np.array([len(rows[i][1]) for i in pick])
            doc = np.repeat(np.arange(len(pick)), size)
            h = np.zeros((len(pick), DIM), np.float32)
            some = np.flatnonzero(size)
            if len(some):
                h[some] = np.add.reduceat(table[flat] * part[:, None], (np.cumsum(size) - size)[some], axis=0)
            z = h @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ weights.T
            rate = RATE * (1 - step / steps)
            weights -= rate * (h.T @ p) / len(pick)
            bias -= rate * p.mean(axis=0)
            hit, inverse = np.unique(flat, return_inverse=True)
            for d in range(DIM):  # each n-gram moves by its documents' gradient; rare ones need the large step
                table[hit, d] -= rate * 20 * np.bincount(inverse, weights=back[doc, d] * part, minlength=len(hit)).astype(np.float32)
            step += 1
        rng.shuffle(used)
    model = Model(langs, table, weights, bias)
    for i in used:
        model.known[y[i], rows[i][1]] = True
    _calibrate(model, [rows[i] for i in held], y[held])
    return model


def _calibrate(model: Model, held: list[tuple[str, np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Temperature, least probability and least share of known n-grams, from documents kept from training."""
    n, count = len(held), np.array([c.sum() for *_, c in held])
    z = np.stack([(model.per_lang[:, at] @ c / max(c.sum(), 1)) for _, at, c in held]) + model.bias
    right = np.full(z.shape, 1 / (n + 2) / max(len(model.langs) - 1, 1))
    right[np.arange(n), y] = (n + 1) / (n + 2)
    grid = np.geomspace(0.02, 5, 90)
    losses = []
    for t in grid:
        model.temperature = t
        losses.append(-(right * np.log(model.probabilities(z) + 1e-30)).sum(axis=1).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(z)
    model.threshold = min(REJECT_MOST, float(np.quantile(p.max(axis=1), REJECT_SHARE)))

    seen = np.stack([(model.known[:, at] @ c) for _, at, c in held]).astype(float)
    model.usual = float(seen[np.arange(n), y].sum() / max(count.sum(), 1))
    own = np.quantile(model.drawn(seen[np.arange(n), y], count), REJECT_SHARE)
    long = count >= 4 * PRIOR  # of the others those that have enough n-grams to tell
    others = np.where(np.arange(z.shape[1]) == y[:, None], -np.inf, z).argmax(axis=1)
    strange = [float(model.known.mean(axis=1).max())]
    if len(model.langs) > 1 and long.any():
        strange.append(float(np.quantile(model.drawn(seen[np.arange(n), others], count)[long], 0.99)))
    low = max(strange)
    model.least_known = float((own + low) / 2) if low < own else float(own)


def _sample(batches, text_col: str):
    """The n-grams of each whole text: distinct buckets and how often each occurs."""
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col):
            parts = ngrams(data, offsets)
            out = [np.unique(np.concatenate([i[b[d] : b[d + 1]] for i, b in parts]), return_counts=True) for d in range(len(rows))]
            cells = [pa.array([_CODEC.compress(x[k].astype(np.int32).tobytes(), asbytes=True) for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column("lang"), pa.array([len(x[0]) for x in out], pa.int32()), *cells], ["lang", "n", "grams", "counts"])


def _trained(batches):
    """The model of all rows, whatever their order."""
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "grams", "counts", "n"))))

    bound = np.cumsum([0] + [n for *_, n in rows])
    flat = np.empty((2, bound[-1]), np.int32)  # one array, which goes back to the system as a whole
    for (_, *cells, n), at in zip(rows, bound):
        for k, cell in enumerate(cells):
            flat[k, at : at + n] = np.frombuffer(_CODEC.decompress(cell, decompressed_size=4 * n, asbytes=True), np.int32)
    if rows:
        model = train([(r[0], *flat[:, at : at + r[3]]) for r, at in zip(rows, bound)])
        yield pa.RecordBatch.from_arrays([pa.array([model.packed()], pa.binary())], ["model"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """A model from a sample of about `per_language` different labelled texts for each label, `most` in all."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("_draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("_draw").alias("_n")).toArrow()  # a row a label
    each = max(FEWEST, min(per_language, most // max(1, len(counts))))
    shares = counts.select(["lang"]).append_column("_below", pa.array([int(min(1.0, each / max(n, 1)) * (1 << 30)) for n in counts.column("_n").to_pylist()], pa.int64()))
    chosen = rows.join(F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, _below long")), "lang").where(F.pmod("_draw", F.lit(1 << 30)) < F.col("_below"))
    chosen = chosen.dropDuplicates(["lang", "_draw"]).select("lang", "text")
    sample = chosen.mapInArrow(lambda b: _sample(b, "text"), "lang string, n int, grams binary, counts binary")
    made = sample.repartition(1).mapInArrow(_trained, "model binary").collect()  # the sample is bounded; the driver gets the model only
    return Model.unpacked(made[0]["model"]) if made else Model([], np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32))


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _predict(batches, model: Model, text_col: str, keep: list[str]):
    langs = np.array([*model.langs, "und"], dtype=object)
    ascii_letter = np.zeros(256, dtype=bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    for batch in batches:
        for rows, data, offsets in _text.blocks(batch, text_col, _PREDICT_BLOCK):
            n = len(rows)
            best, score = np.full(n, len(model.langs)), np.zeros(n)
            rejected = np.ones(n, dtype=bool)
            if model.langs:
                lettered = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[data])])[offsets]) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = _has_letter(rows.column(text_col)[i].as_py())
                parts = ngrams(data, offsets)
                z, count = model.logits(parts)
                p = model.probabilities(z)
                rejected = ~lettered | model.rejects(p.max(axis=1), model.shares(parts, p.argmax(axis=1), count))
                best = np.where(lettered, p.argmax(axis=1), best)
                score = np.where(lettered, p.max(axis=1), 0.0)
            arrays = [rows.column(c) for c in keep] + [pa.array(langs[best], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *OUTPUTS])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs plus lang_pred, score (calibrated probability) and rejected; only the text is looked at."""
    keep = [c for c in docs.columns if c not in OUTPUTS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers a language
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lambda b: _predict(b, sent.value, text_col, keep), schema)


def held_out(id_col: str = "doc_id", of: int = 4, rest: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of)) == rest, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: every whole document's language, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
