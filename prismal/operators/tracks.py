"""Greedy selection over several tracks: one scan of the pool a round, scores by track, one aggregate.

A track is a set of features of the same images and models (raw, or encoded for one subject or more). Its score for
a candidate is how well the models are told apart by the distances of the selected images and the candidate: expected
correlations under measurement noise, folded within and across models. The scores of a track are
normalised over the pool of the round, and the tracks are aggregated.

The pool lies in one row an image, written once. A round sends the selected images' vectors and, for each track, the
sums behind the correlations of their distances to every task, so a candidate's own distances are all that is computed
for it and nothing is shuffled but one row of extremes and the best candidate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .groups import arrays, matrix
from .tables import draw_key

FOLDS = ("mean", "min", "smooth_min")
AGGREGATES = ("identity", "mean", "min", "smooth_min", "weighted_mean", "power_mean")
#: Bytes of the selected images' vectors that are sent to every task.
SENT_BYTES = 256 << 20


def _smooth_min(x: np.ndarray, axis: int, beta: float) -> np.ndarray:
    least = np.expand_dims(x.min(axis=axis), axis)
    return np.squeeze(least, axis) - np.log(np.exp(-beta * (x - least)).sum(axis=axis)) / beta


def folded(x: np.ndarray, how: str, axis: int, beta: float) -> np.ndarray:
    return x.mean(axis=axis) if how == "mean" else x.min(axis=axis) if how == "min" else _smooth_min(x, axis, beta)


def utilities(r: np.ndarray, within: str, across: str, beta: float = 5.0) -> np.ndarray:
    """Scores of correlation matrices (candidates, models, models): own minus the folded others, folded over the models."""
    own, m = np.einsum("bmm->bm", r), r.shape[1]
    others = r[:, ~np.eye(m, dtype=bool)].reshape(len(r), m, m - 1)
    return folded(own - folded(others, within, 2, beta), across, 1, beta)


class Sums:
    """Numbers, sums and products of the models' distances over image pairs; correlations and their attenuation follow."""

    def __init__(self, n, s: np.ndarray, ss: np.ndarray):
        self.n, self.s, self.ss = n, s, ss

    @classmethod
    def of(cls, d: np.ndarray) -> "Sums":
        """d: (..., models, pairs)."""
        return cls(d.shape[-1], d.sum(axis=-1), np.einsum("...ip,...jp->...ij", d, d))

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.s + other.s, self.ss + other.ss)

    def expected(self, noise: float) -> np.ndarray:
        """r of noisy i with clean j: the correlation times sqrt(var / (var + noise + 1e-8)) of i; 0 where one is constant."""
        cov = self.ss / self.n - self.s[..., :, None] * self.s[..., None, :] / self.n**2
        var = np.maximum(np.einsum("...ii->...i", cov), 0.0)
        sd = np.sqrt(var)
        den = sd[..., :, None] * sd[..., None, :]
        r = np.divide(cov, den, out=np.zeros_like(cov), where=den > 1e-12)
        return r * np.sqrt(var / (var + noise + 1e-8))[..., :, None]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-9)


def distances(candidates: np.ndarray, selected: np.ndarray) -> np.ndarray:
    """Cosine distances (candidates, selected)."""
    return 1 - np.clip(_unit(candidates) @ _unit(selected).T, -1, 1)


def aggregated(scores: Column, names: list[str], how: str, weights: dict[str, float] | None = None, power: float = 2.0, beta: float = 5.0, least: Column | None = None) -> Column:
    """One score from an array of normalised track scores, in the order of names.

    A track without a weight weighs 0 in weighted_mean and 1 in power_mean; that shifts all scores of the round by
    their least one (`least`), so that bases are 1 and more.
    """
    each = [F.get(scores, F.lit(k)) for k in range(len(names))]
    add = lambda xs: sum(xs[1:], xs[0])
    if how == "identity":
        return each[0]
    if how == "mean":
        return add(each) / len(each)
    if how == "min":
        return F.array_min(scores)
    if how == "smooth_min":
        low = F.array_min(scores)
        return low - F.log(add([F.exp(-beta * (x - low)) for x in each])) / beta
    w = [float((weights or {}).get(n, 0.0 if weights and how == "weighted_mean" else 1.0)) for n in names]
    if how not in AGGREGATES or sum(w) == 0:
        raise ValueError(f"aggregate: {how} with weights {weights}")
    w = [x / sum(w) for x in w]
    if how == "weighted_mean":
        return add([x * v for x, v in zip(each, w)])
    return F.pow(add([v * F.pow(x - least + 1.0, F.lit(power)) for x, v in zip(each, w)]), F.lit(1.0 / power)) - 1.0 + least


def _pool(tracks: DataFrame) -> tuple[DataFrame, list[tuple[str, list[str], list[int]]]]:
    """(image_id, v ARRAY): an image's vectors of all tracks and models one after the other; and by track the models and sizes."""
    layout = tracks.groupBy("track", "model").agg(F.max(F.size("v")).alias("size")).orderBy("track", "model").collect()  # tracks and models are few
    names: dict[str, tuple[list, list]] = {}
    for r in layout:
        names.setdefault(r["track"], ([], []))[0].append(r["model"])
        names[r["track"]][1].append(r["size"])
    whole = tracks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("track", "model", "v"))).alias("m")).where(F.size("m") == len(layout))
    return whole.select("image_id", F.flatten(F.transform("m", lambda m: m["v"])).alias("v")), [(t, *x) for t, x in names.items()]


def hashed_start(pool: DataFrame, size: int, seed: int = 0) -> list[int]:
    """The first images by a hash of seed and id: a random start that does not depend on the order of rows."""
    return [r["image_id"] for r in pool.select("image_id").orderBy(draw_key(seed, F.col("image_id")), "image_id").limit(size).collect()]


def filtered_start(pool: DataFrame, valid: Callable[[DataFrame], DataFrame], size: int, batch: int = 64, seed: int = 0) -> tuple[list[int], int]:
    """The first `size` valid images in hashed order, and how many images were looked at.

    valid returns the rows of a batch that pass; it sees the images in batches, in order, until enough have passed, so
    what it costs is paid for those that are reached only. Fails where the pool has too few.
    """
    key, found, seen, last = draw_key(seed, F.col("image_id")), [], 0, None
    keyed = pool.withColumn("_key", key)
    while len(found) < size:
        # keys of different images may be equal in theory; the id makes the order total
        rest = keyed if last is None else keyed.where((F.col("_key") > last[0]) | ((F.col("_key") == last[0]) & (F.col("image_id") > last[1])))
        reached = rest.orderBy("_key", "image_id").limit(batch)
        ids = [(r["_key"], r["image_id"]) for r in reached.select("_key", "image_id").collect()]
        if not ids:
            raise ValueError(f"only {len(found)} of {size} valid images in the pool")
        here = pool.where(F.col("image_id").isin([i for _, i in ids]))
        passed = {r["image_id"] for r in valid(here).select("image_id").collect()}
        for k, (_, i) in enumerate(ids):
            if len(found) < size:
                seen += 1
                found += [i] if i in passed else []
        last = ids[-1]
    return found, seen


def track_scores(pool: DataFrame, layout, chosen: list[int], noise: dict[str, float], within: str, across: str, beta: float = 5.0) -> DataFrame:
    """(image_id, raw ARRAY): by track the score of each image that is not chosen, in the order of the layout."""
    held = sorted((r["image_id"], r["v"]) for r in pool.where(F.col("image_id").isin(chosen)).collect())
    selected = np.array([v for _, v in held], dtype=float)
    if selected.nbytes > SENT_BYTES:
        raise ValueError(f"{selected.nbytes} bytes of selected vectors; {SENT_BYTES} at most")
    parts, at = [], 0
    for track, _, sizes in layout:
        cuts = [slice(at + sum(sizes[:k]), at + sum(sizes[: k + 1])) for k in range(len(sizes))]
        at += sum(sizes)
        i, j = np.triu_indices(len(selected), 1)
        base = Sums.of(np.stack([distances(selected[:, c], selected[:, c])[i, j] for c in cuts]))
        parts.append((cuts, base, float(noise.get(track, 0.0))))
    sent = pool.sparkSession.sparkContext.broadcast((selected, parts))

    def run(batches):
        rows, each = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                b = batch.slice(lo, 1024)
                x = matrix(b.column("v"))
                out = []
                for cuts, base, level in each:
                    own = Sums.of(np.stack([distances(x[:, c], rows[:, c]) for c in cuts], axis=1))
                    out.append(utilities((base + own).expected(level), within, across, beta))
                yield pa.RecordBatch.from_arrays([b.column("image_id"), arrays(np.stack(out, axis=1))], ["image_id", "raw"])

    return pool.where(~F.col("image_id").isin(chosen)).mapInArrow(run, "image_id long, raw array<double>")


def normalised_tracks(scored: DataFrame, n: int, how: str) -> DataFrame:
    """scored plus scores, the raw scores by track over the rows: none, z (population deviation + 1e-6) or minmax (+ 1e-6)."""
    x = [F.get("raw", F.lit(k)) for k in range(n)]
    if how == "none":
        return scored.withColumn("scores", F.col("raw"))
    if how == "z":
        s = scored.agg(*[f(v).alias(f"{m}{k}") for k, v in enumerate(x) for m, f in (("a", F.avg), ("b", F.stddev_pop))]).first()
        pairs = [(s[f"a{k}"] or 0.0, (s[f"b{k}"] or 0.0) + 1e-6) for k in range(n)]
    elif how == "minmax":
        s = scored.agg(*[f(v).alias(f"{m}{k}") for k, v in enumerate(x) for m, f in (("a", F.min), ("b", F.max))]).first()
        pairs = [(s[f"a{k}"] or 0.0, (s[f"b{k}"] or 0.0) - (s[f"a{k}"] or 0.0) + 1e-6) for k in range(n)]
    else:
        raise ValueError(f"normalisation: {how}")
    return scored.withColumn("scores", F.array(*[(v - a) / b for v, (a, b) in zip(x, pairs)]))


def select_tracks(
    tracks: DataFrame, size: int, start: list[int] | None = None, start_size: int = 3, seed: int = 0, noise: dict[str, float] | None = None, within: str = "mean", across: str = "mean",
    normalisation: str = "none", aggregate: str = "mean", weights: dict[str, float] | None = None, power: float = 2.0, beta: float = 5.0,
) -> DataFrame:
    """(place, image_id, stage, score, scores MAP): `start` images (hashed ones unless given, two at least), then one a round.

    tracks: (track, model, image_id, v); an image counts where every track and model has it, and tracks have two models or more.
    score is the aggregate, scores the raw ones by track. Ties go to the smaller id. The result of an earlier call
    resumes it: its images are the start of the next.
    """
    if within not in FOLDS or across not in FOLDS or aggregate not in AGGREGATES:
        raise ValueError(f"within {within}, across {across}, aggregate {aggregate}")
    pool, layout = _pool(tracks)
    pool, names, spark = checkpointed(pool), [t for t, *_ in layout], tracks.sparkSession
    if aggregate == "identity" and len(names) != 1:
        raise ValueError("identity takes one track")
    chosen = list(start) if start else hashed_start(pool, start_size, seed)
    if len(chosen) < 2:
        raise ValueError("distances need two images to begin with")
    found = [(k + 1, i, "start", None, None) for k, i in enumerate(chosen)]
    while len(chosen) < size:
        scored = normalised_tracks(track_scores(pool, layout, chosen, noise or {}, within, across, beta), len(names), normalisation)
        least = None
        if aggregate == "power_mean":
            least = F.lit(float(scored.agg(F.min(F.array_min("scores")).alias("m")).first()["m"] or 0.0))
        best = scored.withColumn("score", aggregated(F.col("scores"), names, aggregate, weights, power, beta, least)).orderBy(F.desc("score"), "image_id").first()
        if best is None:
            break  # the pool is empty
        chosen.append(best["image_id"])
        found.append((len(chosen), best["image_id"], "greedy", float(best["score"]), dict(zip(names, best["raw"]))))
    return spark.createDataFrame(found, "place int, image_id long, stage string, score double, scores map<string,double>")
