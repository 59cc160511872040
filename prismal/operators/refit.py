"""Greedy selection of images by how well refitted readouts tell models apart.

Every model is a teacher, whose responses are its features with noise, and a student, whose ridge readout of its own
features is fitted to each teacher's responses. The readouts are fitted on base images together with the images selected so
far and the candidate, and predict each of these without itself (`dual.Candidates`). A candidate's score is how
far, over the teachers, a student's own predicted distances agree with its teacher's noisy ones beyond every other
student's: the share of teachers told right, the margin, or both in this order.

A round is one Spark job over all candidates and students for a proxy that keeps the selected images' predictions and adds the
candidate's distances to fixed sums, and one for the exact scores of the best by that proxy. What the shortlist can lose
is measured: as long as a candidate left out could win if its exact score exceeded its proxy by as much as any
exact score did so far, the shortlist doubles (`tolerance` more is accepted).
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from . import dual, groups
from .groups import arrays, matrix
from .simulation import normals


def student_rows(features: DataFrame, part: Column, noise: float, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """(grp, image_id, part, x, y, y2): for each image and student (by name, numbered) its features, and all teachers' responses
    with two draws of normal noise of variance `noise`, one to fit and one to score; and the names. Models are few."""
    names = [r["model"] for r in features.select("model").distinct().orderBy("model").collect()]
    wide = features.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("model", "v"))).alias("m")).where(F.size("m") == len(names))
    wide = wide.select("image_id", part.alias("part"), F.flatten(F.transform("m", lambda m: m["v"])).alias("all"), F.transform("m", lambda m: F.size(m["v"])).alias("sizes"))
    sd = noise**0.5

    def run(batches):
        for batch in batches:
            keys = batch.column("image_id").to_numpy()
            every = matrix(batch.column("all"))
            bound = np.cumsum([0, *batch.column("sizes")[0].as_py()]) if len(batch) else [0]
            draws = [every + sd * normals(seed, k, keys.view(np.uint64), every.shape[1]) if sd else every for k in (0, 1)]
            for g in range(len(bound) - 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), g)), batch.column("image_id"), batch.column("part"), arrays(every[:, bound[g] : bound[g + 1]]), arrays(draws[0]), arrays(draws[1])],
                    ["grp", "image_id", "part", "x", "y", "y2"],
                )

    return wide.mapInArrow(run, "grp long, image_id long, part string, x array<double>, y array<double>, y2 array<double>"), names


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Cosine distances of all pairs of rows."""
    u = _unit(x)
    return 1 - (u @ u.T)[np.triu_indices(len(x), 1)]


def profile_agreement(a: np.ndarray, b: np.ndarray, method: str) -> float:
    """Pearson's or Spearman's correlation of two profiles (ranks in order of place for ties); 0 where one is constant."""
    if method == "spearman":
        a, b = (np.argsort(np.argsort(v, kind="stable"), kind="stable").astype(float) for v in (a, b))
    return float(dual.column_scores(a[:, None], b[:, None])[0])


class Round:
    """One student's part of a round: its readout with the selected images, and the teachers' responses to these."""

    def __init__(self, own: dual.Candidates, y2: np.ndarray, best: np.ndarray, n_teachers: int, method: str):
        self.own, self.y2, self.best, self.method = own, y2, best, method
        self.blocks = np.split(np.arange(own.y.shape[1]), n_teachers)
        self.fixed = np.empty_like(own.y)
        for k in np.unique(best):
            self.fixed[:, best == k] = own.left_out(k)[:, best == k]

    def candidates(self, x: np.ndarray, u: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """By penalty what it needs, the candidates' own predictions, and which candidates are valid."""
        found = {k: self.own.added(x, u, k) for k in np.unique(self.best)}
        valid = np.all([np.isfinite(c) & (c > dual.LEAST_COMPLEMENT) for _, c, _ in found.values()], axis=0)
        alone = np.empty((len(x), len(self.best)))
        for k, (_, _, p) in found.items():
            alone[:, self.best == k] = p[:, self.best == k]
        return found, alone, valid

    def exact(self, x: np.ndarray, u: np.ndarray, y: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """(candidates, teachers): agreement of predicted with responded distances; NaN where a candidate is not valid."""
        found, alone, valid = self.candidates(x, u)
        out = np.full((len(x), len(self.blocks)), np.nan)
        for i in np.flatnonzero(valid):
            shown = np.empty_like(self.own.y)
            for k, (q, c, p) in found.items():
                mine = np.flatnonzero(self.best == k)
                shown[:, mine] = self.own.selected(q[i], c[i], p[i], y[i], k, mine)
            for t, cols in enumerate(self.blocks):
                predicted, response = np.vstack([shown[:, cols], alone[i, cols]]), np.vstack([self.y2[:, cols], y2[i, cols]])
                out[i, t] = profile_agreement(_pairs(predicted), _pairs(response), self.method)
        return out

    def proxy(self, x: np.ndarray, u: np.ndarray, y2: np.ndarray) -> np.ndarray:
        """As `exact` by Pearson's correlation, with the selected images' predictions as they are without the candidate."""
        _, alone, valid = self.candidates(x, u)
        out = np.full((len(x), len(self.blocks)), np.nan)
        for t, cols in enumerate(self.blocks):
            old = [_pairs(v[:, cols]) for v in (self.fixed, self.y2)]
            new = [1 - _unit(v[:, cols]) @ _unit(s[:, cols]).T for v, s in ((alone, self.fixed), (y2, self.y2))]
            n = len(old[0]) + new[0].shape[1]
            (sa, saa), (sb, sbb) = (((o.sum() + w.sum(axis=1)), ((o * o).sum() + (w * w).sum(axis=1))) for o, w in zip(old, new))
            sab = (old[0] * old[1]).sum() + (new[0] * new[1]).sum(axis=1)
            a, b = n * saa - sa * sa, n * sbb - sb * sb
            out[:, t] = np.divide(n * sab - sa * sb, np.sqrt(np.maximum(a * b, 0)), out=np.zeros(len(x)), where=(a > 1e-18) & (b > 1e-18))
        out[~valid] = np.nan
        return out


def _scored(by_student: DataFrame, n: int, objective: str, aggregate: str) -> DataFrame:
    """(image_id, score, tie, accuracy, margin) from (grp, image_id, r): a student's agreement with each teacher."""
    worst = F.lit(float("-inf"))
    clean = by_student.select("image_id", "grp", F.transform("r", lambda v: F.when(v.isNull() | F.isnan(v), worst).otherwise(v)).alias("r"))
    each = clean.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("grp", "r"))).alias("s")).where(F.size("s") == n)

    def margin(t: int) -> Column:
        others = F.transform(F.filter("s", lambda s: s["grp"] != t), lambda s: F.get(s["r"], F.lit(t)))
        return F.get(F.get("s", F.lit(t))["r"], F.lit(t)) - F.array_max(others)

    margins = F.transform(F.array(*[margin(t) for t in range(n)]), lambda m: F.when(F.isnan(m), worst).otherwise(m))
    total = lambda a, start: F.aggregate(a, F.lit(start), lambda s, m: s + m)
    each = each.withColumn("m", margins).select(
        "image_id", (F.size(F.filter("m", lambda m: m > 0)) / F.lit(n)).alias("accuracy"), (total("m", 0.0) / n if aggregate == "mean" else F.array_min("m")).alias("margin")
    )
    first, second = ("accuracy", "margin") if objective == "accuracy_margin" else ("margin", "accuracy")
    return each.select("image_id", F.col(first).alias("score"), F.col(second).alias("tie"), "accuracy", "margin")


def refit_greedy(
    features: DataFrame, part: Column, start: list[int], size: int, alphas=(0.1, 1.0, 10.0), noise: float = 0.0, shortlist: int | None = 64, tolerance: float = 0.0,
    objective: str = "accuracy_margin", aggregate: str = "mean", method: str = "spearman", seed: int = 0,
) -> DataFrame:
    """(place, image_id, score, tie, n_exact, gap) of the images chosen after `start` (three at least), until `size` are.

    features: (image_id, model, v); part names train, val and candidate images by a column of image_id (others take no
    part). shortlist None rescores every candidate. n_exact counts exact scores; gap is the most by which one exceeded its
    proxy. Ties go to the smaller id. A later call resumes with the images chosen so far in `start`.
    """
    if len(start) < 3:
        raise ValueError("distances of three images at least are needed to begin")
    if objective not in ("accuracy_margin", "margin") or aggregate not in ("mean", "min") or method not in ("pearson", "spearman"):
        raise ValueError(f"objective {objective}, aggregate {aggregate}, method {method}")
    spark, alphas = features.sparkSession, [float(a) for a in alphas]
    chosen = [int(i) for i in start]
    where = F.when(F.col("image_id").isin(chosen), "candidate").otherwise(part)
    rows, names = student_rows(features, where, noise, seed)
    rows = rows.where("part IN ('train', 'val', 'candidate')")
    n = len(names)
    if n < 2:
        raise ValueError("two models at least are needed")
    best = dual.penalties(rows.where("part <> 'candidate'"), alphas, ("train",), ("val",))
    best = checkpointed(best.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "k"))), lambda s: s["k"]).alias("best")))
    ready, factors, held_bytes = dual.prepared(rows, ("train", "val"), ("train",))
    # y2 lies about the same means as y: both are responses of a teacher, and distances are of centred responses
    shift = rows.where("part = 'train'").groupBy("grp", "image_id").agg(F.first("y").alias("y"))
    means = groups.summed(shift.select("grp", "y"), lambda b: matrix(b.column("y")).sum(axis=0, keepdims=True)).select("grp", F.transform("v", lambda v: v / F.col("n")).alias("_mean"))
    second = rows.where("part = 'candidate'").join(means, "grp").select("grp", "image_id", F.zip_with("y2", "_mean", lambda a, b: a - b).alias("y2"))
    pool = checkpointed(ready.where("part = 'candidate'").join(second, ["grp", "image_id"]).drop("part"))
    factors = checkpointed(factors.join(best, "grp"))

    def state(now: list[int]) -> DataFrame:
        """(grp, data): each student's round."""
        both = factors.select("grp", "data", "best", *[F.lit(None).cast(k).alias(c) for c, k in pool.dtypes if c != "grp"])
        mine = pool.where(F.col("image_id").isin(now))
        both = both.unionByName(mine.withColumn("data", F.lit(None).cast("binary")).withColumn("best", F.lit(None).cast("array<int>")))

        def run(b: pa.Table) -> pa.Table:
            one = next(r for r in b.select(["data", "best"]).to_pylist() if r["data"] is not None)
            own = b.filter(pa.array([i is not None for i in b.column("image_id").to_pylist()]))
            own = own.take(pa.array(np.argsort(own.column("image_id").to_numpy(), kind="stable")))
            x, u, y, y2 = (matrix(own.column(c)) for c in ("x", "u", "y", "y2"))
            held = Round(dual.Candidates(dual.Space(pickle.loads(one["data"])), x, u, y, alphas), y2, np.array(one["best"]), n, method)
            return groups.pack([b.column("grp")[0].as_py()], [{"round": held}])

        return both.groupBy("grp").applyInArrow(run, groups.PACKED)

    def agreement(some: DataFrame, packed: DataFrame, exact: bool) -> DataFrame:
        def run(grp, b, one):
            x, u, y, y2 = (matrix(b.column(c)) for c in ("x", "u", "y", "y2"))
            r = one["round"].exact(x, u, y, y2) if exact else one["round"].proxy(x, u, y2)
            yield pa.table({"grp": b.column("grp"), "image_id": b.column("image_id"), "r": arrays(r)})

        return groups.meet(some, packed, run, "grp long, image_id long, r array<double>", 2 * held_bytes)

    order = [F.desc("score"), F.desc("tie"), F.asc("image_id")]
    found = []
    while len(chosen) < size:
        packed = state(chosen)
        left = pool.where(~F.col("image_id").isin(chosen))
        done: dict[int, tuple] = {}
        gap, want = 0.0, shortlist
        proxies = None if shortlist is None else checkpointed(_scored(agreement(left, packed, False), n, objective, aggregate))
        while True:
            if proxies is None:
                some = left
            else:
                top = {r["image_id"]: r["score"] for r in proxies.orderBy(*order).limit(want).collect()}
                some = left.where(F.col("image_id").isin([i for i in top if i not in done]))
            exact = _scored(agreement(some, packed, True), n, objective, aggregate)
            if proxies is None:
                counted = exact.count()
                win = exact.orderBy(*order).limit(1).collect()
                break
            for r in exact.collect():
                done[r["image_id"]] = (r["score"], r["tie"], -r["image_id"])
                gap = max(gap, r["score"] - top[r["image_id"]]) if np.isfinite(r["score"]) and np.isfinite(top[r["image_id"]]) else gap
            counted = len(done)
            least = min(top.values(), default=0.0)
            lead = max(done.values(), default=None)
            if len(top) < want or lead is None or lead[0] + tolerance >= least + gap:
                win = [] if lead is None else [{"image_id": -lead[2], "score": lead[0], "tie": lead[1]}]
                break
            want *= 2
        if not win:
            break  # no candidate is left
        chosen.append(int(win[0]["image_id"]))
        found.append((len(chosen), chosen[-1], float(win[0]["score"]), float(win[0]["tie"]), int(counted), float(gap)))
    return spark.createDataFrame(found, "place int, image_id long, score double, tie double, n_exact long, gap double")
