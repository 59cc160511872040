"""Ridge readouts: one regression for each group, from sums of products by group; rows of a group spread over tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def standardised(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """x scaled by the training rows: population deviation, below 1e-6 taken as 1."""
    sd = train.std(axis=0)
    return (x - train.mean(axis=0)) / np.where(sd < 1e-6, 1.0, sd)


def loo_predictions(x: np.ndarray, y: np.ndarray, alphas: list[float]) -> np.ndarray:
    """(alphas, rows, targets): exact leave-one-out predictions of ridge with an intercept, from one SVD."""
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    u, s, _ = np.linalg.svd(xc, full_matrices=False)
    uty, out = u.T @ yc, []
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        fit = u @ (shrink[:, None] * uty)
        h = (u**2) @ shrink + 1 / len(x)
        out.append(y - (yc - fit) / (1 - h)[:, None])
    return np.array(out)


def column_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson's r of matching columns; 0 where one is constant."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    den = np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    return np.divide((a * b).sum(axis=0), den, out=np.zeros_like(den), where=den > 0)


def _packed(sums: DataFrame, name: str) -> DataFrame:
    """(grp, name ARRAY) from (grp, p, v), in the order of p."""
    return sums.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e["v"]).alias(name))


def _centred(rows: DataFrame) -> DataFrame:
    """rows (grp, x ARRAY, y ARRAY) plus the means of (x, y) in their group; the means are broadcast, one row a group."""
    means = rows.select("grp", F.posexplode(F.concat("x", "y")).alias("p", "v")).groupBy("grp", "p").agg(F.avg("v").alias("v"))
    return rows.select("grp", "x", "y").join(F.broadcast(_packed(means, "mean")), "grp")


def _products(centred: DataFrame) -> DataFrame:
    """(grp, n, ss ARRAY, n_x, mean): the sums of products of the centred (x, y), added from partial sums by batch; a fixed size a group."""
    def partial(batches):
        for pdf in batches:
            for grp, part in pdf.groupby("grp"):
                z = np.hstack([np.array(part[c].tolist(), dtype=float) for c in ("x", "y")]) - np.asarray(part["mean"].iloc[0])
                yield pd.DataFrame({"grp": [grp], "n": [len(z)], "n_x": [len(part["x"].iloc[0])], "ss": [(z.T @ z).ravel().tolist()], "mean": [part["mean"].iloc[0]]})

    parts = centred.mapInPandas(partial, "grp long, n long, n_x int, ss array<double>, mean array<double>")
    sums = parts.select("grp", "n", "n_x", "mean", F.posexplode("ss").alias("p", "v")).groupBy("grp", "p").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.first("n_x").alias("n_x"), F.first("mean").alias("mean"))
    each = F.array_sort(F.collect_list(F.struct("p", "v")))
    return sums.groupBy("grp").agg(F.first("n").alias("n"), F.transform(each, lambda e: e["v"]).alias("ss"), F.first("n_x").alias("n_x"), F.first("mean").alias("mean"))


def _scaled(n: int, ss, n_x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Deviations of x, X'X and X'y of standardised x, and y'y."""
    ss = np.asarray(ss, dtype=float)
    ss = ss.reshape(int(round(len(ss) ** 0.5)), -1)
    sd = np.sqrt(np.maximum(np.diag(ss)[:n_x] / n, 0))
    sd = np.where(sd < 1e-6, 1.0, sd)
    return sd, ss[:n_x, :n_x] / np.outer(sd, sd), ss[:n_x, n_x:] / sd[:, None], ss[n_x:, n_x:]


def ridge_loo(rows: DataFrame, alphas: tuple[float, ...] = (0.1, 1.0, 10.0)) -> DataFrame:
    """(grp, target, alpha, r) for rows (grp, image_id, x ARRAY, y ARRAY): each target's best penalty and leave-one-out r.

    The first penalty wins ties. Weights come from the sums of a group; predictions and leverages are taken row by row.
    """
    centred = _centred(rows)

    def solve(batches):
        for pdf in batches:
            for grp, n, ss, n_x in zip(pdf["grp"], pdf["n"], pdf["ss"], pdf["n_x"]):
                sd, xx, xy, _ = _scaled(n, ss, n_x)
                inverse = [np.linalg.inv(xx + a * np.eye(n_x)) for a in alphas]
                yield pd.DataFrame({"grp": [grp], "n": [n], "sd": [sd.tolist()], "inverse": [np.ravel(inverse).tolist()], "w": [np.ravel([i @ xy for i in inverse]).tolist()]})

    def predict(batches):
        for pdf in batches:
            for grp, part in pdf.groupby("grp"):
                one = part.iloc[0]
                x, y = (np.array(part[c].tolist(), dtype=float) for c in ("x", "y"))
                mean, p, q = np.asarray(one["mean"]), x.shape[1], y.shape[1]
                x, y = (x - mean[:p]) / np.asarray(one["sd"]), y - mean[p:]
                for k, (inverse, w) in enumerate(zip(np.reshape(list(one["inverse"]), (-1, p, p)), np.reshape(list(one["w"]), (-1, p, q)))):
                    h = np.einsum("nd,de,ne->n", x, inverse, x) + 1 / one["n"]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        out = y - (y - x @ w) / (1 - h)[:, None]
                    yield pd.DataFrame({"grp": grp, "target": np.arange(q), "k": k, "n": float(len(x)), "sa": out.sum(axis=0), "sb": y.sum(axis=0), "saa": (out * out).sum(axis=0), "sbb": (y * y).sum(axis=0), "sab": (out * y).sum(axis=0)})

    fitted = _products(centred).mapInPandas(solve, "grp long, n long, sd array<double>, inverse array<double>, w array<double>")
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    parts = centred.join(fitted, "grp").mapInPandas(predict, "grp long, target int, k int, " + ", ".join(f"{c} double" for c in names))
    n, sa, sb, saa, sbb, sab = map(F.col, names)
    a, b = n * saa - sa * sa, n * sbb - sb * sb
    r = F.when((a > 1e-18) & (b > 1e-18) & ~F.isnan(a * b), (n * sab - sa * sb) / F.sqrt(a * b)).otherwise(0.0)
    each = parts.groupBy("grp", "target", "k").agg(*[F.sum(c).alias(c) for c in names]).select("grp", "target", r.alias("r"), (-F.col("k")).alias("k"))
    best = each.groupBy("grp", "target").agg(F.max(F.struct("r", "k")).alias("best"))
    return best.select("grp", "target", F.element_at(F.array(*map(F.lit, map(float, alphas))), 1 - F.col("best.k")).alias("alpha"), F.col("best.r").alias("r"))


def variance_partition(rows: DataFrame, families: dict[str, list[int]], alpha: float = 100.0) -> DataFrame:
    """(grp, family, unique_r2) for rows (grp, image_id, x ARRAY, y DOUBLE): R2 of all predictors minus R2 without a family."""
    def r2(xx, xy, yy):
        w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
        return 1 - (yy - 2 * w @ xy + w @ xx @ w) / yy if yy > 0 else np.nan

    def fit(batches):
        for pdf in batches:
            for grp, n, ss, n_x in zip(pdf["grp"], pdf["n"], pdf["ss"], pdf["n_x"]):
                _, xx, xy, yy = _scaled(n, ss, n_x)
                full = r2(xx, xy[:, 0], yy[0, 0])
                rest = {f: np.delete(np.arange(n_x), cols) for f, cols in families.items()}
                yield pd.DataFrame({"grp": grp, "family": list(rest), "unique_r2": [full - r2(xx[np.ix_(c, c)], xy[c, 0], yy[0, 0]) for c in rest.values()]})

    return _products(_centred(rows.withColumn("y", F.array("y")))).mapInPandas(fit, "grp long, family string, unique_r2 double")


def mahalanobis(rows: DataFrame, reference: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(image_id, distance) of rows (image_id, v) to the mean of reference rows (v).

    Count, sums and the cross products of the reference are partial sums by task, added on the driver
    (a dim x dim matrix), so the reference may have any number of rows.
    """
    def moments(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=float)
            if len(x):
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "ss": [(x.T @ x).ravel().tolist()]})

    parts = reference.select("v").mapInPandas(moments, "n long, s array<double>, ss array<double>")
    n = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    add = lambda c: [r["x"] for r in parts.select(F.posexplode(c).alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).orderBy("p").collect()]
    s, ss = np.array(add("s")), np.array(add("ss"))
    mean = s / n
    cov = (ss.reshape(len(s), -1) - n * np.outer(mean, mean)) / (n - 1) + ridge * np.eye(len(s))
    inverse = np.linalg.inv(cov)

    def score(batches):
        for pdf in batches:
            d = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), -1) - mean if len(pdf) else np.zeros((0, len(mean)))
            yield pd.DataFrame({"image_id": pdf["image_id"], "distance": np.sqrt(np.maximum(np.einsum("nd,de,ne->n", d, inverse, d), 0))})

    return rows.select("image_id", "v").mapInPandas(score, "image_id long, distance double")
